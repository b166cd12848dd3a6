"""Small DuckDB SQL text builders shared by the oracle queries."""
from __future__ import annotations


def norm_table(t: str) -> str:
    s = f"trim(coalesce({t}, ''))"
    owner = f"upper(CASE WHEN contains({s}, '.') THEN split_part({s}, '.', 1) ELSE 'APP' END)"
    name = f"upper(CASE WHEN contains({s}, '.') THEN substr({s}, strpos({s}, '.') + 1) ELSE {s} END)"
    return f"({owner} || '.' || {name})"


def pick(p: str, col: str) -> str:
    """JSON value of key ``col`` in object ``p``: exact key, else first case-insensitive key."""
    key = (f"coalesce(CASE WHEN list_contains(json_keys({p}), '{col}') THEN '{col}' END, "
           f"list_filter(json_keys({p}), lambda k: upper(k) = '{col}')[1])")
    return f"json_extract({p}, '$.\"' || {key} || '\"')"


def text(v: str) -> str:
    return f"json_extract_string({v}, '$')"


def to_int(v: str, typ: str = "INTEGER") -> str:
    """.NET-style: fractional JSON numbers round half to even; text must be integral."""
    return (f"CASE WHEN json_type({v}) = 'DOUBLE' THEN CAST(round_even(CAST({v} AS DOUBLE), 0) AS {typ}) "
            f"ELSE TRY_CAST({text(v)} AS {typ}) END")


def catalog_values(rows, cols: str) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)
    body = ",\n  ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n  {body}) AS t({cols})"
