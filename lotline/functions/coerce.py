"""Type mapping and value coercion (inventory A6, A10, A11).

Everything here returns a ``Column``; nothing leaves the JVM.  Spark runs with
ANSI mode on, so every lenient conversion uses a ``try_*`` form.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.functions.keys import strip_ws

# Fixed values that must equal the reference's type mapping (catalog type ->
# runtime type).  Character types, binary types and timestamp spellings:
STRING_TYPES = ("VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR", "CLOB", "NCLOB")
BINARY_TYPES = ("BLOB", "RAW")
TIMESTAMP_TYPES = ("DATE", "TIMESTAMP", "TIMESTAMP(6)")


def spark_type_name(data_type: Column, precision: Column, scale: Column) -> Column:
    """Catalog type -> Spark type name, as a CASE expression over catalog rows.

    NUMBER: scale > 0 -> decimal(p or 38, s); precision missing/0 -> decimal(38,10);
    otherwise (scale <= 0, also negative) p <= 9 int, <= 18 bigint, else decimal(p,0).
    Only the literal spelling TIMESTAMP(6) (and DATE / TIMESTAMP) is a timestamp.
    """
    dt = F.upper(F.trim(data_type))
    p, s = precision, scale
    number = (
        F.when(F.coalesce(s, F.lit(0)) > 0,
               F.format_string("decimal(%d,%d)", F.coalesce(p, F.lit(38)), s))
        .when(p.isNull() | (p == 0), F.lit("decimal(38,10)"))
        .when(p <= 9, F.lit("int"))
        .when(p <= 18, F.lit("bigint"))
        .otherwise(F.format_string("decimal(%d,0)", p))
    )
    return (
        F.when(dt == "NUMBER", number)
        .when(dt == "FLOAT", F.lit("double"))
        .when(dt.isin(*TIMESTAMP_TYPES), F.lit("timestamp_ntz"))
        .when(dt.isin(*STRING_TYPES), F.lit("string"))
        .when(dt.isin(*BINARY_TYPES), F.lit("binary"))
        .otherwise(F.lit("string"))
    )


def spark_type_name_py(data_type: str, precision: int | None, scale: int | None) -> str:
    """Same mapping in plain Python, for the (small) catalog rows on the driver."""
    dt = (data_type or "").strip().upper()
    if dt == "NUMBER":
        if (scale or 0) > 0:
            return f"decimal({precision if precision is not None else 38},{scale})"
        if not precision:
            return "decimal(38,10)"
        if precision <= 9:
            return "int"
        if precision <= 18:
            return "bigint"
        return f"decimal({precision},0)"
    if dt == "FLOAT":
        return "double"
    if dt in TIMESTAMP_TYPES:
        return "timestamp_ntz"
    if dt in STRING_TYPES:
        return "string"
    if dt in BINARY_TYPES:
        return "binary"
    return "string"



def variant_text(v: Column) -> Column:
    """Text of a VARIANT value (strings unquoted, numbers as written)."""
    return F.try_variant_get(v, "$", "string")


def variant_is_string(v: Column) -> Column:
    """True for a JSON string (its JSON text starts with a quote); cheaper than a schema probe."""
    return F.substring(F.to_json(v), 1, 1) == F.lit('"')


def guid_to_bytes(text: Column) -> Column:
    """GUID text -> 16 bytes in .NET ``Guid.ToByteArray`` order, else NULL.

    The first three groups are stored little-endian (bytes 4-3-2-1, 6-5, 8-7),
    the last eight bytes as written.
    """
    h = F.lower(F.regexp_replace(F.trim(text), r"^\{|\}$", ""))
    ok = h.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    d = F.regexp_replace(h, "-", "")

    def byte(i: int) -> Column:  # i is the 1-based byte position in written order
        return F.substring(d, 2 * i - 1, 2)

    order = [4, 3, 2, 1, 6, 5, 8, 7, 9, 10, 11, 12, 13, 14, 15, 16]
    hexed = F.concat(*[byte(i) for i in order])
    return F.when(ok, F.unhex(hexed))


def coerce_lenient(v: Column, target: str) -> Column:
    """A10: coerce a VARIANT to ``target``; NULL when the conversion fails.

    Fractional numbers go to integers with round-half-even (.NET Convert), a
    fractional *string* fails; GUID text becomes .NET-ordered bytes.
    """
    t = target.lower()
    txt = variant_text(v)
    if t == "string":
        return txt
    if t in ("int", "bigint", "long"):
        st = "int" if t == "int" else "bigint"
        num = F.try_variant_get(v, "$", "decimal(38,10)")
        return F.when(variant_is_string(v), txt.try_cast(st)).otherwise(F.bround(num, 0).try_cast(st))
    if t.startswith("decimal") or t == "double":
        return txt.try_cast(t)
    if t in ("timestamp", "timestamp_ntz"):
        return txt.try_cast("timestamp_ntz")
    if t == "binary":
        return guid_to_bytes(txt)
    return txt.try_cast(t)


# A11 --------------------------------------------------------------------------------

def strict_date(text: Column) -> Column:
    """DATE rule: ``YYYY-MM-DD`` or ``YYYY-MM-DD[T ]HH:MM:SS``, cut at 19 chars; NULL = bad."""
    s = strip_ws(text)
    s = F.when(s.contains("T"), F.substring(F.regexp_replace(s, "T", " "), 1, 19)).otherwise(s)
    # checked by shape and cast without a zone: no local time is skipped or shifted
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(\s+\d{2}:\d{2}:\d{2})?$"),
                  F.regexp_replace(s, r"\s+", " ")).try_cast("timestamp_ntz")


def strict_timestamp(text: Column) -> Column:
    """TIMESTAMP rule: ISO text (a trailing Z is UTC), else the first 19 chars; NULL = bad."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), "Z$", ""), "T", " ")
    full = s.try_cast("timestamp_ntz")
    cut = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), F.substring(s, 1, 19)).try_cast("timestamp_ntz")
    return F.coalesce(full, cut)


def strict_zoned(text: Column, zone: str = "UTC") -> Column:
    """TIMESTAMP WITH TIME ZONE rule: ISO text with an offset or ``Z`` as an instant; NULL = bad.

    Dates and times may be written with or without separators, the time down to
    the hour; a date alone is its midnight, and text without an offset is a
    local time of ``zone``.  Digits behind the microsecond
    are cut; offsets go up to 18 hours.
    """
    s = strip_ws(text)
    shape = (r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
             r"(?:(Z)|([+-])(\d{2}):?(\d{2})?)?)?$")
    part = lambda k: F.nullif(F.regexp_extract(s, shape, k), F.lit(""))
    or_zero = lambda k: F.coalesce(part(k), F.lit("00"))
    at = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), or_zero(4), F.lit(":"), or_zero(5),
                  F.lit(":"), or_zero(6), F.lit("."), F.rpad(F.coalesce(part(7), F.lit("")), 6, "0"))
    offset = F.when(part(8).isNotNull(), "Z").when(part(9).isNotNull(), F.concat(part(9), part(10), F.lit(":"), or_zero(11)))
    return F.concat(at, F.coalesce(offset, F.lit(" " + zone))).try_cast("timestamp")


def coerce_declared(df: DataFrame, types: Mapping[str, str], zone: str = "UTC") -> DataFrame:
    """A11 as a row operator: every text column by its declared type.

    ``types`` gives the declared type of columns (any case), as the catalog lists
    them: DATE, TIMESTAMP..., TIMESTAMP WITH TIME ZONE (so spelled; with a
    precision it is read as a plain TIMESTAMP), NUMBER, FLOAT, BINARY_FLOAT,
    BINARY_DOUBLE.  Text that is no valid time gives NULL and its column in the
    array ``_bad``, in the order of the frame; text that is no number gives NULL
    and stays in ``<column>_RAW``.  NULLs, columns of other types or without a
    declared type, and values that are no text stay as they are.
    """
    declared = {c.upper(): t.upper() for c, t in types.items()}
    taken = {c.upper() for c in df.columns}
    out, bad = [], []
    for field in df.schema:
        quoted = "`" + field.name.replace("`", "``") + "`"
        text, kind = F.col(quoted), declared.get(field.name.upper(), "")
        if not isinstance(field.dataType, T.StringType):
            kind = ""
        if kind == "DATE":
            value = strict_date(text)
        elif kind.startswith("TIMESTAMP WITH TIME ZONE"):
            value = strict_zoned(text, zone)
        elif kind.startswith("TIMESTAMP"):
            value = strict_timestamp(text)
        elif kind in ("NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"):
            number, raw = keep_raw_number(strip_ws(text))
            name = field.name + "_RAW"
            if name.upper() in taken:
                raise ValueError(f"a column {name} exists already")
            out += [number.alias(field.name), F.when(raw.isNotNull(), text).alias(name)]
            continue
        else:
            out.append(text)
            continue
        out.append(value.alias(field.name))
        bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(field.name)))
    none = F.array().cast("array<string>")
    return df.select(*out, (F.array_compact(F.array(*bad)) if bad else none).alias("_bad"))


def keep_raw_number(text: Column, precision: int = 38, scale: int = 10) -> tuple[Column, Column]:
    """NUMBER rule: decimal when the text parses, else keep the text in a raw column."""
    num = F.trim(text).try_cast(f"decimal({precision},{scale})")
    raw = F.when(num.isNull() & text.isNotNull(), text)
    return num, raw


def spark_type(name: str) -> T.DataType:
    return T._parse_datatype_string(name)
