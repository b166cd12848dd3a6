"""The strict row operator over declared types, case by case."""
from decimal import Decimal

from lotline.functions.coerce import coerce_declared

TYPES = {"d": "date", "T": "TIMESTAMP(6)", "Z": "TIMESTAMP WITH TIME ZONE", "n": "NUMBER", "f": "BINARY_DOUBLE", "s": "VARCHAR2", "k": "DATE"}


def _one(spark, name, texts, zone="UTC"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string")
    shown = [name, *(["`" + name + "_RAW`"] if name in ("n", "f") else [])]
    rows = coerce_declared(df, TYPES, zone).selectExpr("i", *[f"cast({c} as string) v{k}" for k, c in enumerate(shown)], "_bad").orderBy("i").collect()
    return [(r.v0, r._bad) if len(shown) == 1 else (r.v0, r.v1, r._bad) for r in rows]


def test_dates(spark):
    got = _one(spark, "d", ["2024-02-29", " 2024-02-29\t", "2024-02-29T10:11:12.678Z", "2024-02-29 10:11:12", "2024-02-09", "2024-02-09  01:02:03",
                            "2023-02-29", "29/02/2024", "2024-02-29T10:11", "", None, "2024-02-29 10:11:12.5"])
    day, at = ("2024-02-29 00:00:00", []), ("2024-02-29 10:11:12", [])
    bad = (None, ["d"])
    assert got == [day, day, at, at, ("2024-02-09 00:00:00", []), ("2024-02-09 01:02:03", []), bad, bad, bad, bad, (None, []), bad]


def test_timestamps(spark):
    got = _one(spark, "T", ["2024-02-29T10:11:12.678Z", "2024-02-29 10:11:12", "2024-02-29", "2024-02-29 10:11:12 junk", "soon", None])
    assert got == [("2024-02-29 10:11:12.678", []), ("2024-02-29 10:11:12", []), ("2024-02-29 00:00:00", []),
                   ("2024-02-29 10:11:12", []), (None, ["T"]), (None, [])]


def test_zoned_timestamps(spark):
    texts = ["2024-02-29T10:11:12Z", "2024-02-29T10:11:12+05:30", "2024-02-29 10:11:12.1234567-08:00", "20240229T101112-0800", "2024-02-29T10",
             "2024-02-29", "2024-02-29T10:11:12", "2024-02-30T10:11:12Z", "2024-02-29T25:11:12Z", "10:11:12", None]
    good = ["2024-02-29 10:11:12", "2024-02-29 04:41:12", "2024-02-29 18:11:12.123456", "2024-02-29 18:11:12", "2024-02-29 10:00:00",
            "2024-02-29 00:00:00", "2024-02-29 10:11:12"]
    want = [(g, []) for g in good] + [(None, ["Z"])] * 3 + [(None, [])]
    assert _one(spark, "Z", texts) == want
    assert [v for v, _ in _one(spark, "Z", texts[:1] + texts[6:7], "Europe/Paris")] == ["2024-02-29 10:11:12", "2024-02-29 09:11:12"]


def test_numbers_keep_their_text(spark):
    for name in ("n", "f"):
        got = _one(spark, name, [" 1.50 ", "1e3", "n/a ", "", None])
        assert [(v and Decimal(v), raw, bad) for v, raw, bad in got] == [
            (Decimal("1.5"), None, []), (Decimal(1000), None, []), (None, "n/a ", []), (None, "", []), (None, None, [])]


def test_rows(spark):
    """Several bad columns in order; no text, no declared type and clashing names are left alone or refused."""
    df = spark.createDataFrame([("x", "x", " x ", 7, "u", "5"), ("2024-01-01", None, None, None, None, None)],
                               "d string, z string, s string, k int, `a.b` string, n string")
    got = coerce_declared(df, TYPES)
    assert got.columns == ["d", "z", "s", "k", "a.b", "n", "n_RAW", "_bad"]
    first, second = got.collect()
    assert first._bad == ["d", "z"] and (first.s, first.k, first["a.b"], first.n) == (" x ", 7, "u", 5)
    assert second._bad == [] and second.d is not None and second.z is None
    assert coerce_declared(df.limit(0), {}).columns == [*df.columns, "_bad"] and coerce_declared(df, {}).first()._bad == []
    try:
        coerce_declared(df.withColumnRenamed("s", "N_RAW"), TYPES)
    except ValueError:
        return
    raise AssertionError("a clash of names was not refused")
