"""Load path operators: decode, project, coerce, batch, route, report.

Inventory A2, A3, A9, A10, A12, C1, C2, C3, C6, C7, C8.  The message payload is
kept as ``map<string, variant>`` so that JSON numbers and JSON strings stay
distinguishable for the coercion rules.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions import coerce as C
from lotline.functions.keys import norm_table, strip_ws
from lotline.sources.catalog import TargetTable

# Fixed reason texts for rows that leave the main flow.
R_NOT_JSON = "not a json object"
R_NO_TABLE = "missing table"
R_PAYLOAD = "payload not an object"
R_UNKNOWN_TABLE = "unknown table"


ENVELOPE_SCHEMA = "Table string, Key string, Payload map<string,variant>, Ts string, _corrupt string"
_ENV_COLS = ("_e_table", "_e_key", "_e_payload", "_e_ts", "_e_corrupt")


def _one_value(b: Column) -> Column:
    """Whether the text is one JSON value and nothing behind it (the parsers stop behind the first value).

    A bracket that closes nothing would end a surrounding array or object early,
    so text with a square one behind the value must stand inside an object, too.
    """
    alone = F.json_array_length(F.concat(F.lit("["), b, F.lit("]"))) == 1
    inside = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), b, F.lit("}")))) == 1
    return F.coalesce(alone & (~b.contains("]") | inside), F.lit(False))


def decode_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """A2: JSON envelope -> TABLE_RAW, TABLE_NAME, MSG_KEY, PAYLOAD (map<string,variant>), MSG_TS, _reason.

    A body that is not one JSON object from end to end, a missing or blank Table
    or a Payload that is not an object gives a reason (the row leaves the main
    flow); a missing or null Payload is an empty object.

    The body is parsed exactly once per row on the common path: ``from_json``
    reads the payload straight into ``map<string,variant>`` (JSON numbers and
    strings stay distinct for coercion) and a one-element ``inline`` turns
    the struct into columns.  The Generate also keeps the optimizer from
    pushing the reason filter below the parse, which would re-evaluate it per
    reference.  Only rows the parser flags as corrupt are looked at again, to
    tell broken JSON from a payload that is not an object.
    """
    b = F.col(body)
    env = F.from_json(b, ENVELOPE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})
    x = df.select("*", F.inline(F.array(env)).alias(*_ENV_COLS))
    corrupt = F.col("_e_corrupt").isNotNull()
    reason = (F.when(~_one_value(b), F.lit(R_NOT_JSON))
              .when(corrupt & (F.try_parse_json(b).isNull() | ~b.rlike(r"^\s*\{")), F.lit(R_NOT_JSON))
              .when(F.coalesce(strip_ws(F.col("_e_table")), F.lit("")) == "", F.lit(R_NO_TABLE))
              .when(corrupt, F.lit(R_PAYLOAD)))
    payload = F.coalesce(F.col("_e_payload"), F.create_map().cast("map<string,variant>"))
    return x.select(
        *[F.col(c) for c in df.columns],
        F.col("_e_table").alias("TABLE_RAW"), norm_table(F.col("_e_table")).alias("TABLE_NAME"),
        F.col("_e_key").alias("MSG_KEY"), payload.alias("PAYLOAD"), F.col("_e_ts").alias("MSG_TS"),
        reason.alias("_reason"),
    )


def good(df: DataFrame) -> DataFrame:
    return df.where(F.col("_reason").isNull()).drop("_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("_reason").isNotNull())


def pick(payload: Column, name: str) -> Column:
    """A9 field lookup, ignoring case: of repeated keys the last wins, as in a loop of assignments; else NULL."""
    up = name.upper()
    return F.try_element_at(F.map_values(F.map_filter(payload, lambda k, _: F.upper(k) == F.lit(up))), F.lit(-1))


def _fields(df: DataFrame, payload: str, name: str) -> DataFrame:
    """``df`` with the payload's names in upper case and its values (a struct ``name``), the last one first: for :func:`_field`."""
    m = F.col(payload)
    return df.withColumn(name, F.struct(F.reverse(F.transform(F.map_keys(m), F.upper)).alias("names"), F.reverse(F.map_values(m)).alias("values")))


def _field(fields: str, name: str) -> Column:
    """:func:`pick` over :func:`_fields`, which upper-cases the names once for all columns."""
    return F.get(F.col(fields)["values"], (F.array_position(F.col(fields)["names"], name.upper()) - 1).cast("int"))


def project_raw(df: DataFrame, target: TargetTable, payload: str = "PAYLOAD", keep: Sequence[str] = ()) -> DataFrame:
    """Payload -> one VARIANT column per target column; extra keys dropped."""
    return _fields(df, payload, "_fields").select(*keep, *[_field("_fields", c).alias(c) for c, _ in target.columns])


def coerce_columns(df: DataFrame, target: TargetTable, keep: Sequence[str] = ()) -> DataFrame:
    """A10: VARIANT columns -> target types, NULL on failure."""
    return df.select(*keep, *[C.coerce_lenient(F.col(c), t).alias(c) for c, t in target.columns])


def load_table(messages: DataFrame, target: TargetTable, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded messages of one table -> typed rows (A9 + A10)."""
    rows = messages.where(F.col("TABLE_NAME") == target.full_name)
    keep = ["TABLE_NAME", "MSG_KEY", *keep]
    return coerce_columns(project_raw(rows, target, keep=keep), target, keep=keep)


def load_tables(messages: DataFrame, targets: Sequence[TargetTable], keep: Sequence[str] = ()) -> DataFrame:
    """Decoded messages of several tables -> typed rows (A9 + A10) in one pass.

    A row has TABLE_NAME, MSG_KEY, the columns ``keep`` and a struct per table, named
    like the table, with its typed columns; the structs of other tables are null.
    """
    keep = ["TABLE_NAME", "MSG_KEY", *keep]
    rows = messages.where(F.col("TABLE_NAME").isin(*[t.full_name for t in targets]))
    mine = lambda t, fields: F.when(F.col("TABLE_NAME") == t.full_name, F.struct(*fields)).alias(t.full_name)
    raw = rows.select(*keep, *[mine(t, [pick(F.col("PAYLOAD"), c).alias(c) for c, _ in t.columns]) for t in targets])
    field = lambda t, c: F.col(f"`{t.full_name}`")[c]
    return raw.select(*keep, *[mine(t, [C.coerce_lenient(field(t, c), kind).alias(c) for c, kind in t.columns]) for t in targets])


def unknown_tables(messages: DataFrame, known: Sequence[str]) -> DataFrame:
    """Rows whose table is not in the catalog (a small list, so an IN filter)."""
    return messages.where(~F.col("TABLE_NAME").isin(*known)).withColumn("_reason", F.lit(R_UNKNOWN_TABLE))


def batch_ids(df: DataFrame, arrival: Sequence[str], size: int = 5000, group: Sequence[str] = ("TABLE_NAME",),
              name: str = "BATCH_ID", partitions: int | None = None) -> DataFrame:
    """Fixed-size batches per table in arrival order; the last batch may be partial.

    The row number comes from the range-partitioned two-pass helper, so one huge
    table is numbered by all tasks instead of one; ``partitions`` is the number of its slices.
    """
    n = frames.row_number_by(df, list(group), list(arrival), "_rn", partitions)
    return n.withColumn(name, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")).withColumnRenamed("_rn", "ROW_NO")


def batch_report(df: DataFrame, group: Sequence[str] = ("TABLE_NAME", "BATCH_ID"), extra: Sequence[Column] = ()) -> DataFrame:
    """Rows per table and batch with the first and last row number."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("N_ROWS"), F.min("ROW_NO").alias("FIRST_ROW"), F.max("ROW_NO").alias("LAST_ROW"),
        *extra)


def time_size_batches(df: DataFrame, ts: str, arrival: Sequence[str], interval: str, size: int) -> DataFrame:
    """C2 (batch form): a batch closes when it is full or when its time bucket ends.

    Rows fall in ``window(ts, interval)`` buckets; inside a bucket C1 applies.
    """
    b = df.withColumn("BUCKET_START", F.window(F.col(ts), interval).start.cast("timestamp_ntz"))
    return batch_ids(b, arrival, size, group=("BUCKET_START",))


def flat_orders(df: DataFrame, body: str = "body") -> DataFrame:
    """A3: ``{Id, CustNo, Amount, OrderTs}`` -> typed row; Id and CustNo are required."""
    v = F.try_parse_json(F.col(body))
    id_v = F.try_variant_get(v, "$.Id", "variant")
    cust = F.try_variant_get(v, "$.CustNo", "string")
    amount = F.try_variant_get(v, "$.Amount", "string").try_cast("decimal(18,2)")
    ts_txt = F.try_variant_get(v, "$.OrderTs", "string")
    reason = (F.when(v.isNull(), F.lit(R_NOT_JSON))
              .when(id_v.isNull(), F.lit("missing Id"))
              .when(cust.isNull(), F.lit("missing CustNo")))
    return df.select(
        "*", C.coerce_lenient(id_v, "int").alias("ID"), cust.alias("CUST_NO"), amount.alias("AMOUNT"),
        C.strict_timestamp(ts_txt).alias("ORDER_TS"), reason.alias("_reason"))


def validate_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """First failing rule names the reason; valid rows have a NULL reason."""
    reason = None
    for text, failed in rules:
        reason = F.when(failed, F.lit(text)) if reason is None else reason.when(failed, F.lit(text))
    return df.withColumn("_reason", reason if reason is not None else F.lit(None).cast("string"))
