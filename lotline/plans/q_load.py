"""Driver queries for sources, schema, dedup and the load path (A*, B*, C*)."""
from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions import coerce as C
from lotline.functions.keys import norm_name, norm_owner, norm_table
from lotline.operators import dedup, load
from lotline.operators.sink import append_parquet
from lotline.plans import duck
from lotline.plans.load_path import DEFAULT_BATCH, lines_report, load_report, loaded_rows, typed_rows
from lotline.plans.oracle_views import with_views
from lotline.plans.registry import register
from lotline.session import ensure_checkpoint_dir
from lotline.sources import catalog as CAT
from lotline.sources import views as V
from lotline.sources.tables import table

LINES = CAT.target_tables()["APP.ORDER_LINES"]
ORDERS_T = CAT.target_tables()["APP.ORDERS"]
ARR = ", ".join(V.ARRIVAL_MSG)
TTL_SECONDS = 86400          # B4 check: one day between accepted events of a key

# ---------------------------------------------------------------- DuckDB fragments
_DEC = """
SELECT m.*, json_extract_string(body, '$.Table') AS TABLE_RAW, json_extract_string(body, '$.Key') AS MSG_KEY,
       coalesce(json_extract(body, '$.Payload'), '{{}}'::JSON) AS P
FROM {src} m"""

_LINES_TYPED = f"""
dec AS ({_DEC.format(src='msg_lines')}),
typed AS (
  SELECT {ARR}, {duck.norm_table('TABLE_RAW')} AS TABLE_NAME, MSG_KEY,
         {duck.to_int(duck.pick('P', 'ORDER_ID'), 'BIGINT')} AS ORDER_ID,
         {duck.to_int(duck.pick('P', 'LINE_NO'), 'INTEGER')} AS LINE_NO,
         {duck.text(duck.pick('P', 'SKU'))} AS SKU,
         TRY_CAST({duck.text(duck.pick('P', 'QTY'))} AS DECIMAL(9,2)) AS QTY
  FROM dec),
kept AS (
  SELECT * FROM typed
  QUALIFY row_number() OVER (PARTITION BY ORDER_ID, LINE_NO ORDER BY {ARR}) = 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY TABLE_NAME ORDER BY {ARR}) AS ROW_NO FROM kept),
batched AS (SELECT *, (ROW_NO - 1) // {DEFAULT_BATCH} AS BATCH_ID FROM numbered)"""


def _lines_sql(tail: str) -> str:
    return with_views(f"WITH {_LINES_TYPED.strip()}\n{tail}", "msg_lines")


# ---------------------------------------------------------------- A: sources, schema

@register("a1_envelope_encode", with_views("SELECT arr_k1 AS ORDER_KEY, body FROM msg_orders", "msg_orders"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return V.msg_orders(spark, d).select(F.col("arr_k1").alias("ORDER_KEY"), "body")


@register("a2_envelope_decode", with_views(f"""
WITH dec AS ({_DEC.format(src='messages')})
SELECT {ARR}, {duck.norm_table('TABLE_RAW')} AS TABLE_NAME, MSG_KEY, len(json_keys(P)) AS N_FIELDS,
       array_to_string(list_sort(json_keys(P)), ',') AS FIELDS
FROM dec""", "messages"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    dec = load.good(load.decode_envelopes(V.messages(spark, d)))
    return dec.select(*V.ARRIVAL_MSG, "TABLE_NAME", "MSG_KEY", F.size("PAYLOAD").alias("N_FIELDS"),
                      F.array_join(F.array_sort(F.map_keys("PAYLOAD")), ",").alias("FIELDS"))


def flat_order_bodies(spark: SparkSession, d: str) -> DataFrame:
    """orders -> flat order messages; CustNo missing on status P, OrderTs null on every 9th key."""
    o = table(spark, d, "orders")
    ts = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.date_format("o_orderdate", V.ISO), F.lit("Z")))
    cust = F.when(F.col("o_orderstatus") != "P", F.format_string("C%04d", F.col("o_custkey")))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("Id"), cust.alias("CustNo"),
                              F.col("o_totalprice").alias("Amount"), ts.alias("OrderTs")))
    return o.select(F.col("o_orderkey").alias("SRC_ID"), body.alias("body"))


@register("a3_flat_order_decode", """
SELECT o_orderkey AS ID, printf('C%04d', o_custkey) AS CUST_NO,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS AMOUNT,
       CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS ORDER_TS
FROM orders WHERE o_orderstatus <> 'P'""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    f = load.flat_orders(flat_order_bodies(spark, d))
    return load.good(f).select(F.col("ID").cast("bigint").alias("ID"), "CUST_NO",
                               F.col("AMOUNT").cast("double").alias("AMOUNT"), "ORDER_TS")


@register("a5_synthetic_order_feed", """
SELECT i AS ID, printf('C%04d', i) AS CUST_NO, 1000 + i % 100 AS AMOUNT
FROM range(1, (SELECT count(*) FROM orders) + 1) t(i)""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    # the feed length follows the orders table (one scalar count reaches the driver)
    n = table(spark, d, "orders").count()
    r = spark.range(1, n + 1)
    return r.select(F.col("id").alias("ID"), F.format_string("C%04d", F.col("id")).alias("CUST_NO"),
                    (F.lit(1000) + F.col("id") % 100).alias("AMOUNT"))


_CAT_SQL = duck.catalog_values(
    CAT.COLUMNS, "owner, table_name, column_name, data_type, data_precision, data_scale, identity_column, "
                 "virtual_column, column_id")
_TYPE_SQL = """
CASE WHEN upper(trim(data_type)) = 'NUMBER' THEN
       CASE WHEN coalesce(data_scale, 0) > 0 THEN 'decimal(' || coalesce(data_precision, 38) || ',' || data_scale || ')'
            WHEN data_precision IS NULL OR data_precision = 0 THEN 'decimal(38,10)'
            WHEN data_precision <= 9 THEN 'int' WHEN data_precision <= 18 THEN 'bigint'
            ELSE 'decimal(' || data_precision || ',0)' END
     WHEN upper(trim(data_type)) = 'FLOAT' THEN 'double'
     WHEN upper(trim(data_type)) IN ('DATE', 'TIMESTAMP', 'TIMESTAMP(6)') THEN 'timestamp_ntz'
     WHEN upper(trim(data_type)) IN ('VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR', 'CLOB', 'NCLOB') THEN 'string'
     WHEN upper(trim(data_type)) IN ('BLOB', 'RAW') THEN 'binary'
     ELSE 'string' END"""


@register("a6_catalog_schema", with_views(f"""
WITH cat AS ({_CAT_SQL}),
sch AS (SELECT upper(owner) || '.' || upper(table_name) AS TABLE_NAME, upper(column_name) AS COLUMN_NAME,
               column_id AS COLUMN_ID, {_TYPE_SQL} AS SPARK_TYPE
        FROM cat WHERE coalesce(upper(identity_column), 'NO') = 'NO' AND coalesce(upper(virtual_column), 'NO') = 'NO'),
msg AS (SELECT {duck.norm_table("json_extract_string(body, '$.Table')")} AS TABLE_NAME, count(*) AS N_MESSAGES
        FROM messages GROUP BY 1)
SELECT s.*, coalesce(m.N_MESSAGES, 0) AS N_MESSAGES FROM sch s LEFT JOIN msg m USING (TABLE_NAME)""", "messages"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    sch = CAT.schema_frame(CAT.columns_meta(spark)).select(
        F.concat_ws(".", "owner", "table_name").alias("TABLE_NAME"), F.col("column_name").alias("COLUMN_NAME"),
        F.col("column_id").alias("COLUMN_ID"), F.col("spark_type").alias("SPARK_TYPE"))
    msg = load.decode_envelopes(V.messages(spark, d)).groupBy("TABLE_NAME").agg(
        F.count(F.lit(1)).alias("N_MESSAGES"))
    # the schema side is a few catalog rows: broadcast it, aggregate the messages first
    return msg.join(F.broadcast(sch), "TABLE_NAME", "right").select(
        "TABLE_NAME", "COLUMN_NAME", "COLUMN_ID", "SPARK_TYPE",
        F.coalesce("N_MESSAGES", F.lit(0)).alias("N_MESSAGES"))


_CONS_SQL = duck.catalog_values(CAT.CONSTRAINTS, "owner, constraint_name, table_name, constraint_type")
_CONSCOL_SQL = duck.catalog_values(CAT.CONS_COLUMNS, "owner, constraint_name, table_name, column_name, position")


@register("a7_primary_keys", _lines_sql(f"""
, cons AS ({_CONS_SQL}), cc AS ({_CONSCOL_SQL}),
pk AS (SELECT c.owner || '.' || c.table_name AS TABLE_NAME,
              string_agg(cc.column_name, ',' ORDER BY cc.position) AS PK_COLUMNS
       FROM cons c JOIN cc ON c.owner = cc.owner AND c.constraint_name = cc.constraint_name
                           AND c.table_name = cc.table_name
       WHERE c.constraint_type = 'P' GROUP BY 1)
SELECT pk.TABLE_NAME, PK_COLUMNS,
       CASE WHEN pk.TABLE_NAME = 'APP.ORDER_LINES' THEN (SELECT count(*) FROM kept) END AS N_DISTINCT_KEYS
FROM pk""").replace("WITH dec AS", "WITH dec AS", 1))
def a7(spark: SparkSession, d: str) -> DataFrame:
    pk = CAT.pk_frame(CAT.constraints_meta(spark), CAT.cons_columns_meta(spark)).select(
        F.concat_ws(".", "owner", "table_name").alias("TABLE_NAME"),
        F.array_join("pk_columns", ",").alias("PK_COLUMNS"))
    n = typed_rows(V.msg_lines(spark, d), LINES).select("ORDER_ID", "LINE_NO").distinct().agg(
        F.count(F.lit(1)).alias("N")).withColumn("TABLE_NAME", F.lit("APP.ORDER_LINES"))
    return pk.join(F.broadcast(n), "TABLE_NAME", "left").select(
        "TABLE_NAME", "PK_COLUMNS", F.col("N").alias("N_DISTINCT_KEYS"))


def raw_table_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = F.col("user_id") % 4
    raw = (F.when(m == 0, F.col("event_type"))
           .when(m == 1, F.concat(F.lit(" hr."), F.col("event_type"), F.lit(" ")))
           .when(m == 2, F.concat(F.lit("x."), F.col("event_type"), F.lit(".z")))
           .otherwise(F.concat(F.lit("\t"), F.upper("event_type"))))
    return e.select(raw.alias("RAW_NAME"))


@register("a8_table_names", f"""
WITH r AS (SELECT CASE user_id % 4 WHEN 0 THEN event_type WHEN 1 THEN ' hr.' || event_type || ' '
                       WHEN 2 THEN 'x.' || event_type || '.z' ELSE chr(9) || upper(event_type) END AS RAW_NAME
           FROM events)
SELECT RAW_NAME,
       upper(CASE WHEN contains(trim(RAW_NAME, ' \t\n\r'), '.') THEN split_part(trim(RAW_NAME, ' \t\n\r'), '.', 1)
                  ELSE 'APP' END) AS OWNER,
       upper(CASE WHEN contains(trim(RAW_NAME, ' \t\n\r'), '.')
                  THEN substr(trim(RAW_NAME, ' \t\n\r'), strpos(trim(RAW_NAME, ' \t\n\r'), '.') + 1)
                  ELSE trim(RAW_NAME, ' \t\n\r') END) AS NAME,
       count(*) AS N
FROM r GROUP BY ALL""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    r = raw_table_names(spark, d)
    return r.groupBy("RAW_NAME").agg(F.count(F.lit(1)).alias("N")).select(
        "RAW_NAME", norm_owner(F.col("RAW_NAME")).alias("OWNER"), norm_name(F.col("RAW_NAME")).alias("NAME"), "N")


@register("a9_project_columns", with_views(f"""
WITH dec AS ({_DEC.format(src='msg_lines')})
SELECT {ARR}, {duck.text(duck.pick('P', 'ORDER_ID'))} AS ORDER_ID, {duck.text(duck.pick('P', 'LINE_NO'))} AS LINE_NO,
       {duck.text(duck.pick('P', 'SKU'))} AS SKU, CAST({duck.pick('P', 'QTY')} AS DOUBLE) AS QTY,
       {duck.text(duck.pick('P', 'LOADED_AT'))} AS LOADED_AT
FROM dec""", "msg_lines"))
def a9(spark: SparkSession, d: str) -> DataFrame:
    dec = load.good(load.decode_envelopes(V.msg_lines(spark, d)))
    p = load.project_raw(dec, LINES, keep=V.ARRIVAL_MSG)
    # numbers render as values (JSON text formatting is not kept by VARIANT)
    return p.select(*V.ARRIVAL_MSG, *[
        (F.try_variant_get(F.col(c), "$", "double") if c == "QTY" else C.variant_text(F.col(c))).alias(c)
        for c, _ in LINES.columns])


def _guid_text(c):
    h = F.md5(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


@register("a10_lenient_coerce", """
WITH g AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
SELECT event_id AS EVENT_ID,
       CAST(json_extract(props, '$.k') AS INTEGER) AS K_INT,
       CAST(round_even(value, 0) AS INTEGER) AS VALUE_INT,
       CAST(TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(10,1)) AS DOUBLE) AS VALUE_DEC,
       TRY_CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS TIMESTAMP) AS TS,
       substr(h,7,2) || substr(h,5,2) || substr(h,3,2) || substr(h,1,2) || substr(h,11,2) || substr(h,9,2)
         || substr(h,15,2) || substr(h,13,2) || substr(h,17,16) AS GUID_HEX
FROM g""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    props = F.from_json("props", "map<string,variant>")
    value_v = F.parse_json(F.col("value").cast("string"))
    ts_v = F.parse_json(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))))
    guid_v = F.parse_json(F.to_json(F.struct(_guid_text(F.col("event_id").cast("string")).alias("g"))))
    return e.select(
        F.col("event_id").alias("EVENT_ID"),
        C.coerce_lenient(load.pick(props, "k"), "int").alias("K_INT"),
        C.coerce_lenient(value_v, "int").alias("VALUE_INT"),
        C.coerce_lenient(value_v, "decimal(10,1)").cast("double").alias("VALUE_DEC"),
        C.coerce_lenient(F.try_variant_get(ts_v, "$.t", "variant"), "timestamp_ntz").alias("TS"),
        F.lower(F.hex(C.coerce_lenient(F.try_variant_get(guid_v, "$.g", "variant"), "binary"))).alias("GUID_HEX"),
    )


def strict_texts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k4, k3 = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    dt_txt = (F.when(k4 == 0, F.concat(F.date_format("o_orderdate", V.ISO), F.lit(".678Z")))
              .when(k4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
              .when(k4 == 2, F.date_format("o_orderdate", "dd/MM/yyyy"))
              .otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" "))))
    num_txt = (F.when(k3 == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
               .when(k3 == 1, F.concat(F.lit("abc"), F.col("o_orderkey").cast("string")))
               .otherwise(F.col("o_totalprice").cast("string")))
    return o.select(F.col("o_orderkey").alias("ID"), dt_txt.alias("DT_TEXT"), num_txt.alias("NUM_TEXT"))


@register("a11_strict_coerce", """
WITH t AS (
  SELECT o_orderkey AS ID,
         CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.678Z'
              WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' ' END AS DT_TEXT,
         CASE o_orderkey % 3 WHEN 0 THEN ' ' || CAST(o_totalprice AS VARCHAR) || ' '
              WHEN 1 THEN 'abc' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS NUM_TEXT
  FROM orders),
s AS (SELECT *, trim(DT_TEXT) AS s1,
             replace(regexp_replace(trim(DT_TEXT), 'Z$', ''), 'T', ' ') AS s2 FROM t),
r AS (
  SELECT ID, NUM_TEXT,
         CASE WHEN contains(s1, 'T') THEN try_strptime(substr(replace(s1, 'T', ' '), 1, 19), '%Y-%m-%d %H:%M:%S')
              WHEN contains(s1, ' ') THEN try_strptime(s1, '%Y-%m-%d %H:%M:%S')
              ELSE try_strptime(s1, '%Y-%m-%d') END AS DT,
         coalesce(TRY_CAST(s2 AS TIMESTAMP), try_strptime(substr(s2, 1, 19), '%Y-%m-%d %H:%M:%S')) AS TS,
         TRY_CAST(trim(NUM_TEXT) AS DECIMAL(38,10)) AS NUM
  FROM s)
SELECT ID, DT, DT IS NULL AS DT_BAD, TS, CAST(NUM AS DOUBLE) AS NUM,
       CASE WHEN NUM IS NULL THEN NUM_TEXT END AS NUM_RAW
FROM r""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    t = strict_texts(spark, d)
    num, raw = C.keep_raw_number(F.col("NUM_TEXT"))
    dt_ = C.strict_date(F.col("DT_TEXT"))
    return t.select("ID", dt_.alias("DT"), dt_.isNull().alias("DT_BAD"),
                    C.strict_timestamp(F.col("DT_TEXT")).alias("TS"), num.cast("double").alias("NUM"),
                    raw.alias("NUM_RAW"))


#: Declared types of the text columns below, as a catalog lists them.
TEXT_TYPES = {"O_DATE": "DATE", "O_TS": "TIMESTAMP(6)", "O_TSZ": "TIMESTAMP WITH TIME ZONE", "O_NUM": "NUMBER",
              "O_NAME": "VARCHAR2", "O_KEY": "NUMBER"}


@register("a11_declared_types", """
WITH t AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock, o_totalprice AS price
  FROM orders),
r AS (
  SELECT k,
         CASE k % 4 WHEN 0 THEN day || 'T' || clock || '.5' WHEN 1 THEN day WHEN 2 THEN replace(day, '-', '/') END AS d,
         CASE k % 3 WHEN 0 THEN day || 'T' || clock || '.25Z' WHEN 1 THEN day || ' ' || clock ELSE 'soon' END AS ts,
         CASE k % 5 WHEN 0 THEN day || 'T' || clock || '+05:30' WHEN 1 THEN day || 'T' || clock || '.125Z'
              WHEN 2 THEN day || ' ' || clock || '-08:00' WHEN 3 THEN day ELSE day || 'T25:00:00Z' END AS tz,
         CASE k % 3 WHEN 0 THEN '	' || CAST(price AS VARCHAR) || ' ' WHEN 1 THEN 'n/a ' END AS num
  FROM t),
v AS (
  SELECT *, CASE k % 4 WHEN 0 THEN try_strptime(replace(substr(d, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')
                 WHEN 1 THEN try_strptime(d, '%Y-%m-%d') END AS d_v,
         TRY_CAST(replace(ts, 'Z', '') AS TIMESTAMP) AS ts_v,
         epoch_us(CASE k % 5 WHEN 0 THEN CAST(substr(tz, 1, 19) AS TIMESTAMP) - INTERVAL 330 MINUTE
                       WHEN 1 THEN CAST(replace(tz, 'Z', '') AS TIMESTAMP)
                       WHEN 2 THEN CAST(substr(tz, 1, 19) AS TIMESTAMP) + INTERVAL 8 HOUR
                       WHEN 3 THEN CAST(tz AS TIMESTAMP) END) AS tz_v,
         TRY_CAST(trim(num, ' 	') AS DECIMAL(38,10)) AS num_v
  FROM r)
SELECT k AS O_KEY, d_v AS O_DATE, ts_v AS O_TS, tz_v AS O_TSZ_MICROS, CAST(num_v AS DOUBLE) AS O_NUM,
       CASE WHEN num_v IS NULL THEN num END AS O_NUM_RAW, 'order ' || CAST(k AS VARCHAR) AS O_NAME,
       concat_ws(',', CASE WHEN d IS NOT NULL AND d_v IS NULL THEN 'O_DATE' END,
                 CASE WHEN ts_v IS NULL THEN 'O_TS' END, CASE WHEN tz_v IS NULL THEN 'O_TSZ' END) AS BAD
FROM v""")
def a11_declared(spark: SparkSession, d: str) -> DataFrame:
    """Rows of texts through the strict row operator; the array of bad columns comma-joined."""
    k, day, at = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "HH:mm:ss")
    iso = F.concat(day, F.lit("T"), at)
    rows = table(spark, d, "orders").select(
        k.alias("O_KEY"),
        F.when(k % 4 == 0, F.concat(iso, F.lit(".5"))).when(k % 4 == 1, day).when(k % 4 == 2, F.replace(day, F.lit("-"), F.lit("/"))).alias("O_DATE"),
        F.when(k % 3 == 0, F.concat(iso, F.lit(".25Z"))).when(k % 3 == 1, F.concat_ws(" ", day, at)).otherwise("soon").alias("O_TS"),
        F.when(k % 5 == 0, F.concat(iso, F.lit("+05:30"))).when(k % 5 == 1, F.concat(iso, F.lit(".125Z")))
        .when(k % 5 == 2, F.concat(F.concat_ws(" ", day, at), F.lit("-08:00"))).when(k % 5 == 3, day)
        .otherwise(F.concat(day, F.lit("T25:00:00Z"))).alias("O_TSZ"),
        F.when(k % 3 == 0, F.concat(F.lit("\t"), F.col("o_totalprice").cast("string"), F.lit(" "))).when(k % 3 == 1, "n/a ").alias("O_NUM"),
        F.concat(F.lit("order "), k.cast("string")).alias("O_NAME"))
    typed = C.coerce_declared(rows, TEXT_TYPES)
    return typed.select("O_KEY", "O_DATE", "O_TS", F.unix_micros("O_TSZ").alias("O_TSZ_MICROS"), F.col("O_NUM").cast("double").alias("O_NUM"),
                        "O_NUM_RAW", "O_NAME", F.concat_ws(",", "_bad").alias("BAD"))


@register("a12_fixed_projection", """
SELECT 'C' || CAST(o_custkey AS VARCHAR) AS SRC_NAME, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS AMOUNT,
       o_orderdate AS CREATED_AT, o_orderkey AS ORDER_KEY
FROM orders""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("SRC_NAME"),
                    F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("AMOUNT"),
                    F.col("o_orderdate").alias("CREATED_AT"), F.col("o_orderkey").alias("ORDER_KEY"))


# ---------------------------------------------------------------- B: dedup

@register("b1_canonical_key", _lines_sql(f"""
SELECT {ARR}, coalesce(CAST(ORDER_ID AS VARCHAR), '<NULL>') || '|' || coalesce(CAST(LINE_NO AS VARCHAR), '<NULL>')
       || '|' || coalesce(upper(trim(SKU, ' \t\n\r')), '<NULL>') AS DEDUP_KEY
FROM typed"""))
def b1(spark: SparkSession, d: str) -> DataFrame:
    rows = typed_rows(V.msg_lines(spark, d), LINES)
    k = dedup.with_key(rows, ["ORDER_ID", "LINE_NO", "SKU"])
    return k.select(*V.ARRIVAL_MSG, "DEDUP_KEY")


@register("b2_dedup_batch", _lines_sql(f"""
, chunked AS (SELECT *, (row_number() OVER (ORDER BY {ARR}) - 1) // {DEFAULT_BATCH} AS IN_BATCH FROM typed)
SELECT IN_BATCH, {ARR}, ORDER_ID, LINE_NO
FROM chunked
QUALIFY row_number() OVER (PARTITION BY IN_BATCH, ORDER_ID, LINE_NO ORDER BY {ARR}) = 1"""))
def b2(spark: SparkSession, d: str) -> DataFrame:
    messages = V.msg_lines(spark, d)
    tasks = frames.slices_for(messages)
    rows = typed_rows(messages, LINES).select(*V.ARRIVAL_MSG, "ORDER_ID", "LINE_NO")
    chunked = load.batch_ids(rows, V.ARRIVAL_MSG, DEFAULT_BATCH, group=(), name="IN_BATCH", partitions=tasks)
    kept = dedup.dedup_batch(chunked, ["ORDER_ID", "LINE_NO"], V.ARRIVAL_MSG, batch="IN_BATCH", partitions=tasks)
    return kept.select("IN_BATCH", *V.ARRIVAL_MSG, "ORDER_ID", "LINE_NO")


@register("b3_dedup_lifetime", _lines_sql(f"""
SELECT {ARR}, ORDER_ID, LINE_NO, SKU, CAST(QTY AS DOUBLE) AS QTY FROM kept"""))
def b3(spark: SparkSession, d: str) -> DataFrame:
    rows = typed_rows(V.msg_lines(spark, d), LINES)
    kept = dedup.dedup_lifetime(rows, list(LINES.pk), V.ARRIVAL_MSG)
    return kept.select(*V.ARRIVAL_MSG, "ORDER_ID", "LINE_NO", "SKU", F.col("QTY").cast("double").alias("QTY"))


@register("b4_dedup_ttl", f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, ts, event_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
nxt AS (
  SELECT a.user_id, a.event_type, a.rn, min(b.rn) AS nrn
  FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type
                         AND b.ts > a.ts + INTERVAL {TTL_SECONDS} SECOND
  GROUP BY ALL),
chain AS (
  SELECT user_id, event_type, rn FROM e WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.event_type, n.nrn FROM chain c
  JOIN nxt n ON n.user_id = c.user_id AND n.event_type = c.event_type AND n.rn = c.rn
  WHERE n.nrn IS NOT NULL)
SELECT e.event_id AS EVENT_ID, e.user_id AS USER_ID, e.event_type AS EVENT_TYPE, e.ts AS TS
FROM e JOIN chain USING (user_id, event_type, rn)""")
def b4(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    kept = dedup.dedup_ttl(e, ["user_id", "event_type"], "ts", ["event_id"], TTL_SECONDS)
    return kept.select(F.col("event_id").alias("EVENT_ID"), F.col("user_id").alias("USER_ID"),
                       F.col("event_type").alias("EVENT_TYPE"), F.col("ts").alias("TS"))


@register("b5_dedup_message_key", with_views(f"""
WITH dec AS ({_DEC.format(src='msg_orders')})
SELECT arr_k1 AS ORDER_KEY, MSG_KEY FROM dec WHERE MSG_KEY IS NULL OR MSG_KEY = ''
UNION ALL
SELECT arr_k1, MSG_KEY FROM dec WHERE MSG_KEY <> ''
QUALIFY row_number() OVER (PARTITION BY MSG_KEY ORDER BY {ARR}) = 1""", "msg_orders"))
def b5(spark: SparkSession, d: str) -> DataFrame:
    dec = load.good(load.decode_envelopes(V.msg_orders(spark, d))).select(*V.ARRIVAL_MSG, "MSG_KEY", "PAYLOAD")
    kept = dedup.dedup_message_key(dec, "MSG_KEY", V.ARRIVAL_MSG)
    return kept.select(F.col("arr_k1").alias("ORDER_KEY"), "MSG_KEY")


@register("b6_require_key", with_views(f"""
WITH dec AS ({_DEC.format(src='msg_orders')})
SELECT arr_k1 AS ORDER_KEY, 'key required' AS REASON FROM dec WHERE MSG_KEY IS NULL OR trim(MSG_KEY) = ''""",
                                       "msg_orders"))
def b6(spark: SparkSession, d: str) -> DataFrame:
    dec = load.good(load.decode_envelopes(V.msg_orders(spark, d)))
    r = dedup.require_key(dec, "MSG_KEY")
    return r.where(F.col("_reason").isNotNull()).select(F.col("arr_k1").alias("ORDER_KEY"),
                                                         F.col("_reason").alias("REASON"))


# ---------------------------------------------------------------- C: batching, sinks, errors

@register("c1_fixed_batches", _lines_sql("""
SELECT TABLE_NAME, ORDER_ID, LINE_NO, ROW_NO, BATCH_ID FROM batched"""))
def c1(spark: SparkSession, d: str) -> DataFrame:
    rows = loaded_rows(V.msg_lines(spark, d), LINES)
    return rows.select("TABLE_NAME", "ORDER_ID", "LINE_NO", "ROW_NO", "BATCH_ID")


C2_INTERVAL, C2_SIZE = "1 day", 100


@register("c2_time_size_batches", f"""
WITH b AS (SELECT *, date_trunc('day', ts) AS BUCKET_START FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY BUCKET_START ORDER BY ts, event_id) AS ROW_NO FROM b)
SELECT BUCKET_START, (ROW_NO - 1) // {C2_SIZE} AS BATCH_ID, count(*) AS N_ROWS, min(event_id) AS FIRST_EVENT,
       max(event_id) AS LAST_EVENT
FROM n GROUP BY ALL""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    b = load.time_size_batches(e, "ts", ["ts", "event_id"], C2_INTERVAL, C2_SIZE)
    return b.groupBy("BUCKET_START", "BATCH_ID").agg(
        F.count(F.lit(1)).alias("N_ROWS"), F.min("event_id").alias("FIRST_EVENT"),
        F.max("event_id").alias("LAST_EVENT"))


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    """events -> envelopes for a table the catalog does not know (app.events)."""
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.lit("app.events").alias("Table"), F.col("event_id").cast("string").alias("Key"),
                              F.struct(F.col("event_type").alias("TYPE")).alias("Payload")))
    return e.select(F.col("ts").alias("arr_ts"), F.lit(2).alias("arr_src"), F.col("event_id").alias("arr_k1"),
                    *[F.lit(0).cast("bigint").alias(f"arr_k{i}") for i in (2, 3, 4)], body.alias("body"))


@register("c3_route_tables", with_views(f"""
WITH t AS (SELECT {duck.norm_table("json_extract_string(body, '$.Table')")} AS TABLE_NAME FROM messages
           UNION ALL SELECT 'APP.EVENTS' FROM events)
SELECT TABLE_NAME, TABLE_NAME IN ('APP.ORDERS', 'APP.ORDER_LINES', 'APP.TYPE_DEMO') AS KNOWN, count(*) AS N_ROWS
FROM t GROUP BY ALL""", "messages"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    msgs = V.messages(spark, d).unionByName(event_messages(spark, d))
    dec = load.good(load.decode_envelopes(msgs))
    known = list(CAT.target_tables())
    return dec.groupBy("TABLE_NAME").agg(F.count(F.lit(1)).alias("N_ROWS")).select(
        "TABLE_NAME", F.col("TABLE_NAME").isin(*known).alias("KNOWN"), "N_ROWS")


@register("c4_bulk_append", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem""")
def c4(spark: SparkSession, d: str) -> DataFrame:
    base = ensure_checkpoint_dir(spark)
    out = os.path.join(base, f"lotline-append-{uuid.uuid4().hex}")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    append_parquet(li, out)
    return spark.read.parquet(out)


def dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    """msg_orders with broken envelopes mixed in (truncated, non-object, no Table, bad Payload)."""
    m = V.msg_orders(spark, d)
    k = F.col("arr_k1")
    ks = k.cast("string")
    body = (F.when(k % 7 == 3, F.concat(F.lit('{"Table":"APP.ORDERS","Key":"'), ks, F.lit('"')))
            .when(k % 7 == 4, F.lit("[1,2]"))
            .when(k % 7 == 5, F.concat(F.lit('{"Key":"'), ks, F.lit('","Payload":{"ORDER_ID":'), ks, F.lit("}}")))
            .when(k % 7 == 6, F.concat(F.lit('{"Table":"APP.ORDERS","Key":"'), ks, F.lit('","Payload":"oops"}')))
            .otherwise(F.col("body")))
    return m.withColumn("body", body)


#: The same in DuckDB: every order message with its reason, null for good ones.
DIRTY_SQL = """
dirty AS (
  SELECT * REPLACE (
         CASE arr_k1 % 7 WHEN 3 THEN '{"Table":"APP.ORDERS","Key":"' || arr_k1 || '"'
              WHEN 4 THEN '[1,2]'
              WHEN 5 THEN '{"Key":"' || arr_k1 || '","Payload":{"ORDER_ID":' || arr_k1 || '}}'
              WHEN 6 THEN '{"Table":"APP.ORDERS","Key":"' || arr_k1 || '","Payload":"oops"}'
              ELSE body END AS body)
  FROM msg_orders),
judged AS (
  SELECT *, CASE WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'not a json object'
                 WHEN json_extract_string(body, '$.Table') IS NULL THEN 'missing table'
                 WHEN json_type(body, '$.Payload') NOT IN ('OBJECT', 'NULL') THEN 'payload not an object' END AS REASON
  FROM dirty)"""


@register("c6_dead_letters", with_views(f"""
WITH {DIRTY_SQL.strip()}
SELECT arr_k1 AS ORDER_KEY, body AS RAW, REASON FROM judged WHERE REASON IS NOT NULL""", "msg_orders"))
def c6(spark: SparkSession, d: str) -> DataFrame:
    dec = load.decode_envelopes(dirty_orders(spark, d))
    return load.rejected(dec).select(F.col("arr_k1").alias("ORDER_KEY"), F.col("body").alias("RAW"),
                                     F.col("_reason").alias("REASON"))


@register("c7_row_errors", """
WITH t AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
                  TRY_CAST(value AS DECIMAL(4,2)) AS v, event_type FROM events)
SELECT event_id AS EVENT_ID,
       CASE WHEN k IS NULL THEN 'error' WHEN v IS NULL THEN 'error'
            WHEN event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'error' ELSE 'ok' END AS STATUS,
       CASE WHEN k IS NULL THEN 'not null: K' WHEN v IS NULL THEN 'overflow: VALUE'
            WHEN event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'check: EVENT_TYPE' END AS REASON
FROM t""")
def c7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value").try_cast("decimal(4,2)").alias("v"), "event_type")
    r = load.validate_rows(e, [
        ("not null: K", F.col("k").isNull()),
        ("overflow: VALUE", F.col("v").isNull()),
        ("check: EVENT_TYPE", ~F.col("event_type").isin("signup", "purchase", "view", "click")),
    ])
    return r.select(F.col("event_id").alias("EVENT_ID"),
                    F.when(F.col("_reason").isNull(), "ok").otherwise("error").alias("STATUS"),
                    F.col("_reason").alias("REASON"))


@register("c8_load_lines_report", _lines_sql("""
SELECT TABLE_NAME, BATCH_ID, count(*) AS N_ROWS, min(ROW_NO) AS FIRST_ROW, max(ROW_NO) AS LAST_ROW,
       CAST(sum(QTY) AS DOUBLE) AS SUM_QTY, count(DISTINCT ORDER_ID) AS N_ORDERS
FROM batched GROUP BY ALL"""))
def c8(spark: SparkSession, d: str) -> DataFrame:
    r = lines_report(V.msg_lines(spark, d))
    return r.withColumn("SUM_QTY", F.col("SUM_QTY").cast("double"))


_ORDERS_TYPED = f"""
odec AS ({_DEC.format(src='msg_orders')}),
otyped AS (SELECT {ARR}, {duck.norm_table('TABLE_RAW')} AS TABLE_NAME,
                  {duck.to_int(duck.pick('P', 'ORDER_ID'), 'BIGINT')} AS ORDER_ID FROM odec),
okept AS (SELECT * FROM otyped QUALIFY row_number() OVER (PARTITION BY ORDER_ID ORDER BY {ARR}) = 1),
onumbered AS (SELECT *, row_number() OVER (PARTITION BY TABLE_NAME ORDER BY {ARR}) AS ROW_NO FROM okept)"""


@register("c8_load_all_report", with_views(f"""
WITH {_LINES_TYPED.strip()},
{_ORDERS_TYPED.strip()},
every AS (SELECT TABLE_NAME, ROW_NO, BATCH_ID FROM batched
          UNION ALL SELECT TABLE_NAME, ROW_NO, (ROW_NO - 1) // {DEFAULT_BATCH} FROM onumbered)
SELECT TABLE_NAME, BATCH_ID, count(*) AS N_ROWS, min(ROW_NO) AS FIRST_ROW, max(ROW_NO) AS LAST_ROW
FROM every GROUP BY ALL""", "msg_lines", "msg_orders"))
def c8_all(spark: SparkSession, d: str) -> DataFrame:
    """Both known tables through the same decode (orders dedup on ORDER_ID)."""
    return load_report(V.messages(spark, d))
