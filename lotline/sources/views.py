"""Fixture views over the driver tables (FIXTURES.md part 2).

Each view is a lazy DataFrame derived from the parquet tables, so its size
grows with the scale factor.  Arrival orders are carried as explicit columns
(``ARRIVAL_*`` lists below); every first-wins rule orders by them.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.calendar import add_hours, add_seconds, ntz
from lotline.sources.tables import table

ISO = "yyyy-MM-dd'T'HH:mm:ss"
NOW = dt.datetime(2001, 9, 1)          # "now" for lot factors (after the last order date)

ARRIVAL_MSG = ["arr_ts", "arr_src", "arr_k1", "arr_k2", "arr_k3", "arr_k4"]
ARRIVAL_STATE = ["TS", "EVENT_ID"]
ARRIVAL_LOTS = ["ARRIVAL", "LOT_ID"]
ARRIVAL_MOVES = ["START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4"]


def _iso(c: str):
    return F.date_format(F.col(c), ISO)


def msg_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders -> JSON envelopes for APP.ORDERS; every 10th key is blank."""
    o = table(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 10 == 0, F.lit("")).otherwise(F.col("o_orderkey").cast("string"))
    payload = F.struct(
        F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("CUST_ID"),
        _iso("o_orderdate").alias("ORDER_DT"), F.col("o_totalprice").alias("TOTAL"),
    )
    body = F.to_json(F.struct(F.lit("APP.ORDERS").alias("Table"), key.alias("Key"),
                              payload.alias("Payload"), _iso("o_orderdate").alias("Ts")))
    return o.select(
        F.col("o_orderdate").alias("arr_ts"), F.lit(0).alias("arr_src"), F.col("o_orderkey").alias("arr_k1"),
        F.lit(0).cast("bigint").alias("arr_k2"), F.lit(0).cast("bigint").alias("arr_k3"),
        F.lit(0).cast("bigint").alias("arr_k4"), body.alias("body"),
    )


def msg_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> envelopes for app.order_lines (mixed-case payload keys, one extra key)."""
    li = table(spark, d, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("|"), F.col("l_linenumber").cast("string"))
    payload = F.struct(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("Line_No"),
        F.col("l_partkey").alias("SKU"), F.col("l_quantity").alias("QTY"), F.col("l_returnflag").alias("EXTRA"),
    )
    body = F.to_json(F.struct(F.lit("app.order_lines").alias("Table"), key.alias("Key"),
                              payload.alias("Payload"), _iso("l_shipdate").alias("Ts")))
    return li.select(
        F.col("l_shipdate").alias("arr_ts"), F.lit(1).alias("arr_src"), F.col("l_partkey").alias("arr_k1"),
        F.col("l_suppkey").alias("arr_k2"), F.col("l_orderkey").alias("arr_k3"),
        F.col("l_linenumber").cast("bigint").alias("arr_k4"), body.alias("body"),
    )


def msg_types(spark: SparkSession, d: str) -> DataFrame:
    """part -> envelopes for a table without a key (App.Type_Demo), all message keys null."""
    p = table(spark, d, "part")
    payload = F.struct(F.col("p_size").alias("N9"), F.col("p_partkey").alias("n10"), F.col("p_retailprice").alias("NN"),
                       F.col("p_retailprice").alias("F"), F.col("p_name").alias("c"))
    body = F.to_json(F.struct(F.lit(" App.Type_Demo").alias("Table"), payload.alias("Payload")))
    return p.select(add_hours(ntz(dt.datetime(1995, 1, 1)), F.col("p_partkey") % 50000).alias("arr_ts"), F.lit(3).alias("arr_src"),
                    F.col("p_partkey").cast("bigint").alias("arr_k1"),
                    *[F.lit(0).cast("bigint").alias(f"arr_k{i}") for i in (2, 3, 4)], body.alias("body"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return msg_orders(spark, d).unionByName(msg_lines(spark, d))


def _k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def state_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = (F.when(F.col("event_type") == "signup", "SETUP")
             .when(F.col("event_type") == "purchase", "BUSY")
             .when(F.col("event_type") == "view", "IDLE_RUN")
             .when(F.col("event_type") == "click", "IDLE")
             .when(F.col("event_type") == "error", F.when(_k() < 50, "PM").otherwise("DOWN")))
    return e.select(F.col("user_id").alias("EQP_ID"), F.col("ts").alias("TS"),
                    F.col("event_id").alias("EVENT_ID"), state.alias("STATE"))


def state_log(spark: SparkSession, d: str) -> DataFrame:
    """Equipment state intervals [TS, END_TS); the last one ends at max(ts) of all rows."""
    ev = state_events(spark, d)
    nxt = frames.neighbour(ev, ["EQP_ID"], ARRIVAL_STATE, ["TS"], 1, "next_")
    last = ev.agg(F.max("TS").alias("_max_ts"))
    return (nxt.crossJoin(F.broadcast(last))  # one-row aggregate
            .select("EQP_ID", "TS", "EVENT_ID", "STATE",
                    F.coalesce(F.col("next_TS"), F.col("_max_ts")).alias("END_TS")))


def lots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("LOT_ID"), (F.col("o_custkey") % 20).alias("EQP_ID"),
        F.col("o_orderpriority").alias("STEP_ID"), F.col("o_custkey").alias("GROUP_ID"),
        F.col("o_orderdate").alias("ARRIVAL"),
        F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate")).alias("DUE"),
        (F.lit(1) + F.col("o_orderkey") % 25).alias("QTY"),
        (F.col("o_orderpriority") == "1-URGENT").alias("HOT"),
    )


def factor_lots(spark: SparkSession, d: str) -> DataFrame:
    """lots with the columns that the weight factors read."""
    k = F.col("LOT_ID")
    seq = 1 + k % 50
    return lots(spark, d).select(
        "LOT_ID", "EQP_ID", "STEP_ID", "GROUP_ID", "ARRIVAL", F.timestamp_add("DAY", -(k % 100).cast("int"), F.col("ARRIVAL")).alias("CREATED"),
        "DUE", "QTY", (k % 7).alias("PART_ID"), F.concat(F.lit("L"), (k % 4).cast("string")).alias("LAYER_ID"),
        F.concat(F.lit("R"), (k % 5).cast("string")).alias("RECIPE_ID"), (F.floor(k / 7) % 3).alias("STACK_ID"), seq.alias("STEP_SEQ"),
        F.lit(50).alias("N_STEPS"), ((51 - seq) * 2.0).alias("REMAIN_HOURS"), (24.0 * (30 + k % 60)).alias("Q_LIMIT_HOURS"))


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per equipment the part, recipe and stack of its last move."""
    row = F.struct((F.col("PART_ID") % 7).alias("p"), F.concat(F.lit("R"), (F.col("PART_ID") % 5).cast("string")).alias("r"),
                   (F.col("LOT_ID") % 3).alias("s"))
    last = moves(spark, d).groupBy("EQP_ID").agg(F.max_by(row, F.struct(*ARRIVAL_MOVES)).alias("_l"))
    return last.select("EQP_ID", F.col("_l.p").alias("LAST_PART"), F.col("_l.r").alias("LAST_RECIPE"), F.col("_l.s").alias("LAST_STACK"))


def moves(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start = add_hours(F.col("l_shipdate"), F.col("l_linenumber"))
    run_sec = F.round(F.col("l_discount") * 86400).cast("int")
    return li.select(
        F.col("l_partkey").alias("PART_ID"), F.col("l_linenumber").alias("STEP_SEQ"),
        F.col("l_suppkey").alias("EQP_ID"), F.col("l_orderkey").alias("LOT_ID"),
        start.alias("START_TS"), (F.col("l_discount") * 24).alias("RUN_HOUR"),
        add_seconds(start, run_sec).alias("END_TS"), (F.col("l_tax") * 24).alias("WAIT_HOUR"),
        F.col("l_quantity").alias("QTY"), (F.col("l_returnflag") == "R").alias("HOT"),
        F.col("l_linestatus").alias("SETUP"),
        F.col("l_shipdate").alias("arr_ts"), F.col("l_partkey").alias("arr_k1"),
        F.col("l_suppkey").alias("arr_k2"), F.col("l_orderkey").alias("arr_k3"),
        F.col("l_linenumber").cast("bigint").alias("arr_k4"),
    )


def down(spark: SparkSession, d: str) -> DataFrame:
    s = state_log(spark, d)
    return s.where(F.col("STATE").isin("PM", "DOWN")).select(
        "EQP_ID", F.col("TS").alias("START_TS"), "END_TS", "STATE", "EVENT_ID")


def arrange(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    even = F.col("p_partkey") % 2 == 0
    return p.select(
        F.col("p_partkey").alias("PART_ID"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("STEP_SEQ"),
        F.col("p_type").alias("RECIPE_ID"), even.alias("_even"),
    ).select(
        "PART_ID", "STEP_SEQ", ((F.col("PART_ID") + F.col("STEP_SEQ")) % 100).alias("EQP_ID"), "RECIPE_ID",
        F.when(F.col("_even"), ntz(dt.datetime(1995, 1, 1))).alias("START_TIME"),
        F.when(F.col("_even"), ntz(dt.datetime(1999, 12, 31))).alias("END_TIME"),
    )


def arrange_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("KEY1"), F.col("event_type").alias("KEY2"),
        F.when(_k() % 2 == 0, "add").otherwise("remove").alias("ACTION"),
        F.col("ts").alias("TS"), F.col("event_id").alias("EVENT_ID"),
    )


def route(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        F.col("p_type").alias("ROUTE_ID"), F.col("p_partkey").alias("STEP_ID"),
        F.col("p_size").alias("CT_HOUR"), (F.lit(1.0) - F.col("p_size") / F.lit(1000.0)).alias("YIELD"))
    # few routes, many steps each: skew-safe numbering
    return frames.row_number_by(p, ["ROUTE_ID"], ["STEP_ID"], "STEP_SEQ")


def bom(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(F.col("p_partkey") >= 1)
    return p.select(
        F.col("p_partkey").alias("CHILD"), F.expr("p_partkey div 2").alias("PARENT"),
        (F.lit(1.0) / F.col("p_size")).alias("RATIO"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("NODE_ID"), (F.col("s_suppkey") % 4).alias("CAP"),
                    F.col("s_suppkey").alias("SEQ"))


def _n_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("_n"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    n = F.broadcast(_n_nodes(spark, d))  # one-row aggregate
    e = s.crossJoin(n).select(
        F.col("s_suppkey").alias("SRC"), ((F.lit(7) * F.col("s_suppkey") + 1) % F.col("_n")).alias("DST"),
        F.col("s_suppkey").alias("EDGE_SEQ"))
    return e.where(F.col("SRC") != F.col("DST"))


def graph_requests(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = F.broadcast(_n_nodes(spark, d))
    r = o.crossJoin(n).select("o_orderkey", (F.col("o_custkey") % (F.col("_n") + 5)).alias("START_ID"))
    r = frames.row_number_by(r, [], ["o_orderkey"], "REQ_NO")
    return r.select("REQ_NO", "START_ID", F.col("o_orderkey").alias("ORDER_KEY"))
