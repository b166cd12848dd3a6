"""Driver queries for production statistics (F*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.calendar import ntz, shop_day
from lotline.operators import stats as S
from lotline.plans.oracle_views import with_views
from lotline.plans.registry import register
from lotline.sources import views as V
from lotline.sources.tables import table

MOVE_TIE = ["arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4"]
MT = ", ".join(MOVE_TIE)
ISO_MS = "'%Y-%m-%dT%H:%M:%S'"


def _track(spark: SparkSession, d: str) -> DataFrame:
    """moves -> track events: arrive (START - WAIT), in (START), out (END)."""
    m = V.moves(spark, d)
    keys = [F.col("EQP_ID"), F.col("LOT_ID"), F.col("PART_ID").alias("ROUTE_ID"), F.col("STEP_SEQ"),
            F.concat(F.lit("STEP"), F.col("STEP_SEQ").cast("string")).alias("STEP_ID")]
    arrive = F.timestamp_add("SECOND", F.round(F.col("WAIT_HOUR") * 3600).cast("int") * -1, F.col("START_TS"))
    event = lambda at, kind: F.struct(at.alias("TS"), F.lit(kind).alias("KIND"))
    return m.select(*keys, F.inline(F.array(event(arrive, "arrive"), event(F.col("START_TS"), "in"), event(F.col("END_TS"), "out"))))


@register("f1_eqp_plan", with_views("""
SELECT 'BASE' AS SCENARIO_ID, 1 AS VERSION_NO, coalesce(CAST(EQP_ID AS VARCHAR), '-') AS EQP_ID, LOT_ID, PART_ID AS ROUTE_ID, STEP_SEQ,
       'STEP' || STEP_SEQ AS STEP_ID, START_TS - to_seconds(CAST(round(WAIT_HOUR * 3600) AS BIGINT)) AS ARRIVAL_TS, START_TS, END_TS
FROM moves""", "moves"))
def f1(spark: SparkSession, d: str) -> DataFrame:
    return S.eqp_plan(_track(spark, d), ["EQP_ID", "LOT_ID", "ROUTE_ID", "STEP_SEQ", "STEP_ID"])


@register("f2_load_history", with_views(f"""
WITH m AS (SELECT *, date_trunc('day', START_TS) AS SHOP_DAY,
                  row_number() OVER (PARTITION BY EQP_ID, date_trunc('day', START_TS)
                                     ORDER BY START_TS, {MT}) AS pos FROM moves)
SELECT EQP_ID, SHOP_DAY, (pos - 1) // 1000 AS CHUNK_NO, count(*) AS N_ITEMS,
       to_json(list({{'LotID': LOT_ID, 'PartID': PART_ID, 'StepID': STEP_SEQ, 'LotQty': QTY,
                     'ArrivalTime': strftime(START_TS, {ISO_MS}), 'RecipeID': SETUP,
                     'ToolingID': 'T' || CAST(EQP_ID % 10 AS VARCHAR)}} ORDER BY pos))::VARCHAR AS PLANS
FROM m GROUP BY ALL""", "moves"))
def f2(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).withColumn("SHOP_DAY", shop_day(F.col("START_TS")))
    item = F.struct(F.col("LOT_ID").alias("LotID"), F.col("PART_ID").alias("PartID"),
                    F.col("STEP_SEQ").alias("StepID"), F.col("QTY").alias("LotQty"),
                    F.date_format("START_TS", V.ISO).alias("ArrivalTime"), F.col("SETUP").alias("RecipeID"),
                    F.concat(F.lit("T"), (F.col("EQP_ID") % 10).cast("string")).alias("ToolingID"))
    c = frames.chunked_lists(m, ["EQP_ID", "SHOP_DAY"], ["START_TS", *MOVE_TIE], item, chunk=1000)
    return c.select("EQP_ID", "SHOP_DAY", "CHUNK_NO", "N_ITEMS", F.to_json("ITEMS").alias("PLANS"))


_F3_SQL = """
WITH s AS (
  SELECT EQP_ID, TS AS s, END_TS AS e,
         CASE STATE WHEN 'SETUP' THEN 'SETUP' WHEN 'BUSY' THEN 'BUSY' WHEN 'IDLE_RUN' THEN 'IDLERUN'
                    WHEN 'IDLE' THEN 'IDLE' WHEN 'PM' THEN 'PM' WHEN 'DOWN' THEN 'BM' ELSE 'OTHER' END AS st
  FROM state_log),
d AS (SELECT *, unnest(generate_series(date_trunc('day', s), date_trunc('day', e), INTERVAL 1 DAY)) AS DAY FROM s),
o AS (SELECT EQP_ID, DAY, st,
             epoch(least(e, DAY + INTERVAL 1 DAY) - greatest(s, DAY)) / 3600.0 AS h FROM d)
SELECT EQP_ID, DAY,
       coalesce(sum(h) FILTER (WHERE st = 'SETUP'), 0) AS SETUP, coalesce(sum(h) FILTER (WHERE st = 'BUSY'), 0) AS BUSY,
       coalesce(sum(h) FILTER (WHERE st = 'IDLERUN'), 0) AS IDLERUN, coalesce(sum(h) FILTER (WHERE st = 'IDLE'), 0) AS IDLE,
       coalesce(sum(h) FILTER (WHERE st = 'PM'), 0) AS PM, coalesce(sum(h) FILTER (WHERE st = 'BM'), 0) AS BM,
       coalesce(sum(h) FILTER (WHERE st = 'OTHER'), 0) AS OTHER
FROM o WHERE h > 0 GROUP BY ALL"""


@register("f3_load_stat", with_views(_F3_SQL, "state_log"))
def f3(spark: SparkSession, d: str) -> DataFrame:
    return S.load_stat(V.state_log(spark, d))


_F4_SQL = """
SELECT date_trunc('day', END_TS) AS DAY, PART_ID, STEP_SEQ, EQP_ID, sum(QTY) AS MOVE_QTY,
       sum(CASE WHEN HOT THEN QTY ELSE 0.0 END) AS HOT_QTY, sum(RUN_HOUR) AS RUN_HOUR, sum(WAIT_HOUR) AS WAIT_HOUR,
       weekofyear(date_trunc('day', END_TS)) AS WEEK_NO
FROM moves GROUP BY ALL"""


@register("f4_step_move", with_views(_F4_SQL, "moves"))
def f4(spark: SparkSession, d: str) -> DataFrame:
    return S.step_move(V.moves(spark, d), shop_day(F.col("END_TS")))


@register("f5_cycle_time", with_views("""
WITH g AS (
  SELECT PART_ID, STEP_SEQ, EQP_ID, sum(QTY) AS MOVE_QTY, count(*) AS LOT_COUNT,
         sum((RUN_HOUR + WAIT_HOUR) * QTY) AS tw, sum(WAIT_HOUR * QTY) AS ww, sum(RUN_HOUR * QTY) AS rw,
         sum(WAIT_HOUR) AS wsum
  FROM moves GROUP BY ALL)
SELECT PART_ID, STEP_SEQ, EQP_ID, MOVE_QTY, LOT_COUNT,
       CASE WHEN MOVE_QTY > 0 THEN tw / MOVE_QTY ELSE tw END AS TOTAL_TAT,
       CASE WHEN MOVE_QTY > 0 THEN ww / MOVE_QTY ELSE ww END AS WAIT_TAT,
       CASE WHEN MOVE_QTY > 0 THEN rw / MOVE_QTY ELSE rw END AS RUN_TAT,
       wsum / LOT_COUNT AS SIMPLE_WAIT
FROM g""", "moves"))
def f5(spark: SparkSession, d: str) -> DataFrame:
    return S.cycle_time(V.moves(spark, d))


@register("f6_cycle_time_periodic", with_views("""
WITH m AS (SELECT *, date_trunc('day', END_TS) AS DAY FROM moves),
g AS (
  SELECT DAY, PART_ID, STEP_SEQ, sum(QTY) AS MOVE_QTY, count(*) AS LOT_COUNT,
         sum((RUN_HOUR + WAIT_HOUR) * QTY) AS tw, sum(WAIT_HOUR * QTY) AS ww, sum(RUN_HOUR * QTY) AS rw,
         sum(WAIT_HOUR) AS wsum, count(*) FILTER (WHERE HOT) AS REWORK_CNT, count(*) FILTER (WHERE QTY < 5) AS SCRAP_CNT,
         count(*) FILTER (WHERE RUN_HOUR = 0) AS CHUCK_CNT, count(*) FILTER (WHERE SETUP = 'O') AS RETICLE_CNT,
         sum(CASE WHEN HOT THEN RUN_HOUR * 60 ELSE 0.0 END) AS REWORK_MIN,
         sum(CASE WHEN QTY < 5 THEN RUN_HOUR * 60 ELSE 0.0 END) AS SCRAP_MIN,
         sum(CASE WHEN RUN_HOUR = 0 THEN WAIT_HOUR * 60 ELSE 0.0 END) AS CHUCK_MIN,
         sum(CASE WHEN SETUP = 'O' THEN WAIT_HOUR * 60 ELSE 0.0 END) AS RETICLE_MIN
  FROM m GROUP BY ALL)
SELECT DAY, PART_ID, STEP_SEQ, MOVE_QTY, LOT_COUNT,
       CASE WHEN MOVE_QTY > 0 THEN tw / MOVE_QTY ELSE tw END AS TOTAL_TAT,
       CASE WHEN MOVE_QTY > 0 THEN ww / MOVE_QTY ELSE ww END AS WAIT_TAT,
       CASE WHEN MOVE_QTY > 0 THEN rw / MOVE_QTY ELSE rw END AS RUN_TAT,
       wsum / LOT_COUNT AS SIMPLE_WAIT, REWORK_CNT, SCRAP_CNT, CHUCK_CNT, RETICLE_CNT,
       REWORK_MIN, SCRAP_MIN, CHUCK_MIN, RETICLE_MIN
FROM g""", "moves"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    return S.cycle_time_periodic(V.moves(spark, d), shop_day(F.col("END_TS")))


@register("f7_fab_in_out", """
WITH j AS (SELECT l.l_quantity AS q, l.l_returnflag AS rf, o.o_orderdate AS od, l.l_shipdate AS sd
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ev AS (SELECT date_trunc('day', od) AS d, q AS in_q, 0.0 AS out_q, 0.0 AS scrap_q FROM j
       UNION ALL
       SELECT date_trunc('day', sd), 0.0, q, CASE WHEN rf = 'R' THEN q ELSE 0.0 END FROM j),
k AS (SELECT date_trunc('month', d) AS MONTH, date_trunc('week', d) AS WEEK, d AS DAY, * FROM ev)
SELECT MONTH, WEEK, DAY, sum(in_q) AS IN_QTY, sum(out_q) AS OUT_QTY, sum(in_q) - sum(out_q) AS WIP_DELTA,
       sum(scrap_q) AS SCRAP_QTY, grouping_id(MONTH, WEEK, DAY) AS GID
FROM k GROUP BY ROLLUP (MONTH, WEEK, DAY)""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    ins = j.select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("d"),
                   F.col("l_quantity").alias("in_q"), F.lit(0.0).alias("out_q"), F.lit(0.0).alias("scrap_q"))
    outs = j.select(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("d"), F.lit(0.0).alias("in_q"),
                    F.col("l_quantity").alias("out_q"),
                    F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("scrap_q"))
    ev = ins.unionByName(outs).select(
        F.date_trunc("month", "d").cast("timestamp_ntz").alias("MONTH"),
        F.date_trunc("week", "d").cast("timestamp_ntz").alias("WEEK"), F.col("d").alias("DAY"), "in_q", "out_q",
        "scrap_q")
    return ev.rollup("MONTH", "WEEK", "DAY").agg(
        F.sum("in_q").alias("IN_QTY"), F.sum("out_q").alias("OUT_QTY"),
        (F.sum("in_q") - F.sum("out_q")).alias("WIP_DELTA"), F.sum("scrap_q").alias("SCRAP_QTY"),
        F.grouping_id().alias("GID"))


@register("f7_fab_in_out_by_part", """
WITH j AS (SELECT l.l_partkey AS PART_ID, CAST(l.l_quantity AS DECIMAL(20,4)) AS q, l.l_returnflag AS rf, o.o_orderdate AS od, l.l_shipdate AS sd
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ev AS (SELECT PART_ID, date_trunc('day', od) AS DAY, q AS in_q, 0 AS out_q, 0 AS scrap_q FROM j
       UNION ALL SELECT PART_ID, date_trunc('day', sd), 0, q, CASE WHEN rf = 'R' THEN q ELSE 0 END FROM j),
ends AS (SELECT PART_ID, DAY, sum(in_q) AS i, sum(out_q) AS o, sum(scrap_q) AS s,
                date_trunc('month', DAY) AS MONTH, date_trunc('week', DAY) AS WEEK FROM ev GROUP BY PART_ID, DAY),
p AS (SELECT PART_ID, DAY, WEEK, MONTH, i, o, s, 0 AS GID, DAY AS upto FROM ends
      UNION ALL SELECT PART_ID, NULL, WEEK, MONTH, sum(i), sum(o), sum(s), 1, max(DAY) FROM ends GROUP BY PART_ID, WEEK, MONTH
      UNION ALL SELECT PART_ID, NULL, NULL, MONTH, sum(i), sum(o), sum(s), 3, max(DAY) FROM ends GROUP BY PART_ID, MONTH
      UNION ALL SELECT PART_ID, NULL, NULL, NULL, sum(i), sum(o), sum(s), 7, max(DAY) FROM ends GROUP BY PART_ID)
SELECT p.PART_ID, p.MONTH, p.WEEK, p.DAY, CAST(any_value(p.i) AS DOUBLE) AS FABIN_QTY, CAST(any_value(p.o) AS DOUBLE) AS FABOUT_QTY,
       CAST(sum(e.i - e.o) AS DOUBLE) AS WIP_QTY, CAST(any_value(p.s) AS DOUBLE) AS SCRAP_QTY, p.GID
FROM p JOIN ends e ON e.PART_ID = p.PART_ID AND e.DAY <= p.upto
GROUP BY p.PART_ID, p.MONTH, p.WEEK, p.DAY, p.GID""")
def f7_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Lines come in on their order's day and go out on their ship day; returned ones are scrap."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate").join(
        o, F.col("l_orderkey") == F.col("o_orderkey"))
    q, none = F.col("l_quantity").cast("decimal(20,4)"), F.lit(None).cast("decimal(20,4)")
    event = lambda day, i, out, scrap: F.struct(F.col(day).cast("timestamp_ntz").alias("DAY"), i.alias("IN_QTY"),
                                                out.alias("OUT_QTY"), scrap.alias("SCRAP_QTY"))
    events = j.select(F.col("l_partkey").alias("PART_ID"), F.inline(F.array(
        event("o_orderdate", q, none, none), event("l_shipdate", none, q, F.when(F.col("l_returnflag") == "R", q)))))
    found = S.fab_in_out(events)
    return found.select(*[F.col(c).cast("double").alias(c) if c.endswith("_QTY") else F.col(c) for c in found.columns])


@register("f8_wip_over_time", with_views(f"""
WITH ev AS (SELECT STEP_SEQ AS STEP, START_TS AS TS, 1 AS KIND_ORDER, 1 AS DELTA, {MT} FROM moves
            UNION ALL SELECT STEP_SEQ, END_TS, 0, -1, {MT} FROM moves)
SELECT *, sum(DELTA) OVER (PARTITION BY STEP ORDER BY TS, KIND_ORDER, {MT}
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS WIP
FROM ev""", "moves"))
def f8(spark: SparkSession, d: str) -> DataFrame:
    return S.wip_over_time(V.moves(spark, d), "STEP_SEQ", "START_TS", "END_TS", MOVE_TIE)


@register("f9_standby_gaps", with_views(f"""
WITH r AS (SELECT EQP_ID, START_TS,
                  max(END_TS) OVER (PARTITION BY EQP_ID ORDER BY START_TS, {MT}
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
           FROM moves)
SELECT EQP_ID, prev_end AS GAP_START, START_TS AS GAP_END, epoch(START_TS - prev_end) / 3600.0 AS GAP_HOURS
FROM r WHERE START_TS > prev_end""", "moves"))
def f9(spark: SparkSession, d: str) -> DataFrame:
    return S.standby_gaps(V.moves(spark, d), "EQP_ID", "START_TS", "END_TS", MOVE_TIE)


SHOP_OFFSET_H = 7


@register("f10_shop_day", f"""
SELECT date_trunc('day', ts - INTERVAL {SHOP_OFFSET_H} HOUR) + INTERVAL {SHOP_OFFSET_H} HOUR AS SHOP_DAY,
       count(*) AS N_EVENTS, sum(value) AS SUM_VALUE
FROM events GROUP BY ALL""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(shop_day(F.col("ts"), SHOP_OFFSET_H).alias("SHOP_DAY")).agg(
        F.count(F.lit(1)).alias("N_EVENTS"), F.sum("value").alias("SUM_VALUE"))


QT_WARN_H, QT_LIMIT_H = 24.0, 72.0


@register("f11_qtime_check", f"""
WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
e AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
p AS (SELECT s.user_id AS LOT_ID, s.ts AS START_TS, s.event_id AS START_EVENT, min(e.ts) AS END_TS
      FROM s LEFT JOIN e ON s.user_id = e.user_id AND e.ts > s.ts GROUP BY ALL)
SELECT *, epoch(END_TS - START_TS) / 3600.0 AS QT_HOURS,
       CASE WHEN END_TS IS NULL THEN 'OPEN' WHEN epoch(END_TS - START_TS) / 3600.0 <= {QT_WARN_H} THEN 'OK'
            WHEN epoch(END_TS - START_TS) / 3600.0 <= {QT_LIMIT_H} THEN 'WARN' ELSE 'OVER' END AS STATUS
FROM p""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return S.qtime_check(e, "user_id", "ts", "event_id", F.col("event_type") == "view",
                         F.col("event_type") == "purchase", QT_WARN_H, QT_LIMIT_H)


@register("f12_route_cumulative", with_views("""
SELECT ROUTE_ID, STEP_ID, CT_HOUR, YIELD, STEP_SEQ,
       sum(CT_HOUR) OVER (PARTITION BY ROUTE_ID ORDER BY STEP_SEQ) AS CUM_CT,
       sum(CT_HOUR) OVER (PARTITION BY ROUTE_ID ORDER BY STEP_SEQ DESC) AS REMAIN_CT,
       exp(sum(ln(YIELD)) OVER (PARTITION BY ROUTE_ID ORDER BY STEP_SEQ)) AS CUM_YIELD
FROM route""", "route"))
def f12(spark: SparkSession, d: str) -> DataFrame:
    return S.route_cumulative(V.route(spark, d))


@register("f13_bom_explode", with_views("""
WITH RECURSIVE x AS (
  SELECT CHILD AS COMPONENT, 1 AS LEVEL, RATIO AS QTY_PER FROM bom WHERE PARENT = 0
  UNION ALL
  SELECT b.CHILD, x.LEVEL + 1, x.QTY_PER * b.RATIO FROM x JOIN bom b ON b.PARENT = x.COMPONENT)
SELECT 0::BIGINT AS ROOT, COMPONENT, LEVEL, QTY_PER FROM x""", "bom"))
def f13(spark: SparkSession, d: str) -> DataFrame:
    return S.bom_explode(V.bom(spark, d), root=0)


def _peg_sides(spark: SparkSession, d: str):
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("PRODUCT"), F.col("l_quantity").alias("QTY"), "l_returnflag", "l_shipdate",
        "l_suppkey", "l_orderkey", "l_linenumber")
    order = ["l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber"]
    demand = li.where(F.col("l_returnflag") == "N")
    supply = li.where(F.col("l_returnflag") != "N")
    return supply, demand, order


_PEG_CTE = """
WITH li AS (SELECT l_partkey AS PRODUCT, l_quantity AS QTY, l_returnflag, l_shipdate, l_suppkey, l_orderkey,
                   l_linenumber FROM lineitem),
s AS (SELECT PRODUCT, row_number() OVER w AS SUPPLY_SEQ, sum(QTY) OVER w AS s_end, sum(QTY) OVER w - QTY AS s_start
      FROM li WHERE l_returnflag <> 'N'
      WINDOW w AS (PARTITION BY PRODUCT ORDER BY l_shipdate, l_suppkey, l_orderkey, l_linenumber
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT PRODUCT, row_number() OVER w AS DEMAND_SEQ, QTY, sum(QTY) OVER w AS d_end,
             sum(QTY) OVER w - QTY AS d_start
      FROM li WHERE l_returnflag = 'N'
      WINDOW w AS (PARTITION BY PRODUCT ORDER BY l_shipdate, l_suppkey, l_orderkey, l_linenumber
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT d.PRODUCT, DEMAND_SEQ, SUPPLY_SEQ, least(s_end, d_end) - greatest(s_start, d_start) AS PEG_QTY
      FROM d JOIN s ON s.PRODUCT = d.PRODUCT AND greatest(s_start, d_start) < least(s_end, d_end))"""


@register("f14_fifo_pegging", _PEG_CTE + "\nSELECT * FROM p")
def f14(spark: SparkSession, d: str) -> DataFrame:
    supply, demand, order = _peg_sides(spark, d)
    return S.fifo_peg(supply, demand, "PRODUCT", "QTY", order, order)


@register("f14_peg_remaining", _PEG_CTE + """
SELECT d.PRODUCT, d.DEMAND_SEQ, d.QTY AS DEMAND_QTY, coalesce(sum(p.PEG_QTY), 0) AS PEGGED_QTY,
       d.QTY - coalesce(sum(p.PEG_QTY), 0) AS REMAINING_QTY
FROM d LEFT JOIN p USING (PRODUCT, DEMAND_SEQ) GROUP BY d.PRODUCT, d.DEMAND_SEQ, d.QTY""")
def f14_remaining(spark: SparkSession, d: str) -> DataFrame:
    supply, demand, order = _peg_sides(spark, d)
    peg = S.fifo_peg(supply, demand, "PRODUCT", "QTY", order, order, exact=True)
    dem = frames.row_number_by(demand.select("PRODUCT", "QTY", *order), ["PRODUCT"], order, "DEMAND_SEQ")
    per = peg.groupBy("PRODUCT", "DEMAND_SEQ").agg(F.sum("PEG_QTY").alias("_p"))
    j = dem.join(per, ["PRODUCT", "DEMAND_SEQ"], "left")
    asked, pegged = F.col("QTY").cast("decimal(28,6)"), F.coalesce(F.col("_p"), F.lit(0).cast("decimal(38,6)"))
    return j.select("PRODUCT", "DEMAND_SEQ", F.col("QTY").alias("DEMAND_QTY"), pegged.cast("double").alias("PEGGED_QTY"),
                    (asked - pegged).cast("double").alias("REMAINING_QTY"))


def _lot_route(spark: SparkSession, d: str) -> DataFrame:
    """lots placed on routes: route by LOT_ID over the (few) route ids, current and target step."""
    routes = V.route(spark, d).select("ROUTE_ID").distinct()
    # the route list is the distinct p_type values: a handful of rows
    ranked = routes.select("ROUTE_ID", (F.dense_rank().over(Window.orderBy("ROUTE_ID")) - 1).alias("R_IDX"))
    n = ranked.agg(F.count(F.lit(1)).alias("_nr"))
    lots = V.lots(spark, d).crossJoin(F.broadcast(n))
    lots = lots.select("LOT_ID", (F.col("LOT_ID") % F.col("_nr")).alias("R_IDX"),
                       (F.lit(1) + F.col("LOT_ID") % 50).alias("CUR_SEQ"))
    return lots.join(F.broadcast(ranked), "R_IDX").withColumn("TARGET_SEQ", F.col("CUR_SEQ") + 10)


@register("f15_lot_eta", with_views(f"""
WITH cum AS (SELECT ROUTE_ID, STEP_SEQ, sum(CT_HOUR) OVER (PARTITION BY ROUTE_ID ORDER BY STEP_SEQ) AS CUM_CT
             FROM route),
r AS (SELECT ROUTE_ID, dense_rank() OVER (ORDER BY ROUTE_ID) - 1 AS R_IDX FROM (SELECT DISTINCT ROUTE_ID FROM route)),
l AS (SELECT LOT_ID, LOT_ID % (SELECT count(*) FROM r) AS R_IDX, 1 + LOT_ID % 50 AS CUR_SEQ FROM lots),
x AS (SELECT l.LOT_ID, r.ROUTE_ID, CUR_SEQ, CUR_SEQ + 10 AS TARGET_SEQ FROM l JOIN r USING (R_IDX))
SELECT x.*, a.CUM_CT - coalesce(b.CUM_CT, 0) AS REMAIN_TO_TARGET,
       TIMESTAMP '2001-09-01' + to_microseconds(CAST((a.CUM_CT - coalesce(b.CUM_CT, 0)) * 3600000000 AS BIGINT)) AS ETA,
       CUR_SEQ <> TARGET_SEQ AS UPSTREAM, CASE WHEN a.CUM_CT IS NULL THEN 'target past route end' END AS REASON
FROM x LEFT JOIN cum a ON a.ROUTE_ID = x.ROUTE_ID AND a.STEP_SEQ = x.TARGET_SEQ - 1
       LEFT JOIN cum b ON b.ROUTE_ID = x.ROUTE_ID AND b.STEP_SEQ = x.CUR_SEQ - 1""", "route", "lots"))
def f15(spark: SparkSession, d: str) -> DataFrame:
    cum = frames.running_by_group(V.route(spark, d).select("ROUTE_ID", "STEP_SEQ", "CT_HOUR"), ["ROUTE_ID"],
                                  ["STEP_SEQ"], {"CUM_CT": ("sum", "CT_HOUR")}).drop("CT_HOUR")
    x = _lot_route(spark, d)
    a = cum.select(F.col("ROUTE_ID").alias("_a_route"), F.col("STEP_SEQ").alias("_a_seq"), F.col("CUM_CT").alias("_a"))
    b = cum.select(F.col("ROUTE_ID").alias("_b_route"), F.col("STEP_SEQ").alias("_b_seq"), F.col("CUM_CT").alias("_b"))
    # a target past the end of the route has no ETA, and a reason
    j = x.join(a, (F.col("ROUTE_ID") == F.col("_a_route")) & (F.col("_a_seq") == F.col("TARGET_SEQ") - 1), "left")
    j = j.join(b, (F.col("ROUTE_ID") == F.col("_b_route")) & (F.col("_b_seq") == F.col("CUR_SEQ") - 1), "left")
    rem = F.col("_a") - F.coalesce(F.col("_b"), F.lit(0))
    eta = F.timestamp_add("MICROSECOND", (rem * 3_600_000_000).cast("long"), ntz(V.NOW))
    return j.select("LOT_ID", "ROUTE_ID", "CUR_SEQ", "TARGET_SEQ", rem.alias("REMAIN_TO_TARGET"), eta.alias("ETA"),
                    (F.col("CUR_SEQ") != F.col("TARGET_SEQ")).alias("UPSTREAM"),
                    F.when(F.col("_a").isNull(), F.lit("target past route end")).alias("REASON"))


@register("f16_next_prev_step", with_views("""
SELECT ROUTE_ID, STEP_SEQ, STEP_ID, lead(STEP_ID) OVER w AS NEXT_STEP_ID, lag(STEP_ID) OVER w AS PREV_STEP_ID
FROM route WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY STEP_SEQ)""", "route"))
def f16(spark: SparkSession, d: str) -> DataFrame:
    r = V.route(spark, d).select("ROUTE_ID", "STEP_SEQ", "STEP_ID")
    return frames.beside(r, ["ROUTE_ID"], ["STEP_SEQ"], ["STEP_ID"], "NEXT_", "PREV_")


@register("f17_down_by_type", with_views("""
SELECT EQP_ID, CASE STATE WHEN 'PM' THEN 'PM' ELSE 'BM' END AS DOWN_TYPE, count(*) AS N_DOWN,
       sum(epoch(END_TS - START_TS)) / 3600.0 AS DOWN_HOURS
FROM down GROUP BY ALL""", "down"))
def f17(spark: SparkSession, d: str) -> DataFrame:
    dn = V.down(spark, d)
    return dn.groupBy("EQP_ID", F.when(F.col("STATE") == "PM", "PM").otherwise("BM").alias("DOWN_TYPE")).agg(
        F.count(F.lit(1)).alias("N_DOWN"),
        (F.sum(F.timestamp_diff("MICROSECOND", F.col("START_TS"), F.col("END_TS"))) / 3.6e9).alias("DOWN_HOURS"))


PM_LIMIT_COUNT = 5


@register("f18_count_trigger", with_views(f"""
SELECT * FROM (
  SELECT EQP_ID, row_number() OVER (PARTITION BY EQP_ID ORDER BY START_TS, {MT}) AS RUN_NO, START_TS, LOT_ID
  FROM moves) WHERE RUN_NO % {PM_LIMIT_COUNT} = 0""", "moves"))
def f18(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).select("EQP_ID", "START_TS", "LOT_ID", *MOVE_TIE)
    r = frames.row_number_by(m, ["EQP_ID"], ["START_TS", *MOVE_TIE], "RUN_NO")
    return r.where(F.col("RUN_NO") % PM_LIMIT_COUNT == 0).select("EQP_ID", "RUN_NO", "START_TS", "LOT_ID")


@register("f19_mttf_mttr", with_views("""
SELECT EQP_ID, count(*) AS N_DOWN, avg(epoch(END_TS - START_TS)) / 3600.0 AS MTTR_HOURS,
       CASE WHEN count(*) > 1 THEN epoch(max(START_TS) - min(START_TS)) / 3600.0 / (count(*) - 1) END AS MTTF_HOURS
FROM down GROUP BY ALL""", "down"))
def f19(spark: SparkSession, d: str) -> DataFrame:
    return S.mttf_mttr(V.down(spark, d))


@register("f20_product_mix", with_views("""
WITH p AS (SELECT date_trunc('day', END_TS) AS DAY, PART_ID, sum(QTY) AS QTY FROM moves GROUP BY ALL)
SELECT DAY, PART_ID, QTY, QTY / sum(QTY) OVER (PARTITION BY DAY) AS SHARE FROM p""", "moves"))
def f20(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).withColumn("DAY", shop_day(F.col("END_TS")))
    return S.product_mix(m, "DAY", "PART_ID", "QTY")


@register("f21_lot_children", with_views("""
WITH p AS (SELECT GROUP_ID, LOT_ID, min(LOT_ID) OVER (PARTITION BY GROUP_ID) AS PARENT_LOT FROM lots),
c AS (SELECT *, row_number() OVER (PARTITION BY GROUP_ID ORDER BY LOT_ID) AS pos FROM p WHERE LOT_ID <> PARENT_LOT)
SELECT GROUP_ID, PARENT_LOT, (pos - 1) // 1000 AS CHUNK_NO, count(*) AS N_ITEMS,
       array_to_string(list(LOT_ID ORDER BY pos), ',') AS CHILDS
FROM c GROUP BY GROUP_ID, PARENT_LOT, (pos - 1) // 1000""", "lots"))
def f21_children(spark: SparkSession, d: str) -> DataFrame:
    return S.lot_children(V.lots(spark, d).select("GROUP_ID", "LOT_ID"), "GROUP_ID")


@register("f21_lot_merge", with_views("""
SELECT GROUP_ID, min(LOT_ID) AS PARENT_LOT, count(*) AS N_LOTS, sum(QTY) AS TOTAL_QTY FROM lots GROUP BY ALL""",
                                      "lots"))
def f21(spark: SparkSession, d: str) -> DataFrame:
    return S.lot_merge(V.lots(spark, d), "GROUP_ID")


# Fixed method list of the call profile (the event types plus one never called).
CALL_METHODS = ("signup", "purchase", "view", "click", "error", "refund")


@register("f22_call_profile", """
WITH m AS (SELECT * FROM (VALUES ('signup'), ('purchase'), ('view'), ('click'), ('error'), ('refund')) t(METHOD)),
a AS (SELECT event_type AS METHOD, count(*) AS CALLS, sum(value) AS TOTAL_MS FROM events GROUP BY ALL)
SELECT m.METHOD, coalesce(CALLS, 0) AS CALLS, coalesce(TOTAL_MS, 0.0) AS TOTAL_MS,
       CASE WHEN coalesce(CALLS, 0) > 0 THEN TOTAL_MS / CALLS ELSE 0.0 END AS MEAN_MS
FROM m LEFT JOIN a USING (METHOD)""")
def f22(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_type").alias("METHOD"), F.col("value").alias("MS"))
    methods = spark.createDataFrame([(m,) for m in CALL_METHODS], "METHOD string")
    return S.call_profile(calls, F.broadcast(methods))


@register("f23_scenario_stamp", with_views("SELECT 'S1' AS SCENARIO_ID, 3 AS VERSION_NO, * FROM (" + _F4_SQL + ")",
                                           "moves"))
def f23(spark: SparkSession, d: str) -> DataFrame:
    sm = S.step_move(V.moves(spark, d), shop_day(F.col("END_TS")))
    ls = S.stamp(V.lots(spark, d), "LOTS", "S1", 3, exclude=["LOTS"])  # excluded: left as is
    assert "SCENARIO_ID" not in ls.columns
    return S.stamp(sm, "STEP_MOVE", "S1", 3, exclude=["LOTS"])


PROC_HOURS_PER_UNIT = 0.1


@register("f24_tool_workload", with_views(f"""
WITH l AS (SELECT EQP_ID AS TOOL_ID, LOT_ID, QTY * {PROC_HOURS_PER_UNIT} AS h,
                  row_number() OVER (PARTITION BY EQP_ID ORDER BY LOT_ID) AS pos FROM lots)
SELECT TOOL_ID, (pos - 1) // 1000 AS CHUNK_NO, count(*) AS N_ITEMS, sum(h) AS CHUNK_HOURS,
       sum(sum(h)) OVER (PARTITION BY TOOL_ID) AS WORKLOAD_HOURS, array_to_string(list(LOT_ID ORDER BY pos), ',') AS LOTS
FROM l GROUP BY TOOL_ID, (pos - 1) // 1000""", "lots"))
def f24(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d).select(F.col("EQP_ID").alias("TOOL_ID"), "LOT_ID",
                                   (F.col("QTY") * PROC_HOURS_PER_UNIT).alias("h"))
    c = frames.chunked_lists(lots, ["TOOL_ID"], ["LOT_ID"], F.struct("LOT_ID", "h"), chunk=1000)
    # the tool's total stands with each chunk of its lots
    total = lots.groupBy("TOOL_ID").agg(F.sum("h").alias("WORKLOAD_HOURS"))
    return c.join(total, "TOOL_ID").select("TOOL_ID", "CHUNK_NO", "N_ITEMS",
                    F.aggregate(F.transform("ITEMS", lambda s: s["h"]), F.lit(0.0), lambda a, b: a + b).alias(
                        "CHUNK_HOURS"), "WORKLOAD_HOURS",
                    F.array_join(F.transform("ITEMS", lambda s: s["LOT_ID"].cast("string")), ",").alias("LOTS"))
