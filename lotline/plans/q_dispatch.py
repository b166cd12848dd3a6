"""Driver queries for dispatch scoring, filtering and eligibility (D*)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.calendar import hours_between, ntz
from lotline.operators import dispatch as D
from lotline.operators import factors as X
from lotline.plans import duck
from lotline.plans.oracle_views import with_views
from lotline.plans.registry import register
from lotline.sources import views as V
from lotline.sources.tables import table

NOW = V.NOW
NORM_H = 24.0 * 365 * 7          # hours that map an age to 1.0
N_EQP = 20                       # lots.EQP_ID = o_custkey % 20
ARR = ["ARRIVAL", "LOT_ID"]

# Configuration rows (preset per EQP_ID % 3; factor, scope, weight, order).
PRESET_BY_MOD = {0: "P_AGE", 1: "P_MIX", 2: "P_EMPTY"}
PRESET_FACTORS = [
    ("P_AGE", "LOT_AGE", "LOTTYPE", 0.5, 1),
    ("P_AGE", "CRITICAL_RATIO", "LOTTYPE", 0.3, 2),
    ("P_AGE", "LOT_PRIORITY", "FIXED", 0.2, 3),
    ("P_MIX", "WAFER_COUNT", "LOTTYPE", 0.4, 1),
    ("P_MIX", "STEP_WAIT", "STEPTYPE", 0.4, 2),
    ("P_MIX", "LOT_GROUP", "LOTTYPE", 0.2, 3),
]
# Preference table for LOT_PRIORITY (D9); other priorities default to 0.
PRIORITY_PREF = [("1-URGENT", 1.0), ("2-HIGH", 0.75), ("3-MEDIUM", 0.5), ("4-NOT SPECIFIED", 0.25)]


def eqp_preset(spark: SparkSession) -> DataFrame:
    return spark.range(N_EQP).select(F.col("id").alias("EQP_ID"),
                                     F.element_at(F.create_map(*[F.lit(x) for kv in PRESET_BY_MOD.items() for x in kv]),
                                                  F.col("id") % 3).alias("PRESET"))


def preset_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESET_FACTORS, "PRESET string, FACTOR string, TYPE string, WEIGHT double, ORD int")


def _clamp01(c):
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def prepared_lots(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d)
    pref = spark.createDataFrame(PRIORITY_PREF, "STEP_ID string, PRIO double")
    grp = lots.groupBy("EQP_ID", "GROUP_ID").agg(F.count(F.lit(1)).alias("GROUP_N"))
    return lots.join(F.broadcast(pref), "STEP_ID", "left").join(grp, ["EQP_ID", "GROUP_ID"])


def registry() -> dict:
    now = ntz(NOW)
    age = _clamp01(hours_between(F.col("ARRIVAL"), now) / NORM_H)
    return {
        "LOT_AGE": age,
        "STEP_WAIT": age,
        "CRITICAL_RATIO": _clamp01(hours_between(F.col("DUE"), now) / NORM_H),
        "LOT_PRIORITY": F.coalesce(F.col("PRIO"), F.lit(0.0)),
        "WAFER_COUNT": F.col("QTY") / 25.0,
        "LOT_GROUP": F.least(F.col("GROUP_N") / 10.0, F.lit(1.0)),
    }


def values(spark: SparkSession, d: str) -> DataFrame:
    return D.factor_values(prepared_lots(spark, d), eqp_preset(spark), F.broadcast(preset_factors(spark)),
                           registry(), ARR)


def scored(spark: SparkSession, d: str, types=None) -> DataFrame:
    lots = V.lots(spark, d)
    return D.scores(values(spark, d), lots, types=types)


_NOW = "TIMESTAMP '2001-09-01'"
_PF = duck.catalog_values(PRESET_FACTORS, "PRESET, FACTOR, TYPE, WEIGHT, ORD")
_VALUES_CTE = f"""
WITH l AS (SELECT lots.*, count(*) OVER (PARTITION BY EQP_ID, GROUP_ID) AS GROUP_N,
                  CASE STEP_ID WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5
                               WHEN '4-NOT SPECIFIED' THEN 0.25 ELSE 0.0 END AS PRIO FROM lots),
ep AS (SELECT i AS EQP_ID, CASE i % 3 WHEN 0 THEN 'P_AGE' WHEN 1 THEN 'P_MIX' ELSE 'P_EMPTY' END AS PRESET
       FROM range(0, {N_EQP}) t(i)),
pf AS ({_PF}),
x AS (
  SELECT l.*, pf.PRESET, FACTOR, TYPE, WEIGHT, ORD,
         CAST(CASE FACTOR
           WHEN 'LOT_AGE' THEN least(greatest(epoch({_NOW} - ARRIVAL) / 3600.0 / {NORM_H}, 0.0), 1.0)
           WHEN 'STEP_WAIT' THEN least(greatest(epoch({_NOW} - ARRIVAL) / 3600.0 / {NORM_H}, 0.0), 1.0)
           WHEN 'CRITICAL_RATIO' THEN least(greatest(epoch({_NOW} - DUE) / 3600.0 / {NORM_H}, 0.0), 1.0)
           WHEN 'LOT_PRIORITY' THEN PRIO
           WHEN 'WAFER_COUNT' THEN QTY / 25.0
           WHEN 'LOT_GROUP' THEN least(GROUP_N / 10.0, 1.0) END AS DOUBLE) AS v
  FROM l JOIN ep USING (EQP_ID) JOIN pf USING (PRESET)),
st AS (SELECT EQP_ID, STEP_ID, FACTOR, first(v ORDER BY ARRIVAL, LOT_ID) AS sv FROM x WHERE TYPE = 'STEPTYPE'
       GROUP BY ALL),
vals AS (SELECT x.LOT_ID, x.EQP_ID, x.STEP_ID, x.ARRIVAL, x.GROUP_ID, x.PRESET, x.FACTOR, x.TYPE, x.WEIGHT, x.ORD,
                CASE WHEN x.TYPE = 'STEPTYPE' THEN st.sv ELSE x.v END AS VALUE
         FROM x LEFT JOIN st USING (EQP_ID, STEP_ID, FACTOR)),
sc AS (SELECT lots.LOT_ID, lots.EQP_ID, lots.GROUP_ID, lots.ARRIVAL,
              coalesce(round(sum(WEIGHT * VALUE), 9), 0.0) AS SCORE
       FROM lots LEFT JOIN vals USING (LOT_ID) GROUP BY ALL),
sl AS (SELECT lots.LOT_ID, lots.EQP_ID, lots.GROUP_ID, lots.ARRIVAL,
              coalesce(round(sum(WEIGHT * VALUE), 9), 0.0) AS SCORE
       FROM lots LEFT JOIN (SELECT * FROM vals WHERE TYPE = 'LOTTYPE') v USING (LOT_ID) GROUP BY ALL)"""


def _d(sql: str) -> str:
    return with_views(_VALUES_CTE + "\n" + sql, "lots")


@register("d1_preset_resolution", _d("""
, pre AS (SELECT PRESET, string_agg(FACTOR, ',' ORDER BY ORD) AS FACTORS FROM pf GROUP BY ALL),
e AS (SELECT DISTINCT EQP_ID FROM lots)
SELECT e.EQP_ID, ep.PRESET, coalesce(pre.FACTORS, '') AS FACTORS,
       CASE WHEN ep.PRESET IS NULL THEN 'missing preset' WHEN pre.FACTORS IS NULL THEN 'empty preset' END AS ERROR
FROM e LEFT JOIN ep USING (EQP_ID) LEFT JOIN pre USING (PRESET)"""))
def d1(spark: SparkSession, d: str) -> DataFrame:
    eqps = V.lots(spark, d).select("EQP_ID").distinct()
    return D.resolve_presets(eqps, eqp_preset(spark), preset_factors(spark))


@register("d2_factor_values", _d("SELECT LOT_ID, EQP_ID, STEP_ID, FACTOR, TYPE, VALUE FROM vals"))
def d2(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d).select("LOT_ID", "EQP_ID", "STEP_ID", "FACTOR", "TYPE", "VALUE")


@register("d3_rank_lots", _d("""
SELECT EQP_ID, LOT_ID, SCORE, row_number() OVER (PARTITION BY EQP_ID ORDER BY SCORE DESC, ARRIVAL, LOT_ID) AS RANK_NO
FROM sc"""))
def d3(spark: SparkSession, d: str) -> DataFrame:
    r = D.rank_lots(scored(spark, d), ["EQP_ID"], ARR)
    return r.select("EQP_ID", "LOT_ID", "SCORE", "RANK_NO")


@register("d4_best_lot", _d("""
SELECT EQP_ID, LOT_ID, SCORE FROM sc
QUALIFY row_number() OVER (PARTITION BY EQP_ID ORDER BY SCORE DESC, ARRIVAL, LOT_ID) = 1"""))
def d4(spark: SparkSession, d: str) -> DataFrame:
    return D.best_lot(scored(spark, d), ["EQP_ID"], ARR)


@register("d5_sort_lot_group", _d("""
SELECT EQP_ID, GROUP_ID, LOT_ID, SCORE,
       row_number() OVER (PARTITION BY EQP_ID, GROUP_ID ORDER BY SCORE DESC, ARRIVAL, LOT_ID) AS GROUP_RANK
FROM sl"""))
def d5(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d, types=[D.LOTTYPE])
    r = D.rank_lots(s, ["EQP_ID", "GROUP_ID"], ARR, "GROUP_RANK")
    return r.select("EQP_ID", "GROUP_ID", "LOT_ID", "SCORE", "GROUP_RANK")


QTIME_LIMIT_H = 24.0 * 365 * 2


@register("d6_d7_time_factors", with_views(f"""
WITH s AS (SELECT EQP_ID, STEP_ID, min(ARRIVAL) AS step_start FROM lots GROUP BY ALL)
SELECT LOT_ID,
       least(greatest(epoch({_NOW} - ARRIVAL) / 3600.0 / {NORM_H}, 0.0), 1.0) AS LOT_AGE,
       least(greatest(epoch({_NOW} - s.step_start) / 3600.0 / {NORM_H}, 0.0), 1.0) AS BS_STEP_WAIT,
       (epoch(DUE - {_NOW}) / 3600.0) / nullif(QTY * 1.0, 0) AS CRITICAL_RATIO,
       ({QTIME_LIMIT_H} - epoch({_NOW} - ARRIVAL) / 3600.0) / {QTIME_LIMIT_H} AS QTIME
FROM lots JOIN s USING (EQP_ID, STEP_ID)""", "lots"))
def d6_d7(spark: SparkSession, d: str) -> DataFrame:
    """D6 elapsed-time and D7 time-left factors (our formulas; remaining CT = QTY hours)."""
    lots = V.lots(spark, d)
    now = ntz(NOW)
    s = lots.groupBy("EQP_ID", "STEP_ID").agg(F.min("ARRIVAL").alias("_step_start"))
    j = lots.join(s, ["EQP_ID", "STEP_ID"])
    elapsed = hours_between(F.col("ARRIVAL"), now)
    return j.select(
        "LOT_ID", _clamp01(elapsed / NORM_H).alias("LOT_AGE"),
        _clamp01(hours_between(F.col("_step_start"), now) / NORM_H).alias("BS_STEP_WAIT"),
        F.try_divide(hours_between(now, F.col("DUE")), F.col("QTY").cast("double")).alias("CRITICAL_RATIO"),
        ((F.lit(QTIME_LIMIT_H) - elapsed) / QTIME_LIMIT_H).alias("QTIME"))


@register("d8_same_as_last_run", with_views("""
WITH last AS (SELECT EQP_ID, arg_max(CAST(PART_ID % 5 + 1 AS VARCHAR), (START_TS, arr_ts, arr_k1, arr_k2, arr_k3, arr_k4))
                     AS LAST_RECIPE FROM moves GROUP BY ALL)
SELECT LOT_ID, EQP_ID, LAST_RECIPE,
       CAST(coalesce(substr(STEP_ID, 1, 1) = LAST_RECIPE, LAST_RECIPE IS NULL AND STEP_ID IS NULL) AS INTEGER) AS SAME_RECIPE
FROM lots LEFT JOIN last USING (EQP_ID)""", "lots", "moves"))
def d8(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d)
    last = m.groupBy("EQP_ID").agg(F.max(F.struct("START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4",
                                                  (F.col("PART_ID") % 5 + 1).cast("string").alias("r"))).alias("_l"))
    last = last.select("EQP_ID", F.col("_l.r").alias("LAST_RECIPE"))
    lots = V.lots(spark, d)
    j = lots.join(last, "EQP_ID", "left")
    return j.select("LOT_ID", "EQP_ID", "LAST_RECIPE",
                    F.substring("STEP_ID", 1, 1).eqNullSafe(F.col("LAST_RECIPE")).cast("int").alias("SAME_RECIPE"))


@register("d9_preference_lookup", with_views("""
SELECT LOT_ID, CASE STEP_ID WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5
                            WHEN '4-NOT SPECIFIED' THEN 0.25 ELSE 0.0 END AS LOT_PRIORITY,
       CASE WHEN EQP_ID % 4 = 0 THEN 1.0 ELSE 0.0 END AS RESOURCE_PREF
FROM lots""", "lots"))
def d9(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d)
    pref = spark.createDataFrame(PRIORITY_PREF, "STEP_ID string, LOT_PRIORITY double")
    res = spark.range(N_EQP).where(F.col("id") % 4 == 0).select(F.col("id").alias("EQP_ID"),
                                                                F.lit(1.0).alias("RESOURCE_PREF"))
    j = lots.join(F.broadcast(pref), "STEP_ID", "left").join(F.broadcast(res), "EQP_ID", "left")
    return j.select("LOT_ID", F.coalesce("LOT_PRIORITY", F.lit(0.0)).alias("LOT_PRIORITY"),
                    F.coalesce("RESOURCE_PREF", F.lit(0.0)).alias("RESOURCE_PREF"))


@register("d10_size_progress", with_views("""
WITH g AS (SELECT EQP_ID, GROUP_ID, count(*) AS n FROM lots GROUP BY ALL),
m AS (SELECT EQP_ID, max(n) AS mx FROM g GROUP BY ALL)
SELECT LOT_ID, QTY / 25.0 AS WAFER_COUNT, CAST(substr(STEP_ID, 1, 1) AS INTEGER) / 5.0 AS LOT_PROGRESS,
       g.n * 1.0 / m.mx AS LOT_GROUP
FROM lots JOIN g USING (EQP_ID, GROUP_ID) JOIN m USING (EQP_ID)""", "lots"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d)
    g = lots.groupBy("EQP_ID", "GROUP_ID").agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("EQP_ID").agg(F.max("n").alias("mx"))
    j = lots.join(g, ["EQP_ID", "GROUP_ID"]).join(m, "EQP_ID")
    return j.select("LOT_ID", (F.col("QTY") / 25.0).alias("WAFER_COUNT"),
                    (F.substring("STEP_ID", 1, 1).cast("int") / 5.0).alias("LOT_PROGRESS"),
                    (F.col("n") / F.col("mx")).alias("LOT_GROUP"))


@register("d11_arrival_switch", with_views(f"""
SELECT LOT_ID, CAST(ARRIVAL <= {_NOW} AS INTEGER) AS ATSTEP,
       -greatest(epoch(ARRIVAL - {_NOW}) / 60.0, 0.0) AS STEP_ETA,
       -CASE WHEN HOT THEN 30.0 ELSE 0.0 END AS SWITCH_TIME
FROM lots""", "lots"))
def d11(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d)
    now = ntz(NOW)
    return lots.select("LOT_ID", (F.col("ARRIVAL") <= now).cast("int").alias("ATSTEP"),
                       (-F.greatest(hours_between(now, F.col("ARRIVAL")) * 60.0, F.lit(0.0))).alias("STEP_ETA"),
                       (-F.when(F.col("HOT"), 30.0).otherwise(0.0)).alias("SWITCH_TIME"))


# ---------------------------------------------------------------- all factor names over batches and lookups

FACTOR_NOW = dt.datetime(1998, 6, 1)     # inside the arrivals, so that values vary
BATCH_OF = 4
PART_PREF = [(0, 0.9), (3, 0.5), (5, 0.2)]
LAYER_PREF = [("L1", 0.7), ("L2", 0.3)]


def factor_context(spark: SparkSession, d: str) -> X.Context:
    even = table(spark, d, "supplier").where(F.col("s_suppkey") % 4 == 0)
    tools = table(spark, d, "supplier").select(F.col("s_suppkey").alias("EQP_ID"))
    recipes = spark.range(5).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("r"))
    # switch minutes per tool between recipes: five by five per tool
    pairs = recipes.select(F.explode(F.array(*[F.lit(f"R{i}") for i in range(5)])).alias("f"), "r").where("f <> r")
    switches = tools.select("EQP_ID", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i")).join(
        F.broadcast(pairs.withColumn("i", F.substring("f", 2, 1).cast("int"))), "i").select(
        "EQP_ID", F.col("f").alias("FROM_RECIPE"), F.col("r").alias("TO_RECIPE"),
        (10.0 + F.col("EQP_ID") % 3 + 5 * F.abs(F.col("i") - F.substring("r", 2, 1).cast("int"))).alias("MINUTES"))
    prefs = {"PART": spark.createDataFrame(PART_PREF, "PART_ID long, PREF double"),
             "LAYER": spark.createDataFrame(LAYER_PREF, "LAYER_ID string, PREF double"),
             "RESOURCE": even.select(F.col("s_suppkey").alias("EQP_ID"), F.lit(1.0).alias("PREF")),
             "LOT_PRIORITY": spark.createDataFrame(PRIORITY_PREF, "STEP_ID string, PREF double")}
    return X.Context(ntz(FACTOR_NOW), V.last_runs(spark, d), prefs, switches, max_lot=BATCH_OF)


_T = f"TIMESTAMP '{FACTOR_NOW}'"
_FACTOR_SQL = f"""
WITH f AS (
  SELECT l.*, r.* EXCLUDE (EQP_ID),
    least(greatest(epoch({_T} - CREATED) / 3600.0 / 8760.0, 0.0), 1.0) AS LOT_AGE,
    least(greatest(epoch({_T} - ARRIVAL) / 3600.0 / 8760.0, 0.0), 1.0) AS STEP_WAIT,
    epoch(DUE - {_T}) / 3600.0 / REMAIN_HOURS AS CRITICAL_RATIO,
    (Q_LIMIT_HOURS - epoch({_T} - ARRIVAL) / 3600.0) / Q_LIMIT_HOURS AS QTIME,
    CAST(RECIPE_ID IS NOT DISTINCT FROM LAST_RECIPE AS INTEGER) AS SAME_RECIPE,
    CAST(PART_ID IS NOT DISTINCT FROM LAST_PART AS INTEGER) AS STABLE,
    CAST(RECIPE_ID IS NOT DISTINCT FROM LAST_RECIPE AND PART_ID IS DISTINCT FROM LAST_PART AS INTEGER) AS DIFF_STABLE,
    CAST(STACK_ID IS NOT DISTINCT FROM LAST_STACK AS INTEGER) AS PHOTO_STACK,
    CASE PART_ID WHEN 0 THEN 0.9 WHEN 3 THEN 0.5 WHEN 5 THEN 0.2 ELSE 0.0 END AS PART_PREFERENCE,
    CASE LAYER_ID WHEN 'L1' THEN 0.7 WHEN 'L2' THEN 0.3 ELSE 0.0 END AS LAYER_PREFERENCE,
    CASE WHEN EQP_ID % 4 = 0 AND EQP_ID IN (SELECT s_suppkey FROM supplier) THEN 1.0 ELSE 0.0 END AS RESOURCE_PREFERENCE,
    CASE STEP_ID WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 WHEN '4-NOT SPECIFIED' THEN 0.25 ELSE 0.0 END
      AS LOT_PRIORITY,
    QTY / 25.0 AS WAFER_COUNT, STEP_SEQ / 50.0 AS LOT_PROGRESS,
    CAST(ARRIVAL <= {_T} AS INTEGER) AS ATSTEP, -greatest(epoch(ARRIVAL - {_T}) / 60.0, 0.0) AS STEP_ETA,
    CASE WHEN LAST_RECIPE IS NULL OR RECIPE_ID = LAST_RECIPE OR EQP_ID NOT IN (SELECT s_suppkey FROM supplier) THEN 0.0
         ELSE -(10.0 + EQP_ID % 3 + 5 * abs(CAST(substr(RECIPE_ID, 2) AS INTEGER) - CAST(substr(LAST_RECIPE, 2) AS INTEGER))) END AS SWITCH_TIME,
    count(*) OVER (PARTITION BY EQP_ID, GROUP_ID) AS gn,
    (row_number() OVER (PARTITION BY EQP_ID, STEP_ID ORDER BY ARRIVAL, LOT_ID) - 1) // {BATCH_OF} AS b
  FROM factor_lots l LEFT JOIN last_runs r USING (EQP_ID)),
x AS (
  SELECT *, gn / max(gn) OVER (PARTITION BY EQP_ID) AS LOT_GROUP, max(STEP_WAIT) OVER w AS BS_STEP_WAIT, min(QTIME) OVER w AS BS_QTIME,
    min(STABLE) OVER w AS BS_STABLE, min(DIFF_STABLE) OVER w AS BS_DIFF_STABLE, max(PART_PREFERENCE) OVER w AS BS_PART_PREFERENCE,
    sum(QTY) OVER w / 100.0 AS BS_WAFER_COUNT, min(ATSTEP) OVER w AS BS_ATSTEP, min(STEP_ETA) OVER w AS MAX_STEP_ETA
  FROM f WINDOW w AS (PARTITION BY EQP_ID, STEP_ID, b))
SELECT LOT_ID, """

FACTOR_GROUPS = {
    "d6_elapsed_factors": ["LOT_AGE", "STEP_WAIT", "BS_STEP_WAIT"],
    "d7_time_left_factors": ["CRITICAL_RATIO", "QTIME", "BS_QTIME"],
    "d8_last_run_factors": ["SAME_RECIPE", "STABLE", "DIFF_STABLE", "BS_STABLE", "BS_DIFF_STABLE", "PHOTO_STACK"],
    "d9_preference_factors": ["PART_PREFERENCE", "BS_PART_PREFERENCE", "LAYER_PREFERENCE", "RESOURCE_PREFERENCE", "LOT_PRIORITY"],
    "d10_size_factors": ["WAFER_COUNT", "BS_WAFER_COUNT", "LOT_PROGRESS", "LOT_GROUP"],
    "d11_arrival_factors": ["ATSTEP", "BS_ATSTEP", "STEP_ETA", "MAX_STEP_ETA", "SWITCH_TIME"],
}


def _register_factors(query: str, names: list[str]) -> None:
    columns = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)

    @register(query, with_views(_FACTOR_SQL + columns + " FROM x", "factor_lots", "last_runs"))
    def build(spark: SparkSession, d: str) -> DataFrame:
        return X.evaluate(V.factor_lots(spark, d), names, factor_context(spark, d)).select("LOT_ID", *names)


for _query, _names in FACTOR_GROUPS.items():
    _register_factors(_query, _names)


def d12_rules():
    now_minus_year = ntz(dt.datetime(2000, 9, 1))
    return [("HOLD", F.col("QTY") > 20), ("OVERDUE", F.col("DUE") < now_minus_year),
            ("LOW_PRIORITY", F.col("STEP_ID") == "5-LOW")]


_D12_SQL = """
SELECT LOT_ID, EQP_ID, CASE WHEN QTY > 20 THEN 'HOLD' WHEN DUE < TIMESTAMP '2000-09-01' THEN 'OVERDUE'
                            WHEN STEP_ID = '5-LOW' THEN 'LOW_PRIORITY' END AS REASON
FROM lots"""


@register("d12_filter_reason", with_views(_D12_SQL, "lots"))
def d12(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d)
    return lots.select("LOT_ID", "EQP_ID", D.first_reason(d12_rules()).alias("REASON"))


@register("d13_eligibility", with_views("""
SELECT m.arr_ts, m.arr_k1, m.arr_k2, m.arr_k3, m.arr_k4, m.PART_ID, m.STEP_SEQ, a.EQP_ID AS ALLOWED_EQP, a.RECIPE_ID
FROM moves m JOIN arrange a ON a.PART_ID = m.PART_ID AND a.STEP_SEQ = m.STEP_SEQ
WHERE (a.START_TIME IS NULL OR a.START_TIME <= m.START_TS) AND (a.END_TIME IS NULL OR m.START_TS <= a.END_TIME)""",
                                        "moves", "arrange"))
def d13(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).drop("EQP_ID")
    a = V.arrange(spark, d).withColumnRenamed("EQP_ID", "ALLOWED_EQP")
    e = D.eligible(m, a, ["PART_ID", "STEP_SEQ"], "START_TS")
    return e.select("arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "PART_ID", "STEP_SEQ", "ALLOWED_EQP",
                    "RECIPE_ID")


ASOF = dt.datetime(2024, 1, 15)


@register("d14_asof_schedule", with_views("""
SELECT KEY1, KEY2, LAST_TS FROM (
  SELECT KEY1, KEY2, arg_max(ACTION, (TS, EVENT_ID)) AS a, max(TS) AS LAST_TS
  FROM arrange_log WHERE TS <= TIMESTAMP '2024-01-15' GROUP BY ALL) WHERE a = 'add'""", "arrange_log"))
def d14(spark: SparkSession, d: str) -> DataFrame:
    return D.asof_state(V.arrange_log(spark, d), ["KEY1", "KEY2"], "TS", "EVENT_ID", "ACTION", ASOF)


def _load_requests(spark: SparkSession, d: str) -> DataFrame:
    """view/click events request a load on the next of all equipments (user ids, round and round)."""
    events = table(spark, d, "events")
    n = events.agg((F.max("user_id") + 1).alias("_n"))  # one row
    e = events.where(F.col("event_type").isin("view", "click")).crossJoin(F.broadcast(n))
    return e.select(F.col("event_id").alias("REQ_ID"), ((F.col("user_id") + 1) % F.col("_n")).alias("EQP_ID"),
                    F.col("ts").alias("TS"))


@register("d15_inhibit_filter", with_views("""
WITH r AS (SELECT event_id AS REQ_ID, (user_id + 1) % (SELECT max(user_id) + 1 FROM events) AS EQP_ID, ts AS TS FROM events
           WHERE event_type IN ('view', 'click'))
SELECT * FROM r WHERE NOT EXISTS (
  SELECT 1 FROM down d WHERE d.EQP_ID = r.EQP_ID AND d.START_TS <= r.TS AND r.TS < d.END_TS)""", "down"))
def d15(spark: SparkSession, d: str) -> DataFrame:
    flags = D.inhibited(_load_requests(spark, d), V.down(spark, d), "EQP_ID", "TS", "REQ_ID")
    return flags.where(~F.col("INHIBITED")).select("REQ_ID", "EQP_ID", "TS")


# Switch cost in minutes by (from setup, to setup); unknown pairs cost 0.
SWITCH_COST = [("F", "O", 30.0), ("O", "F", 45.0)]


@register("d16_switch_time", with_views("""
WITH s AS (SELECT EQP_ID, arr_ts, arr_k1, arr_k2, arr_k3, arr_k4, SETUP,
                  lag(SETUP) OVER (PARTITION BY EQP_ID ORDER BY START_TS, arr_ts, arr_k1, arr_k2, arr_k3, arr_k4)
                    AS PREV_SETUP FROM moves)
SELECT s.*, coalesce(c.m, 0.0) AS SWITCH_MIN
FROM s LEFT JOIN (VALUES ('F', 'O', 30.0), ('O', 'F', 45.0)) c(f, t, m) ON c.f = s.PREV_SETUP AND c.t = s.SETUP""",
                                         "moves"))
def d16(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).select("EQP_ID", "START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "SETUP")
    order = ["START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4"]
    p = frames.neighbour(m, ["EQP_ID"], order, ["SETUP"], -1, "PREV_")
    cost = spark.createDataFrame(SWITCH_COST, "PREV_SETUP string, SETUP string, SWITCH_MIN double")
    j = p.join(F.broadcast(cost), ["PREV_SETUP", "SETUP"], "left")
    return j.select("EQP_ID", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "SETUP", "PREV_SETUP",
                    F.coalesce("SWITCH_MIN", F.lit(0.0)).alias("SWITCH_MIN"))


N_BAYS = 5


def delivery_table(spark: SparkSession) -> DataFrame:
    """Bay-to-bay minutes (10 per bay apart) plus a 5-minute penalty across the 0-1 / 2-4 divide."""
    b = spark.range(N_BAYS).select(F.col("id").alias("FROM_BAY"))
    t = spark.range(N_BAYS).select(F.col("id").alias("TO_BAY"))
    x = b.crossJoin(t)  # 25 rows of configuration
    return x.select("FROM_BAY", "TO_BAY", (F.abs(F.col("FROM_BAY") - F.col("TO_BAY")) * 10.0).alias("MINUTES"),
                    F.when((F.col("FROM_BAY") < 2) != (F.col("TO_BAY") < 2), 5.0).otherwise(0.0).alias("PENALTY"))


@register("d17_delivery_time", with_views(f"""
WITH s AS (SELECT LOT_ID, arr_ts, arr_k1, arr_k2, arr_k3, arr_k4, EQP_ID % {N_BAYS} AS TO_BAY,
                  lag(EQP_ID % {N_BAYS}) OVER (PARTITION BY LOT_ID ORDER BY START_TS, arr_ts, arr_k1, arr_k2, arr_k3,
                                               arr_k4) AS FROM_BAY FROM moves)
SELECT *, abs(FROM_BAY - TO_BAY) * 10.0 + CASE WHEN (FROM_BAY < 2) <> (TO_BAY < 2) THEN 5.0 ELSE 0.0 END
          AS DELIVERY_MIN
FROM s WHERE FROM_BAY IS NOT NULL""", "moves"))
def d17(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).select("LOT_ID", "START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4",
                                 (F.col("EQP_ID") % N_BAYS).alias("TO_BAY"))
    order = ["START_TS", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4"]
    p = frames.neighbour(m, ["LOT_ID"], order, ["TO_BAY"], -1, "PREV_").where(F.col("PREV_TO_BAY").isNotNull())
    p = p.withColumnRenamed("PREV_TO_BAY", "FROM_BAY")
    j = p.join(F.broadcast(delivery_table(spark)), ["FROM_BAY", "TO_BAY"])
    return j.select("LOT_ID", "arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "TO_BAY", "FROM_BAY",
                    (F.col("MINUTES") + F.col("PENALTY")).alias("DELIVERY_MIN"))


# Hourly move limits between areas (from, to); a NULL limit means no limit.
AREA_LIMITS = [(0, "click", 2), (1, "view", 1), (2, "purchase", None)]


@register("d18_rolling_move_limit", """
WITH e AS (SELECT event_id, user_id % 3 AS FROM_AREA, event_type AS TO_AREA, CAST(floor(epoch(ts)) AS BIGINT) AS t
           FROM events),
c AS (SELECT a.event_id, a.FROM_AREA, a.TO_AREA, count(*) AS N_WINDOW
      FROM e a JOIN e b ON a.FROM_AREA = b.FROM_AREA AND a.TO_AREA = b.TO_AREA AND b.t BETWEEN a.t - 3599 AND a.t
      GROUP BY ALL),
lim AS (SELECT * FROM (VALUES (0, 'click', 2), (1, 'view', 1), (2, 'purchase', NULL)) v(f, t2, lim))
SELECT c.event_id AS EVENT_ID, FROM_AREA, TO_AREA, N_WINDOW, coalesce(N_WINDOW <= lim.lim, TRUE) AS ALLOWED
FROM c LEFT JOIN lim ON lim.f = c.FROM_AREA AND lim.t2 = c.TO_AREA""")
def d18(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).alias("FROM_AREA"), F.col("event_type").alias("TO_AREA"),
        F.timestamp_diff("SECOND", ntz(dt.datetime(1970, 1, 1)), F.col("ts")).alias("t"))
    c = D.windowed_count(e, ["FROM_AREA", "TO_AREA"], "t", "event_id", 3600)
    lim = spark.createDataFrame(AREA_LIMITS, "FROM_AREA long, TO_AREA string, LIM int")
    j = c.join(F.broadcast(lim), ["FROM_AREA", "TO_AREA"], "left")
    return j.select(F.col("event_id").alias("EVENT_ID"), "FROM_AREA", "TO_AREA", "N_WINDOW",
                    F.coalesce(F.col("N_WINDOW") <= F.col("LIM"), F.lit(True)).alias("ALLOWED"))


STEP_CAPA = 500.0


@register("d19_step_capacity", with_views(f"""
SELECT LOT_ID, EQP_ID, STEP_ID,
       sum(QTY * CASE WHEN HOT THEN 2.0 ELSE 1.0 END) OVER (PARTITION BY EQP_ID, STEP_ID ORDER BY ARRIVAL, LOT_ID
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS CUM_LOAD
FROM lots""".replace("FROM lots", "FROM lots") + "", "lots").replace(
    "SELECT LOT_ID, EQP_ID, STEP_ID,", "SELECT *, CUM_LOAD <= 500.0 AS ADMITTED FROM (SELECT LOT_ID, EQP_ID, STEP_ID,", 1)
    + ")")
def d19(spark: SparkSession, d: str) -> DataFrame:
    lots = V.lots(spark, d).select("LOT_ID", "EQP_ID", "STEP_ID", "ARRIVAL", "QTY", "HOT")
    load = F.col("QTY") * F.when(F.col("HOT"), 2.0).otherwise(1.0)
    r = D.admission(lots, ["EQP_ID", "STEP_ID"], ARR, load, F.lit(STEP_CAPA))
    return r.select("LOT_ID", "EQP_ID", "STEP_ID", "CUM_LOAD", "ADMITTED")


MAX_LOT, MIN_LOT, MIN_WAFER, MAX_WAFER = 4, 2, 10.0, 75.0


@register("d20_batch_forming", with_views(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY EQP_ID, STEP_ID ORDER BY ARRIVAL, LOT_ID) AS rn FROM lots),
b AS (SELECT EQP_ID, STEP_ID, (rn - 1) // {MAX_LOT} AS BATCH_NO, count(*) AS N_LOTS, sum(QTY) AS WAFERS
      FROM n GROUP BY ALL)
SELECT *, N_LOTS >= {MIN_LOT} AND WAFERS >= {MIN_WAFER} AND WAFERS <= {MAX_WAFER} AS VALID FROM b""", "lots"))
def d20(spark: SparkSession, d: str) -> DataFrame:
    return D.form_batches(V.lots(spark, d), ["EQP_ID", "STEP_ID"], ARR, "QTY", MAX_LOT, MIN_LOT, MIN_WAFER, MAX_WAFER)


@register("d21_dispatch_log", with_views(f"""
WITH f AS ({_D12_SQL}),
c AS (SELECT EQP_ID, count(*) AS N_INITIAL, count(*) FILTER (WHERE REASON IS NULL) AS N_AFTER_FILTER FROM f GROUP BY ALL),
r AS (SELECT EQP_ID, REASON, count(*) AS n FROM f WHERE REASON IS NOT NULL GROUP BY ALL),
t AS (SELECT EQP_ID, string_agg(REASON || ':' || n, ',' ORDER BY REASON) AS REASONS FROM r GROUP BY ALL)
SELECT c.*, coalesce(t.REASONS, '') AS REASONS FROM c LEFT JOIN t USING (EQP_ID)""", "lots"))
def d21(spark: SparkSession, d: str) -> DataFrame:
    return D.dispatch_log(d12(spark, d), "EQP_ID")


DEFAULT_PROC_H = 1.0
# Workstation (bay) process hours; bays not listed fall through to the default.
BAY_PROC_H = [(2, 2.0), (4, 0.5)]


@register("d22_proc_time_fallback", with_views(f"""
SELECT arr_ts, arr_k1, arr_k2, arr_k3, arr_k4, EQP_ID,
       CASE WHEN EQP_ID % 7 = 0 THEN 1.5 WHEN EQP_ID % {N_BAYS} = 2 THEN 2.0 WHEN EQP_ID % {N_BAYS} = 4 THEN 0.5
            ELSE {DEFAULT_PROC_H} END AS PROC_HOURS,
       CASE WHEN EQP_ID % 7 = 0 THEN 'lookup0' WHEN EQP_ID % {N_BAYS} IN (2, 4) THEN 'lookup1' ELSE 'default' END AS SOURCE
FROM moves""", "moves"))
def d22(spark: SparkSession, d: str) -> DataFrame:
    m = V.moves(spark, d).select("arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "EQP_ID",
                                 (F.col("EQP_ID") % N_BAYS).alias("BAY"))
    # resource table: one row per tool (the supplier table) for tools with their own time
    res = table(spark, d, "supplier").where(F.col("s_suppkey") % 7 == 0).select(
        F.col("s_suppkey").alias("RES_ID"), F.lit(1.5).alias("H"))
    ws = spark.createDataFrame(BAY_PROC_H, "WS_BAY long, H double")
    out = D.with_fallback(m, [(res, "EQP_ID", "H"), (ws, "BAY", "H")], DEFAULT_PROC_H)
    return out.select("arr_ts", "arr_k1", "arr_k2", "arr_k3", "arr_k4", "EQP_ID", "PROC_HOURS", "SOURCE")
