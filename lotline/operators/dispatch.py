"""Dispatch scoring, filtering and eligibility (inventory D1-D22).

Lots meet their equipment's preset (a handful of config rows, broadcast),
each factor is one Column from a registry (the weight-method extension
point), scores are a weighted sum (``mode='sum'``) or the factor values in
order (``mode='lex'``).  Ranking uses the skew-safe numbering of
``frames``; the best lot is an aggregate ``min(struct(...))``: one pass, map-side
combined, no sort.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.calendar import ntz

# Factor scopes.
FIXED, STEPTYPE, LOTTYPE = "FIXED", "STEPTYPE", "LOTTYPE"
R_NO_PRESET = "missing preset"
R_EMPTY_PRESET = "empty preset"
SCORE_DIGITS = 9


def resolve_presets(eqps: DataFrame, eqp_preset: DataFrame, factors: DataFrame) -> DataFrame:
    """Equipment -> preset -> ordered factor list; missing or empty preset is an error row."""
    f = factors.groupBy("PRESET").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ORD", "FACTOR"))), lambda s: s["FACTOR"]).alias("_f"))
    # eqp_preset has one row per tool and f one row per preset: configuration-sized
    j = eqps.join(F.broadcast(eqp_preset), "EQP_ID", "left").join(F.broadcast(f), "PRESET", "left")
    err = F.when(F.col("PRESET").isNull(), R_NO_PRESET).when(F.col("_f").isNull(), R_EMPTY_PRESET)
    return j.select("EQP_ID", "PRESET", F.coalesce(F.array_join("_f", ","), F.lit("")).alias("FACTORS"),
                    err.alias("ERROR"))


def factor_values(lots: DataFrame, eqp_preset: DataFrame, factors: DataFrame,
                  registry: Mapping[str, Column], arrival: Sequence[str],
                  step: str = "STEP_ID", eqp: str = "EQP_ID", lot: str = "LOT_ID") -> DataFrame:
    """One row per (lot, factor) with its value under the factor's scope.

    LOTTYPE is evaluated per row.  FIXED takes the value of the lot's first row
    and reuses it for its later ones; STEPTYPE takes that of the first-arriving
    lot of the (equipment, step).  Both are found with a map-side combined
    aggregate.
    """
    cfg = eqp_preset.join(factors, "PRESET")          # a few config rows
    x = lots.join(F.broadcast(cfg), eqp)
    value = None
    for name, expr in registry.items():
        value = F.when(F.col("FACTOR") == name, expr) if value is None else value.when(F.col("FACTOR") == name, expr)
    x = x.withColumn("_v", value.cast("double"))
    order = F.struct(*[F.col(a) for a in arrival], F.col(lot).alias("_lot"))

    def first(scope: str, key: list[str], name: str) -> DataFrame:
        return x.where(F.col("TYPE") == scope).groupBy(*key, "FACTOR").agg(F.min_by(F.struct("_v"), order).alias(name))

    y = x.join(first(STEPTYPE, [eqp, step], "_step"), [eqp, step, "FACTOR"], "left").join(
        first(FIXED, [lot], "_fixed"), [lot, "FACTOR"], "left")
    v = F.when(F.col("TYPE") == STEPTYPE, F.col("_step._v")).when(F.col("TYPE") == FIXED, F.col("_fixed._v")).otherwise(F.col("_v"))
    return y.select(lot, eqp, step, *[c for c in arrival if c not in (lot, eqp, step)], "PRESET", "FACTOR", "TYPE",
                    "WEIGHT", "ORD", v.alias("VALUE"))


def scores(values: DataFrame, lots: DataFrame, lot: str = "LOT_ID", types: Sequence[str] | None = None,
           mode: str = "sum") -> DataFrame:
    """Per-lot score; lots without factors score 0 (sum) or an empty array (lex)."""
    v = values if types is None else values.where(F.col("TYPE").isin(*types))
    if mode == "sum":
        agg = v.groupBy(lot).agg(F.round(F.sum(F.col("WEIGHT") * F.col("VALUE")), SCORE_DIGITS).alias("SCORE"))
        return lots.join(agg, lot, "left").withColumn("SCORE", F.coalesce("SCORE", F.lit(0.0)))
    if mode == "lex":
        agg = v.groupBy(lot).agg(F.transform(F.array_sort(F.collect_list(F.struct("ORD", "VALUE"))),
                                             lambda s: s["VALUE"]).alias("SCORE"))
        return lots.join(agg, lot, "left").withColumn(
            "SCORE", F.coalesce("SCORE", F.array().cast("array<double>")))
    raise ValueError(mode)


def rank_lots(scored: DataFrame, group: Sequence[str], arrival: Sequence[str], name: str = "RANK_NO") -> DataFrame:
    """Dispatch order per group: score high first, then arrival (lot id last)."""
    return frames.row_number_by(scored, list(group), [F.col("SCORE").desc(), *arrival], name)


def best_lot(scored: DataFrame, group: Sequence[str], arrival: Sequence[str], lot: str = "LOT_ID") -> DataFrame:
    """The best lot per group; a tie keeps the earlier lot (aggregate, no sort)."""
    # lexicographic scores are arrays: negated element by element, a shorter one loses to its extension
    kind = dict(scored.dtypes)["SCORE"]
    high = F.concat(F.transform("SCORE", lambda x: -x), F.array(F.lit(float("inf")))) if kind.startswith("array") else -F.col("SCORE")
    key = F.struct(high.alias("_neg"), *[F.col(a) for a in arrival], F.col(lot).alias("_lot"),
                   F.col("SCORE").alias("_score"))
    g = scored.groupBy(*group).agg(F.min(key).alias("_b"))
    return g.select(*group, F.col("_b._lot").alias(lot), F.col("_b._score").alias("SCORE"))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first failing rule names the reason; NULL keeps the row."""
    out = None
    for text, failed in rules:
        out = F.when(failed, F.lit(text)) if out is None else out.when(failed, F.lit(text))
    return out


def eligible(rows: DataFrame, arrange: DataFrame, keys: Sequence[str], ts: str,
             start: str = "START_TIME", end: str = "END_TIME") -> DataFrame:
    """Rows joined to their allowed equipment where ``start <= ts <= end`` (NULL bounds open).

    The allowed equipment grows with the parts, and its file size says little of its rows (the planner would
    broadcast an exploded table by the size of its source): both sides are shuffled, whatever the guess.
    """
    j = rows.join(arrange.hint("merge"), list(keys))
    ok = ((F.col(start).isNull() | (F.col(start) <= F.col(ts))) & (F.col(end).isNull() | (F.col(ts) <= F.col(end))))
    return j.where(ok)


def asof_state(log: DataFrame, keys: Sequence[str], ts: str, tie: str, action: str, asof, keep: str = "add") -> DataFrame:
    """Per key the last action at or before ``asof``; keys whose last action is ``keep``."""
    g = log.where(F.col(ts) <= (ntz(asof) if hasattr(asof, "isoformat") else F.lit(asof))).groupBy(*keys).agg(
        F.max(F.struct(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.col(action).alias("_a"))).alias("_last"))
    return g.where(F.col("_last._a") == keep).select(*keys, F.col("_last._ts").alias("LAST_TS"))


def inhibited(requests: DataFrame, intervals: DataFrame, eqp: str, ts: str, tie: str,
              start: str = "START_TS", end: str = "END_TS") -> DataFrame:
    """D15 helper: flag each request whose time lies in any [start, end) interval of its equipment.

    An as-of rule instead of a range join: a request at t is inside some
    interval iff the largest end among intervals starting at or before t is
    after t.  That is a running max per equipment over intervals and requests
    merged in time order (skew-safe; intervals sort before requests at equal times).
    """
    iv = intervals.select(F.col(eqp).alias("_eqp"), F.col(start).alias("_t"), F.lit(0).alias("_k"),
                          F.lit(None).cast(requests.schema[tie].dataType).alias("_tie"), F.col(end).alias("_end"))
    rq = requests.select(F.col(eqp).alias("_eqp"), F.col(ts).alias("_t"), F.lit(1).alias("_k"),
                         F.col(tie).alias("_tie"), F.lit(None).cast(intervals.schema[end].dataType).alias("_end"))
    r = frames.running_by_group(iv.unionByName(rq), ["_eqp"], ["_t", "_k", "_tie"], {"_max_end": ("max", "_end")})
    flags = r.where(F.col("_k") == 1).select(F.col("_tie").alias(tie),
                                             F.coalesce(F.col("_max_end") > F.col("_t"), F.lit(False)).alias("INHIBITED"))
    return requests.join(flags, tie)


def windowed_count(events: DataFrame, keys: Sequence[str], ts_sec: str, tie: str, width: int) -> DataFrame:
    """D18 helper: rows of the same key with time in [t - width + 1, t] (peers included).

    count = #rows with time <= t  -  #rows with time <= t - width, both as-of
    lookups from one running count over rows and probes (skew-safe).
    """
    rows = events.select(*keys, F.col(ts_sec).alias("_t"), F.lit(0).alias("_k"), F.lit(1).alias("_w"),
                         F.lit(None).cast(events.schema[tie].dataType).alias("_id"), F.lit(0).alias("_p"))
    pa = events.select(*keys, F.col(ts_sec).alias("_t"), F.lit(1).alias("_k"), F.lit(0).alias("_w"),
                       F.col(tie).alias("_id"), F.lit(1).alias("_p"))
    pb = events.select(*keys, (F.col(ts_sec) - width).alias("_t"), F.lit(1).alias("_k"), F.lit(0).alias("_w"),
                       F.col(tie).alias("_id"), F.lit(2).alias("_p"))
    u = rows.unionByName(pa).unionByName(pb)
    r = frames.running_by_group(u, list(keys), ["_t", "_k", "_id", "_p"], {"_c": ("sum", "_w")})
    probes = r.where(F.col("_k") == 1).groupBy(F.col("_id").alias(tie)).agg(
        (F.sum(F.when(F.col("_p") == 1, F.col("_c"))) - F.sum(F.when(F.col("_p") == 2, F.col("_c")))).alias("N_WINDOW"))
    return events.join(probes, tie)


def admission(lots: DataFrame, group: Sequence[str], arrival: Sequence[str], load: Column, limit: Column) -> DataFrame:
    """Running load per group in arrival order; admitted while it stays within the limit.

    A lot whose load is unknown adds nothing and is not admitted; without a limit all known loads are.
    """
    x = lots.withColumn("_load", load)
    r = frames.running_by_group(x, list(group), list(arrival), {"CUM_LOAD": ("sum", "_load")})
    return r.withColumn("ADMITTED", F.col("_load").isNotNull() & F.coalesce(F.col("CUM_LOAD") <= limit, F.lit(True))).drop("_load")


def form_batches(lots: DataFrame, key: Sequence[str], arrival: Sequence[str], wafers: str,
                 max_lot: int, min_lot: int, min_wafer: float, max_wafer: float) -> DataFrame:
    """Chunks of at most ``max_lot`` lots per batching key, with validity flags."""
    n = frames.row_number_by(lots, list(key), list(arrival), "_rn")
    b = n.withColumn("BATCH_NO", F.floor((F.col("_rn") - 1) / max_lot).cast("bigint"))
    g = b.groupBy(*key, "BATCH_NO").agg(F.count(F.lit(1)).alias("N_LOTS"), F.sum(wafers).alias("WAFERS"))
    valid = (F.col("N_LOTS") >= min_lot) & (F.col("WAFERS") >= min_wafer) & (F.col("WAFERS") <= max_wafer)
    return g.withColumn("VALID", valid)


def dispatch_log(filtered: DataFrame, group: str, reason: str = "REASON") -> DataFrame:
    """Per decision the initial count, the count after filters, and 'reason:count' text."""
    counts = filtered.groupBy(group).agg(F.count(F.lit(1)).alias("N_INITIAL"),
                                         F.count_if(F.col(reason).isNull()).alias("N_AFTER_FILTER"))
    per = filtered.where(F.col(reason).isNotNull()).groupBy(group, reason).agg(F.count(F.lit(1)).alias("_n"))
    txt = per.groupBy(group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(reason).alias("r"), F.col("_n").alias("n")))),
        lambda s: F.concat(s["r"], F.lit(":"), s["n"].cast("string"))), ",").alias("REASONS"))
    return counts.join(txt, group, "left").withColumn("REASONS", F.coalesce("REASONS", F.lit("")))


def with_fallback(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], default: float,
                  name: str = "PROC_HOURS") -> DataFrame:
    """Value from the first lookup that has one (the planner broadcasts a small one), else the default."""
    out = df
    vals, srcs = [], []
    for i, (tbl, key, col) in enumerate(lookups):
        t = tbl.select(F.col(tbl.columns[0]).alias(f"_k{i}"), F.col(col).alias(f"_v{i}"))
        out = out.join(t, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        vals.append(F.col(f"_v{i}"))
        srcs.append((F.col(f"_v{i}"), f"lookup{i}"))
    src = None
    for v, s in srcs:
        src = F.when(v.isNotNull(), F.lit(s)) if src is None else src.when(v.isNotNull(), F.lit(s))
    src = (src.otherwise(F.lit("default")) if src is not None else F.lit("default"))
    return out.withColumn(name, F.coalesce(*vals, F.lit(float(default)))).withColumn("SOURCE", src).drop(
        *[f"_v{i}" for i in range(len(lookups))])


FactorRegistry = Mapping[str, Column]
FactorFn = Callable[[], Column]
