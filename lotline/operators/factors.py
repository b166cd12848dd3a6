"""Weight factors by name (inventory D6-D11).

A factor is a column over lots that have been prepared by the lookups it needs,
or, for the ``BS_`` names and the longest arrival, an aggregate over the batch
(D20) its lot is in, handed back to the lot.  :func:`evaluate` prepares each
lookup once for all names that are asked for and forms the batches once.

Lots have LOT_ID, EQP_ID, STEP_ID, GROUP_ID, ARRIVAL (at the step), CREATED,
DUE, QTY, PART_ID, LAYER_ID, RECIPE_ID, STACK_ID, STEP_SEQ, N_STEPS,
REMAIN_HOURS and Q_LIMIT_HOURS.  The names are fixed values; the survey's
sources declare them without formulas, so those here are the library's own.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.calendar import hours_between

#: A lookup table is broadcast up to this number of rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Context:
    """What factors look up besides the lots.

    ``last_run`` has a row per EQP_ID with LAST_PART, LAST_RECIPE and LAST_STACK;
    ``preferences`` maps PART, LAYER, RESOURCE and LOT_PRIORITY to tables of one
    lot column and PREF; ``switches`` has EQP_ID, FROM_RECIPE, TO_RECIPE and
    MINUTES.  Batches have at most ``max_lot`` lots of one EQP_ID and STEP_ID, in
    order of arrival.
    """

    now: Column
    last_run: DataFrame
    preferences: Mapping[str, DataFrame] = field(default_factory=dict)
    switches: DataFrame | None = None
    norm_hours: float = 24.0 * 365
    max_lot: int = 4
    max_wafer: float = 100.0
    wafers_per_lot: float = 25.0
    arrival: Sequence[str] = ("ARRIVAL", "LOT_ID")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _last_run(lots: DataFrame, ctx: Context) -> DataFrame:
    return lots.join(_small(ctx.last_run.select("EQP_ID", "LAST_PART", "LAST_RECIPE", "LAST_STACK")), "EQP_ID", "left")


def _preference(kind: str, column: str) -> Callable[[DataFrame, Context], DataFrame]:
    def prepare(lots: DataFrame, ctx: Context) -> DataFrame:
        table = ctx.preferences.get(kind)
        if table is None:
            return lots.withColumn(f"_pref_{kind}", F.lit(0.0))
        table = table.groupBy(column).agg(F.max("PREF").cast("double").alias(f"_p_{kind}"))
        joined = lots.join(_small(table), column, "left")
        return joined.withColumn(f"_pref_{kind}", F.coalesce(f"_p_{kind}", F.lit(0.0))).drop(f"_p_{kind}")
    return prepare


def _group(lots: DataFrame, ctx: Context) -> DataFrame:
    n = lots.groupBy("EQP_ID", "GROUP_ID").agg(F.count(F.lit(1)).alias("_group_n"))
    most = n.groupBy("EQP_ID").agg(F.max("_group_n").alias("_group_most"))
    return lots.join(n.join(most, "EQP_ID"), ["EQP_ID", "GROUP_ID"], "left")


def _switch(lots: DataFrame, ctx: Context) -> DataFrame:
    if ctx.switches is None:
        return lots.withColumn("_switch", F.lit(0.0))
    times = ctx.switches.groupBy("EQP_ID", F.col("FROM_RECIPE").alias("LAST_RECIPE"), F.col("TO_RECIPE").alias("RECIPE_ID")).agg(
        F.max("MINUTES").cast("double").alias("_minutes"))
    joined = lots.join(_small(times), ["EQP_ID", "LAST_RECIPE", "RECIPE_ID"], "left")
    same = F.col("LAST_RECIPE").eqNullSafe(F.col("RECIPE_ID"))
    return joined.withColumn("_switch", F.when(same, 0.0).otherwise(F.coalesce("_minutes", F.lit(0.0)))).drop("_minutes")


#: Lookups by name, with the lookups they build on.
LOOKUPS: dict[str, tuple[Callable[[DataFrame, Context], DataFrame], tuple[str, ...]]] = {
    "last_run": (_last_run, ()), "group": (_group, ()), "switch": (_switch, ("last_run",)),
    "part": (_preference("PART", "PART_ID"), ()), "layer": (_preference("LAYER", "LAYER_ID"), ()),
    "resource": (_preference("RESOURCE", "EQP_ID"), ()), "priority": (_preference("LOT_PRIORITY", "STEP_ID"), ()),
}


def _share(since: Column, ctx: Context) -> Column:
    share = hours_between(since, ctx.now) / ctx.norm_hours
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def _qtime(ctx: Context) -> Column:
    return F.try_divide(F.col("Q_LIMIT_HOURS") - hours_between(F.col("ARRIVAL"), ctx.now), F.col("Q_LIMIT_HOURS"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)).cast("double")


def _diff_stable(ctx: Context) -> Column:
    return _same("RECIPE_ID", "LAST_RECIPE") * (1.0 - _same("PART_ID", "LAST_PART"))


def _at_step(ctx: Context) -> Column:
    return F.coalesce(F.col("ARRIVAL") <= ctx.now, F.lit(False)).cast("double")


def _eta(ctx: Context) -> Column:
    return F.when(F.col("ARRIVAL").isNotNull(), -F.greatest(hours_between(ctx.now, F.col("ARRIVAL")) * 60.0, F.lit(0.0)))


@dataclass(frozen=True)
class Factor:
    """``value`` of a lot; with ``over`` it is combined over the lot's batch."""

    value: Callable[[Context], Column]
    needs: tuple[str, ...] = ()
    over: Callable[[Column], Column] | None = None


#: The names of the factors.
FACTORS: dict[str, Factor] = {
    # D6 elapsed time as a share of the norm
    "LOT_AGE": Factor(lambda c: _share(F.col("CREATED"), c)),
    "STEP_WAIT": Factor(lambda c: _share(F.col("ARRIVAL"), c)),
    "BS_STEP_WAIT": Factor(lambda c: _share(F.col("ARRIVAL"), c), over=F.max),
    # D7 time left: slack per hour of remaining work, and the unused share of the queue time
    "CRITICAL_RATIO": Factor(lambda c: F.try_divide(hours_between(c.now, F.col("DUE")), F.col("REMAIN_HOURS"))),
    "QTIME": Factor(_qtime),
    "BS_QTIME": Factor(_qtime, over=F.min),
    # D8 equal to the equipment's last run
    "SAME_RECIPE": Factor(lambda c: _same("RECIPE_ID", "LAST_RECIPE"), ("last_run",)),
    "STABLE": Factor(lambda c: _same("PART_ID", "LAST_PART"), ("last_run",)),
    "DIFF_STABLE": Factor(_diff_stable, ("last_run",)),
    "BS_STABLE": Factor(lambda c: _same("PART_ID", "LAST_PART"), ("last_run",), F.min),
    "BS_DIFF_STABLE": Factor(_diff_stable, ("last_run",), F.min),
    "PHOTO_STACK": Factor(lambda c: _same("STACK_ID", "LAST_STACK"), ("last_run",)),
    # D9 preferences, 0 where none is given
    "PART_PREFERENCE": Factor(lambda c: F.col("_pref_PART"), ("part",)),
    "BS_PART_PREFERENCE": Factor(lambda c: F.col("_pref_PART"), ("part",), F.max),
    "LAYER_PREFERENCE": Factor(lambda c: F.col("_pref_LAYER"), ("layer",)),
    "RESOURCE_PREFERENCE": Factor(lambda c: F.col("_pref_RESOURCE"), ("resource",)),
    "LOT_PRIORITY": Factor(lambda c: F.col("_pref_LOT_PRIORITY"), ("priority",)),
    # D10 size and progress
    "WAFER_COUNT": Factor(lambda c: F.col("QTY") / F.lit(c.wafers_per_lot)),
    "BS_WAFER_COUNT": Factor(lambda c: F.col("QTY") / F.lit(c.max_wafer), over=F.sum),
    "LOT_PROGRESS": Factor(lambda c: F.try_divide(F.col("STEP_SEQ").cast("double"), F.col("N_STEPS"))),
    "LOT_GROUP": Factor(lambda c: F.col("_group_n") / F.col("_group_most"), ("group",)),
    # D11 arrival and switch: minutes count below zero
    "ATSTEP": Factor(_at_step),
    "BS_ATSTEP": Factor(_at_step, over=F.min),
    "STEP_ETA": Factor(_eta),
    "MAX_STEP_ETA": Factor(_eta, over=F.min),
    "SWITCH_TIME": Factor(lambda c: -F.col("_switch"), ("switch",)),
}


def _ordered(names: Sequence[str]) -> list[str]:
    """The lookups of the factors, each behind those it builds on."""
    out: list[str] = []

    def add(lookup: str) -> None:
        for other in LOOKUPS[lookup][1]:
            add(other)
        if lookup not in out:
            out.append(lookup)

    for name in names:
        for lookup in FACTORS[name].needs:
            add(lookup)
    return out


def evaluate(lots: DataFrame, names: Sequence[str], ctx: Context) -> DataFrame:
    """``lots`` with a double column per factor name; unknown names raise.

    A lot is one row; a missing date or quantity gives NULL, an equipment
    without a last run equals lots whose value is NULL, too.
    """
    unknown = [n for n in names if n not in FACTORS]
    if unknown:
        raise ValueError(f"unknown factors {unknown}")
    x = lots
    for lookup in _ordered(names):
        x = LOOKUPS[lookup][0](x, ctx)
    x = x.select(*lots.columns, *[FACTORS[n].value(ctx).cast("double").alias(n) for n in names])
    batched = [n for n in names if FACTORS[n].over]
    if not batched:
        return x
    key = ["EQP_ID", "STEP_ID"]
    x = frames.row_number_by(x, key, list(ctx.arrival), "_rn").withColumn("_batch", F.floor((F.col("_rn") - 1) / ctx.max_lot))
    per = x.groupBy(*key, "_batch").agg(*[FACTORS[n].over(F.col(n)).alias(f"_v_{n}") for n in batched])
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*key, "_batch"]]
    j = x.alias("x").join(per.alias("b"), on[0] & on[1] & on[2])
    return j.select(*[F.col(f"x.{c}").alias(c) for c in lots.columns],
                    *[(F.col(f"_v_{n}") if n in batched else F.col(f"x.{n}")).alias(n) for n in names])
