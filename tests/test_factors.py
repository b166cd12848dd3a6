"""Weight factors: every name, values that vary, batches, reuse of fixed values."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotline.functions.calendar import ntz
from lotline.operators import dispatch
from lotline.operators import factors as X
from lotline.plans import q_dispatch as Q
from lotline.sources import views as V

NOW = dt.datetime(2024, 1, 10)


def test_every_name_is_registered_and_no_column_is_constant(spark):
    names = [n for group in Q.FACTOR_GROUPS.values() for n in group]
    assert sorted(names) == sorted(X.FACTORS) and len(names) == 26
    sf_dir = "/root/testdata/sf0.01"
    found = X.evaluate(V.factor_lots(spark, sf_dir), names, Q.factor_context(spark, sf_dir))
    distinct = found.agg(*[F.count_distinct(n).alias(n) for n in names]).first().asDict()
    assert min(distinct.values()) > 1, distinct


def _lots(spark):
    day = lambda n: NOW + dt.timedelta(days=n)
    row = lambda lot, eqp, arrival, qty, part, recipe, limit: (lot, eqp, "S", 1, day(arrival) if arrival is not None else None,
                                                               day(-20), day(2), qty, part, "L", recipe, 1, 5, 10, 24.0, limit)
    rows = [row(1, 1, -2, 10, 7, "A", 96.0), row(2, 1, -1, 20, 8, "A", 24.0), row(3, 1, 1, 25, 7, "B", 48.0), row(4, 2, None, None, 7, None, 0.0)]
    return spark.createDataFrame(rows, "LOT_ID long, EQP_ID long, STEP_ID string, GROUP_ID long, ARRIVAL timestamp_ntz, CREATED timestamp_ntz, "
                                       "DUE timestamp_ntz, QTY int, PART_ID long, LAYER_ID string, RECIPE_ID string, STACK_ID long, STEP_SEQ int, "
                                       "N_STEPS int, REMAIN_HOURS double, Q_LIMIT_HOURS double")


def test_values_of_lots_and_batches(spark):
    last = spark.createDataFrame([(1, 7, "A", 1)], "EQP_ID long, LAST_PART long, LAST_RECIPE string, LAST_STACK long")
    switches = spark.createDataFrame([(1, "A", "B", 12.0)], "EQP_ID long, FROM_RECIPE string, TO_RECIPE string, MINUTES double")
    prefs = {"PART": spark.createDataFrame([(7, 0.5), (7, 0.75)], "PART_ID long, PREF double")}
    ctx = X.Context(ntz(NOW), last, prefs, switches, norm_hours=24.0 * 10, max_lot=2)
    got = {r.LOT_ID: r for r in X.evaluate(_lots(spark), list(X.FACTORS), ctx).collect()}
    assert [got[k].STEP_WAIT for k in (1, 2, 3, 4)] == [0.2, 0.1, 0.0, None]
    assert [got[k].BS_STEP_WAIT for k in (1, 2, 3)] == [0.2, 0.2, 0.0]          # lots 1 and 2 are one batch
    assert [got[k].QTIME for k in (1, 2, 3, 4)] == [0.5, 0.0, 1.5, None] and [got[k].BS_QTIME for k in (1, 2, 3)] == [0.0, 0.0, 1.5]
    assert [got[k].LOT_AGE for k in (1, 4)] == [1.0, 1.0] and got[1].CRITICAL_RATIO == 2.0
    assert [(got[k].SAME_RECIPE, got[k].STABLE, got[k].DIFF_STABLE, got[k].BS_STABLE) for k in (1, 2, 3)] == [
        (1, 1, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)]
    assert got[4].SAME_RECIPE == 1 and got[4].STABLE == 0
    assert [got[k].SWITCH_TIME for k in (1, 2, 3, 4)] == [0, 0, -12, 0]
    assert [got[k].BS_PART_PREFERENCE for k in (1, 2, 3)] == [0.75, 0.75, 0.75] and got[2].PART_PREFERENCE == 0 and got[1].RESOURCE_PREFERENCE == 0
    assert [got[k].BS_WAFER_COUNT for k in (1, 2, 3)] == pytest.approx([0.3, 0.3, 0.25]) and got[1].LOT_PROGRESS == 0.5
    assert [(got[k].ATSTEP, got[k].STEP_ETA, got[k].MAX_STEP_ETA) for k in (1, 3)] == [(1, 0, 0), (0, -1440, -1440)]
    assert got[4].ATSTEP == 0 and got[4].WAFER_COUNT is None and got[1].LOT_GROUP == 1
    with pytest.raises(ValueError, match="unknown factors"):
        X.evaluate(_lots(spark), ["AGE_OF_LOT"], ctx)


def test_fixed_values_are_reused_and_step_values_are_of_the_first_lot(spark):
    rows = [(1, 1, "S", 1, 5.0), (1, 1, "S", 3, 9.0), (2, 1, "S", 2, 7.0), (2, 1, "T", 4, None), (3, 1, "T", 5, 8.0)]
    lots = spark.createDataFrame(rows, "LOT_ID long, EQP_ID long, STEP_ID string, AT int, V double")
    preset = spark.createDataFrame([(1, "p")], "EQP_ID long, PRESET string")
    factors = spark.createDataFrame([("p", "F", "FIXED", 1.0, 1), ("p", "S", "STEPTYPE", 1.0, 2), ("p", "L", "LOTTYPE", 1.0, 3)],
                                    "PRESET string, FACTOR string, TYPE string, WEIGHT double, ORD int")
    values = dispatch.factor_values(lots, preset, factors, {n: F.col("V") for n in "FSL"}, ["AT"])
    got = {(r.AT, r.FACTOR): r.VALUE for r in values.collect()}
    assert [got[k, "F"] for k in (1, 2, 3, 4, 5)] == [5.0, 7.0, 5.0, 7.0, 8.0]
    assert [got[k, "S"] for k in (1, 2, 3, 4, 5)] == [5.0, 5.0, 5.0, None, None]
    assert [got[k, "L"] for k in (1, 2, 3, 4, 5)] == [5.0, 7.0, 9.0, None, 8.0]
