"""Groups that fit a task are exchanged once, large ones are cut into slices; both give the same rows (F1, F2, F7 by part)."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotline import frames
from lotline.operators import stats as S

T0 = dt.datetime(2024, 1, 1)


def _exchanges(df) -> int:
    """Exchanges by key of the whole plan; a plan that reads a written table of its own has others hidden."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "checkpoint-" not in plan
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def _track(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["A", "A", "A", "B", None]), rnd.choice([1, 1, 2, None]), T0 + dt.timedelta(minutes=rnd.randrange(90)),
             rnd.choice(["arrive", "in", "out"])) for _ in range(300)]
    return spark.createDataFrame(rows, "EQP_ID string, LOT long, TS timestamp_ntz, KIND string").repartition(5)


@pytest.mark.parametrize("least", [0, 70, 1 << 40])
def test_visits_are_the_same_in_slices_and_behind_one_exchange(spark, monkeypatch, least):
    want = sorted(S.eqp_plan(_track(spark), ["EQP_ID", "LOT"]).collect(), key=str)
    monkeypatch.setattr(frames, "LARGEST", least)
    monkeypatch.setattr(frames, "ROWS_PER_TASK", 20)
    got = S.eqp_plan(_track(spark), ["EQP_ID", "LOT"])
    if least == 1 << 40:
        assert _exchanges(got) == 1
    assert sorted(got.collect(), key=str) == want and len(want) > 50


@pytest.mark.parametrize("least", [0, 200, 1 << 40])
def test_lists_are_the_same_in_slices_and_behind_one_exchange(spark, monkeypatch, least):
    rows = [("h" if i % 3 else None if i % 2 else f"k{i % 7}", i * 7919 % 500, i) for i in range(500)]
    monkeypatch.setattr(frames, "LARGEST", least)
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    got = frames.chunked_lists(df, ["k"], [F.col("o").desc(), "v"], F.col("v"), chunk=9)
    if least == 1 << 40:
        assert _exchanges(got) == 1
    want = []
    for k in {r[0] for r in rows}:
        mine = [v for _, v in sorted((-o, v) for x, o, v in rows if x == k)]
        want += [(k, n // 9, len(mine[n:n + 9]), mine[n:n + 9]) for n in range(0, len(mine), 9)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_PER_TASK", 10)
    small, large = frames.by_size(spark.range(1000), ["id"])
    assert large is None and small.rdd.getNumPartitions() == 100


def test_levels_by_part_take_two_exchanges(spark):
    """By part and day, then by part."""
    events = spark.createDataFrame([("A", T0, 1, 2, 3)], "PART_ID string, DAY timestamp_ntz, IN_QTY int, OUT_QTY int, SCRAP_QTY int")
    assert _exchanges(S.fab_in_out(events)) == 2
