"""Cases that once gave a wrong answer: nulls, ties, revisits, zero yields, fractions, cycles, long paths."""
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotline import frames, graph
from lotline.functions import coerce as C
from lotline.operators import allocate as A
from lotline.operators import dispatch, load, stats
from lotline.sources.catalog import target_tables

T0 = dt.datetime(2024, 1, 1)


def test_running_values_with_nulls(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else "k", i, None if i > 400 or rnd.random() < 0.3 else rnd.randint(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = frames.running_by_group(df, ["g"], ["o"], {"s": ("sum", "v"), "m": ("max", "v"), "mi": ("min", "v")}, partitions=7)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("mi"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


@pytest.mark.parametrize("offset", [1, -1])
def test_neighbours_across_slices(spark, offset):
    rnd = random.Random(2)
    rows = [(None if rnd.random() < 0.2 else rnd.choice("aaaaab"), i, None if i % 7 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = frames.neighbour(df, ["g"], [F.col("o").desc()], ["v", "o"], offset, "x_", partitions=9)
    w = Window.partitionBy("g").orderBy(F.col("o").desc())
    step = F.lead if offset == 1 else F.lag
    ref = df.select("*", step("v").over(w).alias("x_v"), step("o").over(w).alias("x_o"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_components_of_long_paths_and_random_graphs(spark):
    rnd = random.Random(3)
    names = list(range(2000))
    rnd.shuffle(names)
    path = list(zip(names, names[1:]))
    blobs = [(5000 + rnd.randrange(300), 5000 + rnd.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(path + blobs + [(9999, 9999), (None, 1), (path[0][1], path[0][0])], "src long, dst long")
    got = {r.id: r.component for r in graph.components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in path + blobs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in path + blobs if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert graph.components(df.limit(0)).collect() == []


def test_bfs_along_a_path(spark):
    n = 12
    nodes = spark.createDataFrame([(i, 1, i) for i in range(n)], "NODE_ID long, CAP int, SEQ long")
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(n - 1)], "SRC long, DST long, EDGE_SEQ long")
    nd, adj = A.build_graph(nodes, edges)
    free = nd.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))
    starts = spark.createDataFrame([(0,)], "START_ID long")
    got = {r.NODE_ID: (r.RANK, r.LEVEL, r.CUM_FREE) for r in A.bfs_ranks(starts, free, adj).collect()}
    assert got == {i: (i + 1, i, i + 1) for i in range(n)}


def test_visits_of_one_lot_stay_apart(spark):
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(None, 7, t(h), k) for h, k in ((1, "arrive"), (2, "in"), (3, "out"), (10, "arrive"), (11, "in"), (11, "in"), (12, "out"))]
    df = spark.createDataFrame(rows, "EQP_ID string, LOT_ID long, TS timestamp_ntz, KIND string")
    got = sorted((r.ARRIVAL_TS, r.START_TS, r.END_TS) for r in stats.eqp_plan(df, ["EQP_ID", "LOT_ID"]).collect())
    assert got == [(t(1), t(2), t(3)), (t(10), t(11), t(12))]


def test_queue_time_needs_a_later_end(spark):
    rows = [(1, T0, 1, "s"), (1, T0, 2, "e"), (1, T0 + dt.timedelta(hours=5), 3, "e"), (2, T0, 4, "e"), (2, T0, 5, "s")]
    df = spark.createDataFrame(rows, "lot long, ts timestamp_ntz, id long, k string")
    got = {r.LOT_ID: (r.QT_HOURS, r.STATUS) for r in stats.qtime_check(
        df, "lot", "ts", "id", F.col("k") == "s", F.col("k") == "e", 1.0, 9.0).collect()}
    assert got == {1: (5.0, "WARN"), 2: (None, "OPEN")}


def test_zero_yield_stays_zero(spark):
    df = spark.createDataFrame([("r", i, y, 1.0) for i, y in enumerate([0.9, 0.0, 0.8])], "ROUTE_ID string, STEP_SEQ int, YIELD double, CT_HOUR double")
    got = [round(r.CUM_YIELD, 9) for r in stats.route_cumulative(df).orderBy("STEP_SEQ").collect()]
    assert got == [0.9, 0.0, 0.0]


def test_bom_depth_and_cycles(spark):
    schema = "PARENT long, CHILD long, RATIO double"
    deep = spark.createDataFrame([(i, i + 1, 1.0) for i in range(80)], schema)
    assert stats.bom_explode(deep).agg(F.max("LEVEL")).first()[0] == 80
    cycle = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)], schema)
    with pytest.raises(ValueError, match="cycle"):
        stats.bom_explode(cycle)


def test_pegging_of_fractions_and_large_quantities(spark):
    schema = "p string, q double, o int"
    supply = spark.createDataFrame([("a", 0.1, i) for i in range(20)] + [("b", 1e12, 0), ("c", 0.0, 0), ("c", 2.0, 1)], schema)
    demand = spark.createDataFrame([("a", 0.3, i) for i in range(7)] + [("b", 5e11, 0), ("b", 7e11, 1), ("c", 1.0, 0), ("c", 1.0, 1)], schema)
    rows = sorted(stats.fifo_peg(supply, demand, "p", "q", ["o"], ["o"]).collect())
    a = [(r.DEMAND_SEQ, r.SUPPLY_SEQ, r.PEG_QTY) for r in rows if r.PRODUCT == "a"]
    assert a == [((k // 3) + 1, k + 1, 0.1) for k in range(20)]
    assert [(r.DEMAND_SEQ, r.SUPPLY_SEQ, r.PEG_QTY) for r in rows if r.PRODUCT == "b"] == [(1, 1, 5e11), (2, 1, 5e11)]
    assert [(r.DEMAND_SEQ, r.SUPPLY_SEQ, r.PEG_QTY) for r in rows if r.PRODUCT == "c"] == [(1, 2, 1.0), (2, 2, 1.0)]


def test_best_lot_by_lexicographic_score(spark):
    df = spark.createDataFrame([("t", 1, [1.0, 2.0], 1), ("t", 2, [1.0, 3.0], 2), ("t", 3, [1.0, 3.0], 3), ("t", 4, [1.0], 0)],
                               "TOOL string, LOT_ID long, SCORE array<double>, ARRIVAL int")
    assert [(r.LOT_ID, r.SCORE) for r in dispatch.best_lot(df, ["TOOL"], ["ARRIVAL"]).collect()] == [(2, [1.0, 3.0])]


def test_envelopes_that_are_rejected(spark):
    bodies = ['{"Table":"","Payload":{}}', '{"Table":"t"} trailing', '{"Table":"t"}{"Table":"u"}', '{"Table":"t","Key":"}{"}  ', '{"Table":"t"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "seq int, body string")
    got = {r.seq: r._reason for r in load.decode_envelopes(df).collect()}
    assert got == {0: load.R_NO_TABLE, 1: load.R_NOT_JSON, 2: load.R_NOT_JSON, 3: None, 4: None}


def test_the_last_of_repeated_keys_wins(spark):
    t = target_tables()["APP.ORDERS"]
    df = spark.createDataFrame([('{"Table":"app.orders","Payload":{"ORDER_ID":1,"order_id":2,"CUST_ID":3,"CUST_ID":4}}',)], "body string")
    row = load.load_table(load.good(load.decode_envelopes(df)), t).first()
    assert (row.ORDER_ID, row.CUST_ID) == (2, 4)


def test_dates_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-03-10T02:30:00",), ("2024-3-1",), ("2024-02-30",)], "s string")
        got = [(str(r.d), str(r.t)) for r in df.select(C.strict_date(F.col("s")).cast("string").alias("d"),
                                                       C.strict_timestamp(F.col("s")).cast("string").alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [d for d, _ in got] == ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "None", "None"]
    assert [t for _, t in got[:2]] == ["2024-03-10 02:30:00"] * 2


def _visits(spark, *events):
    rows = [("e", 7, T0 + dt.timedelta(hours=h), k) for h, k in events]
    df = spark.createDataFrame(rows, "EQP_ID string, LOT_ID long, TS timestamp_ntz, KIND string")
    hour = lambda t: None if t is None else (t - T0).total_seconds() / 3600
    found = stats.eqp_plan(df, ["EQP_ID", "LOT_ID"]).collect()
    return sorted(((hour(r.ARRIVAL_TS), hour(r.START_TS), hour(r.END_TS)) for r in found), key=str)


def test_back_to_back_and_zero_length_visits(spark):
    one, two = [(1, "arrive"), (2, "in"), (5, "out")], [(5, "arrive"), (6, "in"), (7, "out")]
    assert _visits(spark, *one, *two) == [(1, 2, 5), (5, 6, 7)]
    nothing = [(9, "arrive"), (9, "in"), (9, "out")]
    assert _visits(spark, *one, *two, *nothing) == [(1, 2, 5), (5, 6, 7), (9, 9, 9)]
    # a zero-length visit at the instant at which the one before ends, then another
    assert _visits(spark, *one, (5, "arrive"), (5, "in"), (5, "out"), (8, "arrive")) == [(1, 2, 5), (5, 5, 5), (8, None, None)]
    # a lost out: the next arrival opens a visit, and an out without one belongs to none
    assert _visits(spark, (1, "arrive"), (3, "arrive"), (4, "out")) == [(1, None, None), (3, None, 4)]
    assert _visits(spark, (1, "out"), (2, "arrive")) == [(2, None, None), (None, None, 1)]


def test_signs_of_yields(spark):
    df = spark.createDataFrame([("r", i, y, 1.0) for i, y in enumerate([0.9, 0.5, -0.2, -1.0, None])], "ROUTE_ID string, STEP_SEQ int, YIELD double, CT_HOUR double")
    got = [round(r.CUM_YIELD, 9) for r in stats.route_cumulative(df).orderBy("STEP_SEQ").collect()]
    assert got == [0.9, 0.45, -0.09, 0.09, 0.09]


def test_pegs_add_up_exactly_and_bad_quantities_raise(spark):
    side = lambda *q: spark.createDataFrame([("p", x, i) for i, x in enumerate(q)], "p string, q double, o int")
    pegs = stats.fifo_peg(side(0.1, 0.0, 0.1, 0.1), side(0.3), "p", "q", ["o"], ["o"], exact=True)
    assert pegs.agg(F.sum("PEG_QTY")).first()[0] == Decimal("0.3")
    assert sorted(r.SUPPLY_SEQ for r in pegs.collect()) == [1, 3, 4]
    for bad in (-1.0, None):
        with pytest.raises(Exception, match="must not be null or below zero"):
            stats.fifo_peg(side(1.0, bad), side(1.0), "p", "q", ["o"], ["o"]).collect()


def test_unknown_loads_are_not_admitted(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 2, 3.0), ("g", 3, None), ("g", 4, 3.0), ("g", 5, 1.0)], "g string, o int, l double")
    got = {r.o: r.ADMITTED for r in dispatch.admission(df, ["g"], ["o"], F.col("l"), F.lit(6.0)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_values_before_and_beside_a_row_over_slices(spark):
    rows = [(g, i, (i * 37) % 101) for g, n in (("a", 60), ("b", 1), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): r for r in frames.beside(frames.running_by_group(
        df, ["g"], ["i"], {"m": ("max_before", "v"), "s": ("sum_before", "v")}, 7), ["g"], ["i"], ["v"], partitions=7).collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j < i]
        mine = {j: v for h, j, v in rows if h == g}
        r = got[g, i]
        assert (r.m, r.s) == (max(before, default=None), sum(before) if before else None)
        assert (r.next_v, r.prev_v) == (mine.get(i + 1), mine.get(i - 1))
