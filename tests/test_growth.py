"""Work that must not grow faster than the input: plans, rounds, rows read."""
import datetime as dt

from pyspark.sql import functions as F

from lotline.operators import allocate as A
from lotline.operators import dispatch

T0 = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_allowed_equipment_is_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 1, T0), (2, 1, T0), (None, 1, T0)], "p long, s int, t timestamp_ntz")
    arrange = spark.createDataFrame([(1, 1, None, None, 7), (1, 1, T0, T0, 8), (2, 1, None, T0 - dt.timedelta(1), 9)],
                                    "p long, s int, START_TIME timestamp_ntz, END_TIME timestamp_ntz, e int")
    got = dispatch.eligible(rows, arrange.withColumn("s", F.explode(F.array("s"))), ["p", "s"], "t")
    assert "Broadcast" not in _plan(got)
    assert sorted((r.p, r.e) for r in got.collect()) == [(1, 7), (1, 8)]
    assert "Broadcast" not in _plan(got)


def test_bfs_expands_many_levels_at_once(spark):
    """Two paths and a hub against a queue; as many parts as blocks of levels, not as levels."""
    pairs = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 7)] + [(103, 3), (5, 9), (7, 7), (2, 102)]
    ids = sorted({x for p in pairs for x in p}) + [500]
    nodes = spark.createDataFrame([(i, i % 3, i) for i in ids], "NODE_ID long, CAP int, SEQ long")
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "SRC long, DST long, EDGE_SEQ long")
    nd, adj = A.build_graph(nodes, edges)
    near = {}
    for k, (a, b) in enumerate(pairs):
        near.setdefault(a, []).append((k, b))
        near.setdefault(b, []).append((k, a))
    want = set()
    for s in ids:
        queue, level = [s], {s: 0}
        for x in queue:
            for _, y in sorted(near.get(x, [])):
                if y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        room = 0
        for k, x in enumerate(queue):
            room += x % 3
            want.add((s, x, k + 1, level[x], room))
    front = A.Frontier(nd.select(F.col("NODE_ID").alias("START_ID")), nd.select("NODE_ID", F.col("CAP").alias("FREE")), adj)
    while front.expand() is not None:
        pass
    got = {tuple(r) for r in A._union(front.levels).select("START_ID", "NODE_ID", "RANK", "LEVEL", "CUM_FREE").collect()}
    assert got == want
    assert len(front.levels) <= 2 + max(w[3] for w in want) // A.LEVELS
