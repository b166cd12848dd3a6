"""Property tests against plain sequential definitions (SURVEY 5 (3))."""
import datetime as dt
import random
import sys
from collections import defaultdict, deque

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotline import frames
from lotline.operators import allocate as A
from lotline.operators import dedup


def test_running_by_group_matches_window_with_hot_key(spark):
    rnd = random.Random(7)
    rows = [(("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}"), i, rnd.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = frames.running_by_group(df, ["g"], ["o"], {"rn": ("count", None), "s": ("sum", "v"), "m": ("max", "v"),
                                                     "mi": ("min", "v")}, partitions=7)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.select("*", F.row_number().over(w).alias("rn"), F.sum("v").over(w).alias("s"),
                    F.max("v").over(w).alias("m"), F.min("v").over(w).alias("mi"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_neighbour_matches_lead_lag(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long")
    n = frames.neighbour(df, ["g"], ["o"], ["o"], 1, "next_")
    w = Window.partitionBy("g").orderBy("o")
    ref = df.select("*", F.lead("o").over(w).alias("next_o"))
    assert n.exceptAll(ref).count() == 0 and ref.exceptAll(n).count() == 0


def _ttl_seq(rows, ttl):
    last, keep = {}, []
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > ttl:
            keep.append(i)
            last[k] = t
    return sorted(keep)


def test_ttl_dedup_matches_sequential(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("aab"), t0 + dt.timedelta(seconds=rnd.randint(0, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = sorted(r.id for r in dedup.dedup_ttl(df, ["k"], "ts", ["id"], 10).collect())
    assert got == _ttl_seq(rows, 10)


def test_ttl_dedup_doubles_inside_segments_only(spark, monkeypatch):
    """Gaps over the ttl cut a key's rows; sparse keys need no round, a dense one those of its own chain."""
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    sparse = [(i, "s", at(11 * i)) for i in range(300)]
    bursts = [(1000 + i, rnd.choice("xyz"), at(1000 * (i // 6) + rnd.randint(0, 25))) for i in range(300)]
    written, checkpoint = [], frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    rounds = []
    for rows in (sparse, sparse + bursts):
        written.clear()
        df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
        kept = dedup.dedup_ttl(df, ["k"], "ts", ["id"], 10)
        rounds.append(len(written))
        assert sorted(r.id for r in kept.collect()) == _ttl_seq(rows, 10)
    assert rounds[1] - rounds[0] <= 2 * 2  # a burst of 25 s holds at most two jumps of more than 10 s
    odd = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, t0), (4, None, t0), (5, "a", t0), (6, "a", at(10))],
                                "id long, k string, ts timestamp_ntz")
    assert sorted(r.id for r in dedup.dedup_ttl(odd, ["k"], "ts", ["id"], 10).collect()) == [1, 2, 3, 5]
    assert dedup.dedup_ttl(odd.limit(0), ["k"], "ts", ["id"], 10).collect() == []


def _bfs(adj, s):
    seen, order, q = {s}, [s], deque([s])
    while q:
        u = q.popleft()
        for w in adj[u]:
            if w not in seen:
                seen.add(w); order.append(w); q.append(w)
    return order


def test_allocation_matches_sequential_on_random_graphs(spark):
    rnd = random.Random(11)
    for trial in range(3):
        n = rnd.randint(3, 12)
        caps = {i: rnd.randint(0, 3) for i in range(n)}
        edges = [(rnd.randrange(n), rnd.randrange(n), s) for s in range(rnd.randint(1, 2 * n))]
        edges = [e for e in edges if e[0] != e[1]]
        adj = defaultdict(list)
        for a, b, s in edges:
            adj[a].append(b); adj[b].append(a)
        reqs = [(i + 1, rnd.randrange(n + 2)) for i in range(rnd.randint(5, 30))]
        free = dict(caps); ref = {}
        for no, s in reqs:
            got = None
            if s < n:
                for c in _bfs(adj, s):
                    if free[c] > 0:
                        free[c] -= 1; got = c; break
            ref[no] = got
        nodes = spark.createDataFrame([(i, c, i) for i, c in caps.items()], "NODE_ID long, CAP int, SEQ long")
        ed = spark.createDataFrame(edges or [(0, 0, 0)], "SRC long, DST long, EDGE_SEQ long")
        if not edges:
            ed = ed.limit(0)
        nd, ad = A.build_graph(nodes, ed)
        fr = nd.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))
        rq = spark.createDataFrame(reqs, "REQ_NO long, START_ID long")
        got = {r.REQ_NO: r.NODE_ID for r in A.allocate_bfs(rq, fr, ad).collect()}
        assert got == ref, (trial, caps, edges, reqs)


def test_row_conservation_in_load_path(spark):
    from lotline.operators import load
    from lotline.sources.catalog import target_tables
    t = target_tables()["APP.ORDERS"]
    bodies = ['{"Table":"app.orders","Key":"1","Payload":{"ORDER_ID":1}}',
              '{"Table":"app.orders","Key":"1","Payload":{"ORDER_ID":1}}',
              '{"Table":"app.orders","Key":"2","Payload":{"ORDER_ID":2}}', '{oops', '{"Key":"3"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "seq long, body string")
    dec = load.decode_envelopes(df)
    bad = load.rejected(dec).count()
    rows = load.load_table(load.good(dec), t, keep=["seq"])
    kept = dedup.dedup_lifetime(rows, list(t.pk), ["seq"]).count()
    dups = rows.count() - kept
    assert (len(bodies), kept, dups, bad) == (5, 2, 1, 2)
    assert len(bodies) == kept + dups + bad
