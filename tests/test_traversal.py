"""Allocation and BFS inside tasks, in rounds, and in shards, against a plain loop."""
import random
from collections import deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotline.operators import allocate as A
from lotline.operators import traversal


def _graph(spark, seed, n=40, parts=4):
    """Random components, a chain among them, with loops, repeated edges and a node without any."""
    rnd = random.Random(seed)
    caps = {k: rnd.choice([0, 0, 1, 2]) for k in range(n)}
    ends = [(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(n)) if a % parts == b % parts and a != n - 1 != b]
    ends += [(k, k + parts) for k in range(0, n - 2 * parts, parts)] + ends[:3] + [(5, 5)]
    edges = [(a, b, rnd.randrange(n)) for a, b in ends]
    nodes = spark.createDataFrame([(k, c, 0) for k, c in caps.items()], "NODE_ID bigint, CAP bigint, SEQ bigint")
    nd, adj = A.build_graph(nodes, spark.createDataFrame(edges, "SRC bigint, DST bigint, EDGE_SEQ bigint"))
    first = {}
    for a, b, s in edges:
        for x, y in ((a, b), (b, a)):
            first[x, y] = min(first.get((x, y), s), s)
    near = {k: [y for _, y in sorted((s, y) for (x, y), s in first.items() if x == k)] for k in caps}
    return caps, near, nd.select("NODE_ID", "CAP", F.col("CAP").alias("FREE")), adj


def _order(near, start):
    queue, level = deque([start]), {start: 0}
    while queue:
        at = queue.popleft()
        yield at, level[at]
        for other in near[at]:
            if other not in level:
                level[other] = level[at] + 1
                queue.append(other)


SIZES = [{}, {"FITS": 0}, {"FITS": 25}, {"WORK": 30, "GROUP_ROWS": 10}]


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_bfs_ranks_match_a_queue(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(A, name, value)
    caps, near, free, adj = _graph(spark, 3)
    starts = spark.createDataFrame([(k,) for k in [*caps, 99]], "START_ID bigint")
    want = set()
    for start in caps:
        room = 0
        for rank, (node, level) in enumerate(_order(near, start), 1):
            room += caps[node]
            want.add((start, node, rank, level, caps[node], room))
    got = A.bfs_ranks(starts, free, adj).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_allocation_matches_a_loop(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(A, name, value)
    caps, near, free, adj = _graph(spark, 4)
    rnd = random.Random(5)
    asked = [(k, rnd.choice([*caps, 2, 2, 99, None])) for k in range(120)]
    room, want = dict(caps), {}
    for k, start in asked:
        want[k] = next((v for v, _ in _order(near, start) if room[v] > 0), None) if start in caps else None
        if want[k] is not None:
            room[want[k]] -= 1
    got = A.allocate_bfs(spark.createDataFrame(asked, "REQ_NO bigint, START_ID bigint"), free, adj)
    assert {r.REQ_NO: r.NODE_ID for r in got.collect()} == want
    assert {r.NODE_ID: r.REMAINING for r in A.remaining(free, got).collect()} == room


def test_components_that_fit_take_no_rounds(spark, monkeypatch):
    """Before, every component was searched and served in rounds of jobs, as many as its paths are long."""
    monkeypatch.setattr(A, "Frontier", None)
    n = 300
    nodes = spark.createDataFrame([(k, 1, 0) for k in range(n)], "NODE_ID bigint, CAP bigint, SEQ bigint")
    nd, adj = A.build_graph(nodes, spark.createDataFrame([(k, k + 1, k) for k in range(n - 1)], "SRC bigint, DST bigint, EDGE_SEQ bigint"))
    free = nd.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))
    got = A.bfs_ranks(spark.createDataFrame([(0,), (299,)], "START_ID bigint"), free, adj).collect()
    assert len(got) == 2 * n and all(r.LEVEL == r.RANK - 1 == abs(r.START_ID - r.NODE_ID) for r in got)
    asked = spark.createDataFrame([(k, 0) for k in range(n + 10)], "REQ_NO bigint, START_ID bigint")
    assert {r.REQ_NO: r.NODE_ID for r in A.allocate_bfs(asked, free, adj).collect()} == {k: k if k < n else None for k in range(n + 10)}


def test_searches_that_hold_too_much_begin_anew(spark, monkeypatch):
    monkeypatch.setattr(traversal, "HELD", 3)
    monkeypatch.setattr(traversal, "PLACES", 7)

    rows = [(0, 0, 0, k, None, None, 1, None) for k in range(5)]
    rows += [(0, 0, 1, a, b, a, None, None) for k in range(4) for a, b in ((k, k + 1), (k + 1, k))]
    rows += [(0, 0, 2, k % 5, None, None, None, k) for k in (0, 5, 1, 10, 3, 15)]
    names = ["COMP", "_shard", "_kind", "NODE_ID", "NBR", "EDGE_SEQ", "FREE", "REQ_NO"]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int32() if n in ("_shard", "_kind") else pa.int64()) for i, n in enumerate(names)})
    graph = traversal.Graph(table, "REQ_NO")
    # in the order of the requests: 0, 1, 3, 5 (node 0), 10 (node 0), 15 (node 0)
    assert graph.values.take(pa.array(graph.code[graph.allocate()[:5]])).to_pylist() == [0, 1, 3, 2, 4] and graph.allocate()[5] == -1
    assert sum(len(x[0]) for x in graph.ranks()) == 6 * 5
