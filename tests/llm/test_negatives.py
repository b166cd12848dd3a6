"""Hard negatives against brute force over all rows."""
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.llm import negatives, queries


def _brute(rows, every=5, positives=5, negatives_=3):
    known = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in vector]
        known[i] = min(known.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in known.items():
        if a % every:
            continue
        scores = sorted((-dot(q, r), i, k) for i, (k, r) in known.items() if i != a)
        for ps, p in [(-s, i) for s, i, k in scores if k == label][:positives]:
            found = [(i, -s) for s, i, k in scores if k != label and 50 * ps <= -100 * s <= 95 * ps][:negatives_]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(found, 1)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows],
                                 "vec_id long, embedding array<float>, label int, id int, score string, number double")


def _rows(seed, n=400, dim=20):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = []
    for i in range(n):
        c = int(rnd.integers(12))
        rows.append((i, f32(centres[c] + rnd.normal(size=dim) * rnd.choice([0, .05, .5])), int(rnd.choice([c % 4, 0, 0, 3]))))
    rows += [(1000, None, 1), (1005, f32([1.0] * dim), None), (None, f32([1.0] * dim), 1), (1010, [1.0, None], 1),
             (1015, [float("nan")] * dim, 0), (1020, [float("inf")] * dim, 0), (1025, [], 0), (1030, [0.0] * dim, 2),
             (1035, f32(centres[0][:5]), 0), (1040, f32(centres[0]) + [1.0], 3), (1045, f32([1e9] * dim), 0),
             (1050, f32(centres[3]), 77), (5, f32(centres[1]), 0), (5, f32(centres[1]), 0), (7, f32(centres[2]), 3)]
    return rows


@pytest.mark.parametrize("seed, blocks", [(1, (4096, 512, 16)), (2, (37, 7, 4)), (3, (50, 9, 3))])
def test_negatives_match_brute_force(spark, seed, blocks, monkeypatch):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "DIMENSIONS"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = _rows(seed, 250)
    got = negatives.mine_negatives(_frame(spark, rows), F.col("id") % 5 == 0).collect()
    want = _brute(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_threshold_join_prunes_and_loses_nothing():
    rnd = np.random.default_rng(4)
    rows = (rnd.normal(size=(600, 48)) * np.geomspace(300, 1, 48)).astype(np.int32)
    anchors = rows[:40]
    scores = anchors.astype(np.int64) @ rows.T.astype(np.int64)
    for share in (0.01, 0.3, 0.9):
        least = np.quantile(scores, 1 - share, axis=1)
        found = {(i, j): s for a, y, v in negatives.threshold_join(anchors, least, rows) for i, j, s in zip(a.tolist(), y.tolist(), v.tolist())}
        i, j = np.nonzero(scores >= least[:, None])
        assert found == {(a, b): int(scores[a, b]) for a, b in zip(i.tolist(), j.tolist())}
    assert sum(len(v) for _, _, v in negatives.threshold_join(anchors, np.full(40, np.inf), rows)) == 0
    assert sum(len(v) for _, _, v in negatives.threshold_join(anchors, np.full(40, -np.inf), rows)) == 40 * 600


def test_every_pair_of_blocks_meets_once_per_search(spark, monkeypatch):
    """Windows that do not fill took a search per threshold before, up to seven in all."""
    searches, search = [], negatives._search
    monkeypatch.setattr(negatives, "_search", lambda *a: searches.append(a[3]) or search(*a))
    rows = _rows(5, 60)
    got = negatives.mine_negatives(_frame(spark, rows), F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == _brute(rows) and searches == [True, False]


def test_thresholds_rise_with_the_rows_found(monkeypatch):
    rows = np.random.default_rng(6).integers(-100, 100, (5000, 32)).astype(np.int32)
    join, looked = negatives.threshold_join, []

    def counted(*args):
        for found in join(*args):
            looked.append(len(found[0]))
            yield found

    monkeypatch.setattr(negatives, "threshold_join", counted)
    ids = np.arange(5000)
    indexes = [x for p in (0, 2500) for _, x in negatives._slices(0, ids[p:p + 2500], rows[p:p + 2500], not p)]
    w, found, score = negatives._best(ids[:20], rows[:20], np.arange(21), np.full(20, -np.inf), np.full(20, np.inf), indexes, 5)
    scores = rows[:20].astype(np.int64) @ rows.T.astype(np.int64)
    np.fill_diagonal(scores, -(1 << 40))
    want = [(a, b, scores[a, b]) for a in range(20) for b in np.lexsort((ids, -scores[a]))[:5]]
    assert list(zip(w, found, score)) == want and sum(looked) < 20 * 5000 / 10


def test_exact_beyond_doubles():
    rows = np.full((3, 64), (1 << 24) - 1, np.int32)
    rows[1, 0] -= 1
    (_, _, found), = negatives.threshold_join(rows[:1], np.array([-np.inf]), rows)
    whole = 64 * ((1 << 24) - 1) ** 2
    assert sorted(found.tolist()) == [whole - (1 << 24) + 1, whole, whole]


def test_empty_table(spark):
    assert negatives.mine_negatives(_frame(spark, []), F.col("id") % 5 == 0).collect() == []


def test_sql_matches_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, sf_dir).collect())) == sorted(con.sql(queries.OP12_SQL).fetchall())
