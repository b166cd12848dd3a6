"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions.  Each direction's
projections are sorted, and a window centred on a vector's own projection
collects the vectors it collides with.  Only windows in the two tails of a
direction are used: two vectors of cosine c fall into one tail together far
more often than unrelated ones, the more so the further out the tail begins,
and few vectors are there at all.  Pairs that collide often enough are
verified by their cosine in double precision.

The tails, the number of directions and the count are worked out from the
number of vectors: a tail holds about ``tail_rows`` unrelated vectors at any
size, and a pair of exactly the threshold's cosine reaches the count with
probability ``recall``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.frames import tasks_for, written
from lotline.graph import components

MAX_DIRECTIONS = 32_768
_BLOCK = 256


@dataclass(frozen=True)
class Plan:
    tail: float
    window: float
    directions: int
    least: int


def collision_chance(cosine: float, tail: float, window: float) -> float:
    """Chance that both projections lie in the upper tail, at most a window apart."""
    normal, rest = NormalDist(), math.sqrt(max(1 - cosine ** 2, 1e-12))
    grid = np.linspace(tail, tail + 8, 2001)
    cdf = np.vectorize(normal.cdf)
    high = cdf((grid + window - cosine * grid) / rest)
    low = cdf((np.maximum(tail, grid - window) - cosine * grid) / rest)
    density = np.exp(-grid ** 2 / 2) / math.sqrt(2 * math.pi)
    return float(((high - low) * density).sum() * (grid[1] - grid[0]))


def make_plan(n: int, cosine: float, recall: float = 0.999, tail_rows: int = 32, collisions: float = 9.5) -> Plan:
    """Parameters for ``n`` vectors; ``collisions`` is the expected count of a pair at the threshold."""
    window = 2.5 * math.sqrt(2 - 2 * cosine)
    share = min(0.2, tail_rows / max(n, 1))
    while True:
        tail = NormalDist().inv_cdf(1 - share)
        chance = 2 * collision_chance(cosine, tail, window)
        directions = math.ceil(collisions / chance)
        if directions <= MAX_DIRECTIONS or share >= 0.2:
            break
        share *= 1.1  # so many vectors that the tails must begin further in
    missed, least, term = 0.0, 0, math.exp(-directions * chance)
    while missed + term <= 1 - recall:
        missed += term
        least += 1
        term *= directions * chance / least
    return Plan(tail, window, directions, max(1, least))


def _unit(column: pa.Array) -> list[np.ndarray]:
    """Each vector in double precision with length one."""
    out = []
    for v in column:
        x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
        x /= np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _projections(plan: Plan, seed: int):
    def run(batches):
        matrices: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = _unit(batch.column(1))
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                if dim not in matrices:
                    matrices[dim] = np.random.default_rng([seed, dim]).standard_normal(
                        (dim, plan.directions), dtype=np.float32)
                mine = np.flatnonzero(sizes == dim)
                for k in range(0, len(mine), _BLOCK):
                    rows = mine[k:k + _BLOCK]
                    p = np.array([vectors[i] for i in rows], np.float32) @ matrices[dim]
                    at, direction = np.nonzero(np.abs(p) >= plan.tail)
                    value = p[at, direction]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[at])),
                         pa.array((int(dim) << 32) + 2 * direction.astype(np.int64) + (value > 0)),
                         pa.array(np.abs(value))], names=["id", "line", "p"])
    return run


def _cosines(batches):
    for batch in batches:
        x, y = _unit(batch.column(2)), _unit(batch.column(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([float((a * b).sum()) for a, b in zip(x, y)], pa.float64())],
            names=["a", "b", "cosine"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.95,
                 recall: float = 0.999, tail_rows: int = 32, seed: int = 13) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of equal length are linked if their cosine, in double precision,
    is at least ``cosine`` and their pair is found; ``n_links`` counts the other
    rows linked directly.  Equal vectors are one class, whose rows are all
    linked.  Vectors that are null, empty or zero or hold a null or non-finite
    component link with nothing, and so do rows with a null id, whose component
    is null.  Other columns are ignored; an empty table gives no rows.
    """
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False))
    # zero has two signs: equal vectors must be equal as keys, too
    rows = rows.select("id", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.select("id", "v", "size"), "classes", tasks_for(vectors.count()))
    n = classes.count()
    tasks = tasks_for(n)
    plan = make_plan(n, cosine, recall, tail_rows)
    spots = written(classes.select("id", "v").repartition(tasks).mapInArrow(_projections(plan, seed), T.StructType(
        [T.StructField("id", kind), T.StructField("line", T.LongType()), T.StructField("p", T.FloatType())])), "projections")
    left = spots.select(F.col("id").alias("a"), F.col("line"), F.col("p").alias("pa"))
    right = spots.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("p").alias("pb"))
    met = left.join(right, (F.col("line") == F.col("line_b")) & (F.col("a") < F.col("b"))
                    & (F.abs(F.col("pa") - F.col("pb")) <= plan.window))
    pairs = written(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= plan.least)
                    .select("a", "b"), "pairs", tasks)
    ends = lambda x: classes.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    links = written(pairs.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "va", "vb").mapInArrow(
        _cosines, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType())]))
        .where(F.col("cosine") >= cosine).select("a", "b"), "links", tasks)
    labels = written(components(links, "a", "b", tasks), "labels", tasks)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("id").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    known = written(classes.join(counts.withColumnRenamed("a", "id"), "id", "left").join(labels, "id", "left").select(
        "v", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
        F.coalesce("component", "id").alias("root")), "classes", tasks)
    return rows.join(known, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col)))
