"""Connected components of an undirected edge list.

Alternating large-star and small-star steps: every step replaces each node's
links by links to the smallest neighbour, so a component becomes a star
around its smallest node in O(log^2 n) rounds whatever its diameter (a path
included).  Minima are combined before the shuffle and the joins are plain
equi-joins, which adaptive execution splits when a node has many links.
Nothing but the edge count and one checksum per round reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.frames import written


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("_m")).select(
        F.col("src"), F.least("src", "_m").alias("_m"))
    return (both.join(least, "src").where("dst > src")
            .select(F.col("dst").alias("src"), F.col("_m").alias("dst")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("_m"))
    moved = edges.join(least, "src").where("dst > _m").select(
        F.col("dst").alias("src"), F.col("_m").alias("dst"))
    return moved.unionByName(least.withColumnRenamed("_m", "dst")).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", tasks: int | None = None) -> DataFrame:
    """``(id, component)`` for every node with a link to another node.

    ``component`` is the smallest id that is reachable.  Null ends and loops
    are ignored, repeated edges count once; an empty input gives no rows.
    ``tasks`` bounds the files of each round's table (see ``frames.written``).
    """
    e = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).distinct()
    e = written(e, "edges", tasks)
    before = _signature(e)
    while before[0]:
        e = written(_small_star(_large_star(e)), "edges", tasks)
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
