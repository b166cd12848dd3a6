"""Scale helpers shared by the operators.

``running_by_group`` is the workhorse for every "running value in arrival
order" the library needs (global row numbers, per-table batch ids, running
sums, merged interval ends).  A plain ``Window.partitionBy(g).orderBy(o)``
puts a whole group in one task, so one hot group (a third of the rows) would
serialise the job.  Here the rows are range-partitioned on ``(g, o)`` instead,
so even a single huge group is cut into evenly sized, ordered slices:

1. ``repartitionByRange(P, g, o)`` and tag each row with its slice id;
2. running values inside each ``(g, slice)`` with an ordinary window;
3. one total per ``(g, slice)`` (an aggregate: one row per group and slice);
4. (the sliced rows are checkpointed once so that steps 3 and 5 agree on
   the slices, and executor loss cannot re-slice them);
5. the carry-in of each slice is the running total of the earlier slices of
   the same group.  Only the first group of a slice can have earlier slices,
   so the carry table holds at most ``P`` rows and is broadcast safely.

The result is exact and independent of ``P``; the caller must give a total
order (ties broken by a unique column).
"""
from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.session import ensure_checkpoint_dir

_KINDS = ("count", "sum", "max", "min")
#: A group of more rows than this is cut into slices where the sizes are looked at (:func:`by_size`).
LARGEST = 1_000_000
#: Rows of one task where the number of tasks follows the rows (:func:`by_size`, :func:`slices_for`).
ROWS_PER_TASK = 500_000
SIZE_BUCKETS = 1 << 14


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def running_by_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    specs: Mapping[str, tuple[str, str | Column | None]],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running aggregates per ``group`` in ``order``.

    ``specs`` maps an output column to ``(kind, column)`` with kind one of
    count (a 1-based row number; column ignored), sum, max, min; ``sum_before``,
    ``max_before`` and ``min_before`` leave the row itself out.
    """
    for kind, _ in specs.values():
        if kind.removesuffix("_before") not in _KINDS:
            raise ValueError(f"unknown running kind {kind!r}")
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [_c(o) for o in order]
    group = list(group)
    x = df.repartitionByRange(n, *[F.col(g) for g in group], *order_cols).withColumn(
        "_slice", F.spark_partition_id()
    )
    w = Window.partitionBy(*group, "_slice").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = []
    totals = []
    for name, (kind, col) in specs.items():
        if kind == "count":
            local.append(F.row_number().over(w).alias(f"_l_{name}"))
            totals.append(F.count(F.lit(1)).alias(f"_t_{name}"))
        else:
            fn = getattr(F, kind.removesuffix("_before"))
            local.append(fn(_c(col)).over(before if kind.endswith("_before") else w).alias(f"_l_{name}"))
            totals.append(fn(_c(col)).alias(f"_t_{name}"))
    # Both the totals and the final rows must see the *same* slices; two
    # independently planned range exchanges may sample different bounds, so
    # the sliced rows are written once to the shared checkpoint folder.
    x = checkpoint(x.select("*", *local))
    tot = x.groupBy(*group, "_slice").agg(*totals)
    wc = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, (kind, _) in specs.items():
        kind = kind.removesuffix("_before")
        fn = F.sum if kind in ("count", "sum") else getattr(F, kind)
        carry_cols.append(fn(f"_t_{name}").over(wc).alias(f"_o_{name}"))
    carry = tot.select(
        *[F.col(g).alias(f"_k_{g}") for g in group], F.col("_slice").alias("_k_slice"),
        F.count(F.lit(1)).over(wc).alias("_prev"), *carry_cols,
    ).where(F.col("_prev") > 0)
    # at most one carried group per slice -> at most n rows: safe to broadcast
    carry = F.broadcast(carry.drop("_prev"))
    on = None
    for g in [*group, "slice"]:
        e = F.col("_slice" if g == "slice" else g).eqNullSafe(F.col(f"_k_{g}"))
        on = e if on is None else on & e
    j = x.join(carry, on, "left")
    out = [F.col(c) for c in df.columns]
    for name, (kind, _) in specs.items():
        lv, ov = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        kind = kind.removesuffix("_before")
        if kind in ("count", "sum"):
            # a slice that has had only NULLs so far keeps the sum of the slices before it
            out.append(F.coalesce(ov + lv, lv, ov).alias(name))
        elif kind == "max":
            out.append(F.greatest(lv, ov).alias(name))
        else:
            out.append(F.least(lv, ov).alias(name))
    return j.select(*out)


def running_within(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                   specs: Mapping[str, tuple[str, str | Column | None]]) -> DataFrame:
    """:func:`running_by_group` by plain windows, for groups that fit a task: one exchange (none behind one by group)."""
    w = Window.partitionBy(*group).orderBy(*[_c(o) for o in order])
    to = {"": w.rowsBetween(Window.unboundedPreceding, Window.currentRow), "_before": w.rowsBetween(Window.unboundedPreceding, -1)}
    out = []
    for name, (kind, col) in specs.items():
        if kind == "count":
            out.append(F.row_number().over(w).cast("bigint").alias(name))
        else:
            plain = kind.removesuffix("_before")
            out.append(getattr(F, plain)(_c(col)).over(to[kind[len(plain):]]).alias(name))
    return df.select("*", *out)


def by_size(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that fit a task, partitioned by group, and rows of large groups (None without any).

    The rows are counted by hash of the group, added up before the shuffle: a
    bucket with more than ``LARGEST`` holds a large group.  The partitions grow
    in number with the rows, so that a task's memory does not.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(SIZE_BUCKETS))
    counted = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    rows, large = counted.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > LARGEST, F.col("_b")))).first()  # SIZE_BUCKETS at most
    tasks = -(-(rows or 0) // ROWS_PER_TASK)
    more = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (lambda x: x.repartition(tasks, *group)) if more else (lambda x: x.repartition(*group))
    if not large:
        return dealt(df), None
    return dealt(df.where(~bucket.isin(large))), df.where(bucket.isin(large))


def row_number_by(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rn",
                  partitions: int | None = None) -> DataFrame:
    """Skew-safe ``row_number() over (partition by group order by order)``."""
    return running_by_group(df, group, order, {name: ("count", None)}, partitions)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the cluster's shared checkpoint folder (never local).

    A table is written rather than an RDD: an RDD checkpoint keeps the size
    that the optimizer guessed for its plan, and in a loop those guesses
    multiply until planning alone takes minutes; a table has its real size.
    """
    return written(df, "checkpoint")


def scratch_path(spark, name: str) -> str:
    """A fresh path for an intermediate table, in the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/lotline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def tasks_for(rows: int, per_task: int = 20_000, least: int = 12) -> int:
    """How many tasks (and files) suit this many rows."""
    return max(least, -(-rows // per_task))


def slices_for(df: DataFrame) -> int:
    """Slices of ``ROWS_PER_TASK`` rows, at least the shuffle's partitions, so that a task's memory does not grow with the rows.

    The rows are counted: call it on what is cheap to count, like rows of a table before they are parsed.
    """
    return tasks_for(df.count(), ROWS_PER_TASK, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str = "table", tasks: int | None = None) -> DataFrame:
    """Cut lineage through a Parquet table in the shared checkpoint folder.

    Like :func:`checkpoint`, but columnar and compressed, so later reads are
    pruned to the columns they use, and a lost executor costs a re-read only.
    With ``tasks``, partitions are put together into that many at most, so that
    a table far smaller than the shuffle's partitions is not as many files.
    """
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_scratch(spark) -> None:
    """Delete every intermediate table of this application.

    Lazy results may still read them: call it once the results are written.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/lotline-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def neighbour(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], cols: Sequence[str],
              offset: int = 1, prefix: str = "next_", partitions: int | None = None) -> DataFrame:
    """Skew-safe ``lead``/``lag``: ``offset=1`` is the next row, ``-1`` the previous.

    ``lead``/``lag`` inside range-partitioned slices; only a slice's edge row
    has its neighbour in another slice.  Those edge rows, one per group and
    slice, are put in order by a window over slices, and the at most one per
    slice that continues a group is broadcast: no self-join of the rows.
    """
    if offset not in (1, -1):
        raise ValueError("offset must be 1 or -1")
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group, order_cols = list(group), [_c(o) for o in order]
    step, back = (F.lead, F.lag) if offset == 1 else (F.lag, F.lead)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order_cols)
    item = F.struct(*[F.col(c) for c in cols])
    x = df.repartitionByRange(n, *[F.col(g) for g in group], *order_cols).withColumn("_slice", F.spark_partition_id())
    x = checkpoint(x.select("*", step(item).over(inside).alias("_near"),
                            back(F.lit(1)).over(inside).isNull().alias("_edge")))
    over = Window.partitionBy(*group).orderBy("_slice")
    edges = x.where("_edge").select(*group, "_slice", item.alias("_item")).select(
        *[F.col(g).alias(f"_k_{g}") for g in group], F.col("_slice").alias("_k_slice"),
        step("_item").over(over).alias("_far")).where(F.col("_far").isNotNull())
    on = F.col("_slice") == F.col("_k_slice")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    j = x.join(F.broadcast(edges), on, "left").withColumn("_near", F.coalesce("_near", "_far"))
    return j.select(*[F.col(c) for c in df.columns], *[F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in cols])


def beside(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], cols: Sequence[str],
           ahead: str = "next_", behind: str = "prev_", partitions: int | None = None) -> DataFrame:
    """``lead`` and ``lag`` of the columns in one pass over the slices (see :func:`neighbour`)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group, order_cols = list(group), [_c(o) for o in order]
    inside = Window.partitionBy(*group, "_slice").orderBy(*order_cols)
    item = F.struct(*[F.col(c) for c in cols])
    x = df.repartitionByRange(n, *[F.col(g) for g in group], *order_cols).withColumn("_slice", F.spark_partition_id())
    x = checkpoint(x.select("*", F.lead(item).over(inside).alias("_ahead"), F.lag(item).over(inside).alias("_behind")))
    ends = x.where("_ahead is null or _behind is null").groupBy(*group, "_slice").agg(
        F.max(F.when(F.col("_behind").isNull(), item)).alias("_first"), F.max(F.when(F.col("_ahead").isNull(), item)).alias("_last"))
    over = Window.partitionBy(*group).orderBy("_slice")
    far = ends.select(*[F.col(g).alias(f"_k_{g}") for g in group], F.col("_slice").alias("_k_slice"),
                      F.lead("_first").over(over).alias("_far_ahead"), F.lag("_last").over(over).alias("_far_behind"))
    far = far.where("_far_ahead is not null or _far_behind is not null")  # two groups of a slice at most
    on = F.col("_slice") == F.col("_k_slice")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    j = x.join(F.broadcast(far), on, "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("_ahead", "_far_ahead").alias("_ahead"), F.coalesce("_behind", "_far_behind").alias("_behind"))
    return j.select(*[F.col(c) for c in df.columns], *[F.col(f"_ahead.{c}").alias(f"{ahead}{c}") for c in cols],
                    *[F.col(f"_behind.{c}").alias(f"{behind}{c}") for c in cols])


def chunked_lists(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], items: Column,
                  chunk: int = 1000, partitions: int | None = None) -> DataFrame:
    """Ordered item lists per group, cut into rows of at most ``chunk`` items.

    A plain ``collect_list`` per group would build one unbounded value in one
    task for a hot group; numbering the rows first and grouping by
    ``(group, chunk_no)`` bounds every list.  Groups that fit a task (see
    :func:`by_size`) are numbered and listed behind one exchange, large ones
    skew-safe in slices.  Output: group columns, CHUNK_NO,
    N_ITEMS, ITEMS (array in ``order``).
    """
    small, large = by_size(df, group)

    def lists(numbered: DataFrame, item: Column) -> DataFrame:
        g = numbered.groupBy(*group, F.floor((F.col("_pos") - 1) / F.lit(chunk)).cast("bigint").alias("CHUNK_NO"))
        agg = g.agg(F.count(F.lit(1)).alias("N_ITEMS"),
                    F.array_sort(F.collect_list(F.struct(F.col("_pos"), item.alias("_item")))).alias("_s"))
        return agg.select(*group, "CHUNK_NO", "N_ITEMS", F.transform("_s", lambda s: s["_item"]).alias("ITEMS"))

    out = lists(running_within(small, group, order, {"_pos": ("count", None)}), items)
    if large is None:
        return out
    large = large.withColumn("_item", items)
    if all(isinstance(o, str) for o in order):  # what is written holds no more than the lists need
        large = large.select(*dict.fromkeys([*group, *order, "_item"]))
    return out.unionByName(lists(row_number_by(large, group, order, "_pos", partitions), F.col("_item")))
