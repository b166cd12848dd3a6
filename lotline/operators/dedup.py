"""Deduplication (inventory B1-B6).

First arrival wins everywhere, by an explicit arrival column list.  Every
first-wins rule is an aggregate ``min_by(row, arrival)`` per key: Spark
combines it map-side, so a hot key is reduced to one row per task before the
shuffle instead of being sorted in one task as a window would.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline import frames
from lotline.functions.keys import canonical_key, key_part

R_KEY_REQUIRED = "key required"


def key_parts(df: DataFrame, cols: Sequence[str]) -> list[tuple[Column, bool]]:
    """The key columns, each with whether it is text."""
    types = dict(df.dtypes)
    return [(F.col(c), types[c] == "string") for c in cols]


def with_key(df: DataFrame, cols: Sequence[str], name: str = "DEDUP_KEY") -> DataFrame:
    """B1: canonical key text, plus its parts ``_<name>_0``, ... for grouping (a ``|`` in a value cannot collide)."""
    parts = key_parts(df, cols)
    return df.select("*", canonical_key(parts).alias(name), *[key_part(c, s).alias(f"_{name}_{i}") for i, (c, s) in enumerate(parts)])


def first_per_key(df: DataFrame, key: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Keep the first-arriving row of every key (a map-side-combined aggregate).

    Only the arrival columns are compared, so the other columns may be of any
    type (maps and variants included); they must tell all rows of a key apart.
    """
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_first"))
    return agg.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_lifetime(df: DataFrame, key_cols: Sequence[str], arrival: Sequence[str],
                   key_name: str = "DEDUP_KEY", group: Sequence[str] = ()) -> DataFrame:
    """One row per key for the lifetime of the table (no key columns -> no dedup)."""
    if not key_cols:
        return df.withColumn(key_name, F.lit(None).cast("string"))
    parts = [f"_{key_name}_{i}" for i in range(len(key_cols))]
    return first_per_key(with_key(df, key_cols, key_name), [*group, *parts], arrival).drop(*parts)


def dedup_batch(df: DataFrame, key_cols: Sequence[str], arrival: Sequence[str], batch: str = "BATCH_ID",
                key_name: str = "DEDUP_KEY", partitions: int | None = None) -> DataFrame:
    """B2: first arrival wins inside each batch; the key set starts empty per batch.

    With ``partitions``, whole batches are dealt over that many tasks: for batches of bounded size.
    """
    df = df.repartition(partitions, batch) if partitions else df
    return dedup_lifetime(df, key_cols, arrival, key_name, group=[batch])


def dedup_message_key(df: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """Rows with a NULL or empty key always pass; the others keep their first arrival."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    # a row without a key is a group of its own, told apart by its arrival: the input is read once
    own = df.withColumn("_own", F.when(blank, F.struct(*arrival)))
    return first_per_key(own, [key, "_own"], arrival).drop("_own")


def require_key(df: DataFrame, key: str) -> DataFrame:
    """A blank key is an error; reason column is NULL for accepted rows."""
    blank = F.col(key).isNull() | (F.trim(F.col(key)) == "")
    return df.withColumn("_reason", F.when(blank, F.lit(R_KEY_REQUIRED)))


def dedup_ttl(df: DataFrame, key: Sequence[str], ts: str, tie: Sequence[str], ttl_seconds: int) -> DataFrame:
    """Keep a row when more than ``ttl`` passed since the key's last *accepted* row.

    Exact and skew-safe.  A row that comes more than ``ttl`` after the row before
    it is accepted whatever was accepted earlier, so each key falls into segments
    at such gaps, and a row alone in its segment needs no more.  In the others
    ``next(i)`` is the first row of the same key later than ``ts_i + ttl``; the
    accepted rows are the chain start -> next -> next ... up to the segment's
    end.  ``next`` is an as-of lookup done with range-partitioned running minima
    (no per-key sort in one task); the chain is then marked by pointer
    doubling: each round joins the pointer table with itself on the row id,
    an evenly spread key, and doubles the jump length.  Rounds are
    ``log2(longest chain of a segment)``; lineage is cut each round by a checkpoint.
    Rows without a time are kept.
    """
    key = list(key)
    order = [ts, *tie]
    ids = frames.row_number_by(df, [], [*key, *order], "_id")        # dense ids in (key, ts, tie) order
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    ttl_us = F.lit(int(ttl_seconds) * 1_000_000)
    base = frames.beside(ids.select(*key, "_id", us.alias("_us")), key, ["_id"], ["_us"], "_next", "_prev")
    starts = F.coalesce(F.col("_us") - F.col("_prev_us") > ttl_us, F.lit(True))
    ends = F.coalesce(F.col("_next_us") - F.col("_us") > ttl_us, F.lit(True))
    # odd ids mark the starts of segments, so that a running minimum of ids says whether it left the segment
    base = frames.checkpoint(base.select(*key, (F.col("_id") * 2 + starts.cast("bigint")).alias("_id"), "_us",
                                         (starts & ends).alias("_alone")))
    odd = F.col("_id") % 2 == 1
    inner = base.where(~F.col("_alone")).drop("_alone")
    # as-of: first row of the key with _us > probe.  Union rows and probes in
    # descending time order with probes ahead of rows of the same time (the gap
    # must be strictly greater than ttl), and take the running minimum row id.
    rows = inner.select(*key, F.col("_us").alias("_t"), F.lit(0).alias("_kind"), F.col("_id").alias("_rid"),
                        F.lit(None).cast("bigint").alias("_pid"))
    probes = inner.select(*key, (F.col("_us") + ttl_us).alias("_t"), F.lit(1).alias("_kind"),
                          F.lit(None).cast("bigint").alias("_rid"), F.col("_id").alias("_pid"))
    u = rows.unionByName(probes)
    run = frames.running_by_group(
        u, key, [F.col("_t").desc(), F.col("_kind").desc(), F.col("_rid").desc_nulls_first(),
                 F.col("_pid").desc_nulls_first()],
        {"_next": ("min", "_rid")})
    jump = frames.checkpoint(run.where((F.col("_kind") == 1) & (F.col("_next") % 2 == 0)).select(
        F.col("_pid").alias("_id"), F.col("_next").alias("_jump")))
    on_chain = inner.where(odd).select("_id")
    while not jump.isEmpty():
        # nodes reached from the current set by one jump of the current length
        step = on_chain.join(jump, "_id").select(F.col("_jump").alias("_id"))
        on_chain = frames.checkpoint(on_chain.union(step).distinct())
        a = jump.alias("a")
        b = jump.alias("b")
        jump = frames.checkpoint(a.join(b, F.col("a._jump") == F.col("b._id")).select(
            F.col("a._id").alias("_id"), F.col("b._jump").alias("_jump")))
    kept = on_chain.union(base.where("_alone").select("_id")).select(F.shiftright("_id", 1).alias("_id"))
    return ids.join(kept, "_id", "left_semi").drop("_id")
