"""B4 in a stream: exact TTL dedup per key with ``transformWithState``.

A row is accepted when no accepted row of its key is at most ``ttl`` older;
refusals do not extend the window.  The state per key is one value: the last
accepted time.  Rows of a key are sorted inside each micro-batch, so the rule
is exact for in-order arrival; a row that arrives after a later row of the
same key was accepted is judged against that later row (documented).

Python is called once per bucket of keys and micro-batch, not once per key:
calls, their reads and writes of state and the small Arrow batch that each of
them returns cost far more than the rows of a key.  The state of a bucket is one
value with the last accepted time of each of its keys, read once and written
once where a row was accepted: known keys are copied, at less than a
microsecond each, which their new rows outweigh.  ``BUCKETS`` and this layout
belong to a checkpoint: one that began with others cannot go on.

``dropDuplicatesWithinWatermark`` is not this operator: its state expires
when the watermark passes first-seen + ttl, which keeps only the first row on
(1, 5, 12, 14, 30 s, ttl 10 s) where the rule keeps 1, 12 and 30.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt over so many buckets by hash; a call of Python sees the new rows of one.
BUCKETS = 4096


class _TtlProcessor(StatefulProcessor):
    def __init__(self, key: Sequence[str], ts_col: str, tie_col: str, ttl_us: int):
        self.key, self.ts_col, self.tie_col, self.ttl_us = list(key), ts_col, tie_col, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_accepted_us", StructType([StructField("by_key", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(tuple(r), r) for r in rows]     # fields of a plain tuple are found faster
        place = new[0][1].__fields__.index
        at, ts, tie = [place(c) for c in self.key], place(self.ts_col), place(self.tie_col)
        new.sort(key=lambda x: (x[0][ts] is None, x[0][ts], x[0][tie] is None, x[0][tie]))  # rows without a time come last
        times = [None if v[ts] is None else v[ts].replace(tzinfo=None) for v, _ in new]
        us = np.array(times, dtype="datetime64[us]").astype("int64")
        held = self.last.get()
        last = pickle.loads(held[0]) if held else {}
        kept = []
        with np.errstate(over="ignore"):
            for (values, row), t in zip(new, us):   # sequential by definition, the new rows of a bucket's keys
                k = tuple(["NaN" if values[i] != values[i] else values[i] for i in at])
                before = last.get(k)
                if before is None or t - before > self.ttl_us:
                    last[k] = int(t)
                    kept.append(row)
        if kept:
            self.last.update((pickle.dumps(last, protocol=4),))
        yield from kept

    def close(self) -> None:
        pass


def ttl_dedup_stream(stream: DataFrame, key: Sequence[str], ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """Streaming TTL dedup; needs the RocksDB state store (set on the session if another is configured)."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = stream.withColumn("_bucket", F.pmod(F.hash(*key), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithState(
        statefulProcessor=_TtlProcessor(key, ts, tie, int(ttl_seconds) * 1_000_000),
        outputStructType=stream.schema, outputMode="Append", timeMode="None")
