"""C2 in a stream: a batch per key closes when it is full or when its time is over.

State per key: the number of the open batch and when it opened (a value), its
rows (a list) and a timer at its deadline.  A row at or behind the deadline of
the open batch closes it and opens the next; a batch closes with its ``size``-th
row; a batch that no further row closes is closed by its timer once the
watermark has passed the deadline.  A last row far behind all others (see
``load_stream.stage_flush``) makes the timers fire at a shutdown.

Rows leave with the batch they belong to, so no row is held longer than its
batch is open.  Rows of a key are put in order inside a micro-batch; in-order
arrival of the micro-batches gives the sequential rule exactly.  Rows behind the
watermark are dropped by Spark as late.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotline.streaming.ttl_dedup import ROCKSDB

SIZE, TIME = "size", "time"


class _SizeOrTime(StatefulProcessor):
    def __init__(self, row: T.StructType, ts: str, tie: Sequence[str], size: int, interval_us: int):
        self.row, self.ts, self.order, self.size, self.interval_us = row, ts, [ts, *tie], size, interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("batch", T.StructType([T.StructField("no", T.LongType()), T.StructField("opened_us", T.LongType())]))
        self.rows = handle.getListState("rows", self.row)

    def _frame(self, rows: list[tuple], no: int, reason: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.row.names)
        return out.assign(BATCH_NO=no, REASON=reason)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0]:  # the row that stands for a shutdown
            return
        new = pd.concat(list(rows), ignore_index=True)[self.row.names].sort_values(self.order, kind="stable")
        times = new[self.ts].astype("datetime64[us]").astype("int64").tolist()
        new = new.astype(object).where(new.notna(), None)
        no, opened = self.at.get() if self.at.exists() else (0, None)
        held = [tuple(r) for r in self.rows.get()]
        known = len(held)
        for t, row in zip(times, new.itertuples(index=False, name=None)):
            if held and t >= opened + self.interval_us:
                yield self._frame(held, no, TIME)
                no, held, known = no + 1, [], 0
            if not held:
                opened = t
            held.append(row)
            if len(held) == self.size:
                yield self._frame(held, no, SIZE)
                no, held, known = no + 1, [], 0
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.at.update((no, opened))
        if len(held) > known:
            self.rows.put(held)
        elif not held:
            self.rows.clear()
        if held:
            self.handle.registerTimer(-(-(opened + self.interval_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        no, opened = self.at.get()
        held = [tuple(r) for r in self.rows.get()]
        if held:
            self.at.update((no + 1, opened))
            self.rows.clear()
            yield self._frame(held, no, TIME)

    def close(self) -> None:
        pass


def size_or_time_batches(stream: DataFrame, key: str, ts: str, tie: Sequence[str], size: int, seconds: int,
                         watermark: str = "0 seconds") -> DataFrame:
    """The rows of a stream with BATCH_NO (from 0 per key) and REASON, as their batches close.

    A row with all columns null but ``ts`` stands for a shutdown and is not
    returned.  Needs the RocksDB state store (set on the session if another is
    configured).
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    others = [c for c in stream.columns if c != ts]
    flush = F.coalesce(*[F.col(c).cast("string") for c in others]).isNull()
    out = T.StructType([*stream.schema.fields, T.StructField("BATCH_NO", T.LongType()), T.StructField("REASON", T.StringType())])
    timed = stream.withColumn("_flush", flush).withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)
    return timed.groupBy("_flush", key).transformWithStateInPandas(
        statefulProcessor=_SizeOrTime(stream.schema, ts, tie, size, int(seconds) * 1_000_000),
        outputStructType=out, outputMode="Append", timeMode="EventTime")
