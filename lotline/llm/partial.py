"""Sums of numpy arrays over the partitions of a frame."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def summed(df: DataFrame, per_partition: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]],
           max_partitions: int = 64) -> dict[int, np.ndarray]:
    """Add up, key by key, the float64 arrays that each partition returns.

    A partition sends one row per key, Spark adds the rows of each key in a
    task of its own, and the driver gets the sums.  Their number and size must
    be fixed by the model, not by the data; ``df`` (a model's training rows) is
    read by at most ``max_partitions`` tasks, which bounds what one key adds up.
    """
    def emit(batches):
        parts = per_partition(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts.keys(), pa.int32()),
             pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in parts.values()], pa.binary())],
            names=["key", "value"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("value"))
        return pa.table({"key": table.column("key")[:1], "value": pa.array([total.tobytes()], pa.binary())})

    schema = "key int, value binary"
    rows = df.coalesce(max_partitions).mapInArrow(emit, schema).groupBy("key").applyInArrow(add, schema).collect()
    return {r["key"]: np.frombuffer(r["value"], np.float64) for r in rows}
