"""Sinks (C4): bulk append with a batch size and bounded writers."""
from __future__ import annotations

from pyspark.sql import DataFrame


def append_parquet(df: DataFrame, path: str, batch_size: int = 1_000_000, writers: int | None = None) -> None:
    """Append ``df`` as parquet; ``batch_size`` is the most rows of one file, ``writers`` caps parallel writers.

    ``coalesce(writers)`` bounds concurrent writers without a shuffle, like the
    loaders' writer semaphores; the write is one job, committed atomically by
    the file committer.
    """
    out = df.coalesce(writers) if writers else df
    out.write.mode("append").option("maxRecordsPerFile", batch_size).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 5000, writers: int = 4,
                properties: dict | None = None) -> None:
    """JDBC append, one transaction per partition, ``batchsize`` rows per round trip.

    Needs the database's JDBC driver on the classpath (not available in the
    test environment, so this path is not exercised by the tests).
    """
    (df.coalesce(writers).write.format("jdbc").mode("append")
       .option("url", url).option("dbtable", table).option("batchsize", batch_size)
       .options(**(properties or {})).save())
