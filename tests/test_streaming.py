"""Streaming: restart after a partial drain writes every row exactly once."""
import os

from pyspark.sql import functions as F

from lotline.streaming import load_stream as LS
from lotline.streaming.ttl_dedup import ttl_dedup_stream


def test_restart_is_exactly_once(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    first = spark.range(0, 100).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("k"))
    second = spark.range(100, 250).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("k"))
    first.write.parquet(src)
    stream = LS.file_source(spark, src, first.schema, 1)
    LS.run_load(stream, out, ck)
    assert spark.read.parquet(out).count() == 100
    second.write.mode("append").parquet(src)
    LS.run_load(stream, out, ck)             # restart from the checkpoint
    LS.run_load(stream, out, ck)             # and once more: nothing new
    r = spark.read.parquet(out)
    assert r.count() == 250 and r.select("event_id").distinct().count() == 250


def test_a_new_checkpoint_adds_to_an_old_folder(spark, tmp_dir):
    src, out = (os.path.join(tmp_dir, x) for x in ("src", "out"))
    rows = spark.range(0, 10).select(F.col("id").alias("event_id"))
    rows.write.parquet(src)
    for ck in ("ck1", "ck2"):
        LS.run_load(LS.file_source(spark, src, rows.schema, 1), out, os.path.join(tmp_dir, ck))
    assert spark.read.parquet(out).count() == 20


def test_replayed_batch_is_idempotent(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    fn = LS.commit_batches(out)
    b = spark.range(10).select(F.col("id").alias("x"))
    fn(b, 0)
    fn(b, 0)                                  # replay of batch 0 after a crash before the commit
    fn(b, 1)
    assert spark.read.parquet(out).count() == 20


def test_ttl_stream_fixture(spark, tmp_dir):
    import datetime as dt
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    t0 = dt.datetime(2024, 1, 1)
    schema = "id long, k string, ts timestamp_ntz"
    for i, s in enumerate([1, 5, 12, 14, 30]):    # one event per micro-batch
        spark.createDataFrame([(i, "k", t0 + dt.timedelta(seconds=s))], schema).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = LS.file_source(spark, src, spark.createDataFrame([], schema).schema, 1)
    kept = ttl_dedup_stream(stream, ["k"], "ts", "id", 10)
    LS.run_load(kept, out, ck)
    assert sorted((r.ts - t0).seconds for r in spark.read.parquet(out).collect()) == [1, 12, 30]


def test_ttl_stream_calls_by_bucket_not_by_key(spark, tmp_dir, monkeypatch):
    """State and calls are one per bucket of keys; null and large keys stay apart, over several micro-batches."""
    import datetime as dt
    import random

    from lotline.streaming import ttl_dedup
    monkeypatch.setattr(ttl_dedup, "BUCKETS", 16, raising=False)
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    rnd, t0 = random.Random(11), dt.datetime(2024, 1, 1)
    keys = [(i, k) for i in (None, 2**53, 2**53 + 1, *range(200)) for k in ("a", None)]
    rows = [(i, *rnd.choice(keys), t0 + dt.timedelta(milliseconds=i * 10)) for i in range(6000)]
    schema = "id long, k1 long, k2 string, ts timestamp_ntz"
    for part in (rows[:2000], rows[2000:4000], rows[4000:]):
        spark.createDataFrame(rnd.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(src)
    stream = LS.file_source(spark, src, spark.createDataFrame([], schema).schema, 1)
    q = LS.run_load(ttl_dedup_stream(stream, ["k1", "k2"], "ts", "id", 10), out, ck)
    last, want = {}, []
    for i, k1, k2, t in rows:
        if (k1, k2) not in last or (t - last[k1, k2]).total_seconds() > 10:
            want.append((i, k1, k2, t))
            last[k1, k2] = t
    got = spark.read.parquet(out).drop("batch_id").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want and len(want) < len(rows)
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [2000] * 3
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 16
