"""Streaming load into many tables: sinks, replay, lifetime keys, ledger (C3, C6, C8, B3) and C2 in a stream."""
import datetime as dt
import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lotline.operators import dedup, load
from lotline.sources.catalog import TargetTable
from lotline.streaming import fan_out as FO
from lotline.streaming import load_stream as LS
from lotline.streaming.size_or_time import size_or_time_batches

TABLES = {t.full_name: t for t in (
    TargetTable("APP", "A", (("ID", "bigint"), ("NAME", "string"), ("D", "timestamp_ntz")), ("ID", "NAME")),
    TargetTable("APP", "B", (("CODE", "string"), ("AMOUNT", "decimal(9,2)")), ("CODE",)),
    TargetTable("X", "LOG", (("TEXT", "string"),), ()))}
ARRIVAL = {"seq": "bigint"}


def _msg(table, payload, key=None):
    return json.dumps({"Table": table, "Key": key, "Payload": payload})


BODIES = [
    [_msg("a", {"id": 1, "Name": "x|y", "extra": 1}, "k1"), _msg("a", {"ID": 1, "name": " X|Y "}, "k2"), _msg("A", {"id": 1, "name": "x", "d": "y"}),
     _msg("app.b", {"code": "c", "amount": "1.5"}), _msg("x.log", {"text": "t"}), _msg("x.log", {"text": "t"}), "{broken", None],
    [_msg("app.b", {"code": "C", "amount": 2}), _msg("app.b", {"code": "d", "amount": "no number"}), _msg("nowhere", {"z": 1}, "n"),
     _msg("a", {"id": 2}), _msg("a", {"id": 2, "name": None}), '{"Key":"k"}', "  ", '{"Table":"a","Payload":[1]}'],
    [_msg("x.log", {"text": "last"}), _msg("b", {"code": " d "}), _msg("a", {"id": 3, "name": "z", "d": "2024-01-02T03:04:05"})],
]
WANT_A = {(1, "x|y", None, "k1"), (1, "x", None, None), (2, None, None, None), (3, "z", dt.datetime(2024, 1, 2, 3, 4, 5), None)}


def _source(spark, folder, batches, first=0):
    """A file of each batch, in order."""
    rows = spark.createDataFrame([], "seq bigint, body string")
    n = first
    for k, bodies in enumerate(batches):
        part = spark.createDataFrame([(n + i, b) for i, b in enumerate(bodies)], rows.schema).coalesce(1)
        part.write.mode("append").parquet(folder)
        n += len(bodies)
        time.sleep(0.01)
    return LS.file_source(spark, folder, rows.schema, 1)


def _state(spark, root):
    a = {(r["ID"], r["NAME"], r["D"], r["MSG_KEY"]) for r in FO.read_table(spark, root, TABLES["APP.A"], ARRIVAL).collect()}
    b = {(r["CODE"], r["AMOUNT"] and float(r["AMOUNT"])) for r in FO.read_table(spark, root, TABLES["APP.B"], ARRIVAL).collect()}
    log = sorted(r["TEXT"] for r in FO.read_table(spark, root, TABLES["X.LOG"], ARRIVAL).collect())
    unknown = [r["TABLE_NAME"] for r in FO.read_rejects(spark, root, FO.UNKNOWN, ARRIVAL).collect()]
    dead = sorted(r["REASON"] for r in FO.read_rejects(spark, root, FO.DEAD, ARRIVAL).collect())
    return a, b, log, unknown, dead


WANT = (WANT_A, {("c", 1.5), ("d", None)}, ["last", "t", "t"], ["APP.NOWHERE"],
        sorted([load.R_NOT_JSON] * 3 + [load.R_NO_TABLE, load.R_PAYLOAD]))
WANT_LEDGER = {("table", "APP.A"): (6, 4, 2, 0, 0), ("table", "APP.B"): (4, 2, 0, 2, 0), ("table", "X.LOG"): (3, 3, 0, 0, 0),
               ("unknown", None): (1, 0, 0, 0, 1), ("dead letter", None): (5, 0, 0, 0, 5)}


def _ledger(spark, root):
    columns = ["N_IN", "N_WRITTEN", "N_DUPLICATE", "N_KNOWN_KEY", "N_REJECTED"]
    rows = FO.ledger(spark, root).groupBy("SINK", "TABLE_NAME").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    return {(r["SINK"], r["TABLE_NAME"]): tuple(r[c] for c in columns) for r in rows}


@pytest.mark.parametrize("fails", [None, "APP.B", "dead letter", "ledger"])
def test_sinks_ledger_and_replay(spark, tmp_dir, fails, monkeypatch):
    src, root, ck = (os.path.join(tmp_dir, x) for x in ("src", "root", "ck"))
    stream = _source(spark, src, BODIES)
    failed = []

    def outage(batch, sink):
        if fails == sink and batch.endswith("-1") and not failed:
            failed.append(batch)
            raise RuntimeError("outage")

    out = FO.FanOut(root, TABLES, list(ARRIVAL), on_written=outage)
    if fails == "ledger":  # everything stands but the commit
        whole = FO.LEDGER
        monkeypatch.setattr(FO, "LEDGER", "broken bigint")
    if fails:
        with pytest.raises(StreamingQueryException):
            out.start(stream, ck)
    if fails == "ledger":
        monkeypatch.setattr(FO, "LEDGER", whole)
        assert FO.read_table(spark, root, TABLES["APP.A"], ARRIVAL).count() == 0
    progress = FO.LoadProgress()
    spark.streams.addListener(progress)
    try:
        query = out.start(stream, ck)
        assert _state(spark, root) == WANT
        assert _ledger(spark, root) == WANT_LEDGER
        if not fails:
            for _ in range(50):  # the listener is told by another thread
                if progress.rows(query.id) == 19:
                    break
                time.sleep(0.2)
            assert progress.rows(query.id) == sum(v[0] for v in WANT_LEDGER.values()) == 19
        out.start(stream, ck)
        assert _state(spark, root) == WANT and _ledger(spark, root) == WANT_LEDGER
    finally:
        spark.streams.removeListener(progress)


def test_keys_outlive_checkpoints_and_compaction(spark, tmp_dir):
    root = os.path.join(tmp_dir, "root")
    out = FO.FanOut(root, TABLES, list(ARRIVAL))
    out.start(_source(spark, os.path.join(tmp_dir, "s1"), BODIES), os.path.join(tmp_dir, "c1"))
    name = FO.compact_keys(spark, root)
    assert [x for x in os.listdir(f"{root}/keys") if x.startswith("load")] == [f"load_batch={name}"]
    again = [[_msg("a", {"id": 3, "name": "Z"}), _msg("a", {"id": 4, "name": "w"}), _msg("b", {"code": "c"})], BODIES[0]]
    out.start(_source(spark, os.path.join(tmp_dir, "s2"), again, 100), os.path.join(tmp_dir, "c2"))
    a, b, log, _, _ = _state(spark, root)
    assert a == WANT_A | {(4, "w", None, None)} and b == WANT[1] and log == ["last", "t", "t", "t", "t"]
    ledger = _ledger(spark, root)
    assert ledger["table", "APP.A"] == (11, 5, 3, 3, 0) and ledger["table", "APP.B"] == (6, 2, 0, 4, 0)


def test_a_lost_row_is_noticed(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(load, "load_table", lambda rows, target, keep=(): load.coerce_columns(
        load.project_raw(rows.limit(1), target, keep=["TABLE_NAME", "MSG_KEY", *keep]), target, keep=["TABLE_NAME", "MSG_KEY", *keep]))
    batch = spark.createDataFrame([(i, _msg("x.log", {"text": str(i)})) for i in range(5)], "seq bigint, body string")
    root = os.path.join(tmp_dir, "root")
    with pytest.raises(FO.LedgerError):
        FO.FanOut(root, TABLES, list(ARRIVAL)).load_batch(batch, "load-0")
    assert FO.ledger(spark, root).count() == 0


def test_an_empty_batch(spark, tmp_dir):
    root = os.path.join(tmp_dir, "root")
    FO.FanOut(root, TABLES, list(ARRIVAL)).load_batch(spark.createDataFrame([], "seq bigint, body string"), "load-0")
    assert _state(spark, root) == (set(), set(), [], [], []) and _ledger(spark, root) == {}


def test_bodies_that_are_not_one_object(spark):
    bad = ['{"Table":"a"},{"Table":"b"}', '{"Table":"a"}}', '{"Table":"a"} junk', "{'Table':'a'}", '{"Table":"a"}] x [', "[1,2]", '"a"', "{"]
    rows = spark.createDataFrame([(b,) for b in [*bad, '{"Table":" "}', ' {"Table":"a","Payload":{"x":["}{",{"y":"]"}]}}\n']], "body string")
    got = [r["_reason"] for r in load.decode_envelopes(rows).collect()]
    assert got == [load.R_NOT_JSON] * len(bad) + [load.R_NO_TABLE, None]


def test_message_keys_over_rows_with_payload(spark):
    rows = spark.createDataFrame([(i, _msg("a", {"id": i}, k)) for i, k in enumerate(["p", "p", "", "", None, None, "q"])], "seq bigint, body string")
    kept = dedup.dedup_message_key(load.good(load.decode_envelopes(rows)), "MSG_KEY", ["seq"])
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert kept.select(F.try_variant_get(F.col("PAYLOAD")["id"], "$", "int").alias("i"), "seq").where("i <> seq").count() == 0


def _sequential(rows, size, seconds):
    """The rule, row by row: ``(key, ts, id)`` to (batch number, reason)."""
    out = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        no, held = 0, []
        for t, i in mine:
            if held and t >= held[0][0] + seconds:
                out |= {x: (no, "time") for _, x in held}
                no, held = no + 1, []
            held.append((t, i))
            if len(held) == size:
                out |= {x: (no, "size") for _, x in held}
                no, held = no + 1, []
        out |= {x: (no, "time") for _, x in held}
    return out


@pytest.mark.parametrize("size, seconds", [(3, 10), (1, 5), (100, 7)])
def test_size_or_time_is_the_sequential_rule(spark, tmp_dir, size, seconds):
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 1, 2, 2, 9, 10, 12, 30, 31, 33, 40, 41, 41, 41, 41, 47, 55, 80]
    rows = [("ab"[i % 5 == 0], t, i) for i, t in enumerate(times)] + [("lone", 3, 100)]
    frame = spark.createDataFrame([(k, t0 + dt.timedelta(seconds=t), i, None if i % 3 else "n") for k, t, i in rows],
                                  "k string, ts timestamp_ntz, id bigint, note string")
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    LS.stage_files(frame, src, 5, "ts")
    LS.stage_flush(frame, src, "ts", 1000)
    closed = size_or_time_batches(LS.file_source(spark, src, frame.schema, 1), "k", "ts", ["id"], size, seconds)
    LS.run_load(closed, out, ck)
    found = spark.read.parquet(out).collect()
    assert {r["id"]: (r["BATCH_NO"], r["REASON"]) for r in found} == _sequential(rows, size, seconds)
    assert len(found) == len(rows) and {r["note"] for r in found} == {None, "n"}


def test_staged_files_are_taken_in_order(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("id"))
    LS.stage_files(rows, src, 6, "id")
    LS.run_load(LS.file_source(spark, src, rows.schema, 1), out, ck)
    spans = sorted((int(r["b"].rsplit("-", 1)[1]), r["lo"], r["hi"]) for r in spark.read.parquet(out).groupBy("batch_id").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi")).withColumnRenamed("batch_id", "b").collect())
    assert len(spans) > 3 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_a_batch_of_one_file_is_decoded_by_all_cores(spark, tmp_dir):
    root = os.path.join(tmp_dir, "root")
    rows = spark.createDataFrame([(i, _msg("x.log", {"text": f"t{i}"})) for i in range(400)], "seq bigint, body string").coalesce(1)
    FO.FanOut(root, TABLES, list(ARRIVAL)).load_batch(rows, "one")
    files = [f for f in os.listdir(f"{root}/tables/X.LOG/load_batch=one") if f.startswith("part-")]
    assert len(files) == min(spark.sparkContext.defaultParallelism, 400)
    assert FO.read_table(spark, root, TABLES["X.LOG"], ARRIVAL).count() == 400


@pytest.mark.parametrize("hashes", [0, 1000])
def test_many_keys_shuffle_only_stored_keys_of_their_own_hash(spark, tmp_dir, monkeypatch, hashes):
    monkeypatch.setattr(FO, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(FO, "BROADCAST_HASHES", hashes)
    out = FO.FanOut(os.path.join(tmp_dir, "root"), TABLES, list(ARRIVAL))

    def batch(ids):
        return spark.createDataFrame([(i, _msg("b", {"code": f"c{i}"})) for i in ids], "seq bigint, body string")

    out.load_batch(batch(range(40)), "one")
    out.load_batch(batch(range(30, 60)), "two")
    assert _ledger(spark, out.root) == {("table", "APP.B"): (70, 60, 0, 10, 0)}
    fresh = FO._read(spark, f"{out.root}/keys", FO.KEYS).where("load_batch = 'two'")
    known = out._known_keys(spark, fresh, "three")
    assert known.count() == 20
    assert ("_short" in known._jdf.queryExecution().executedPlan().toString()) == (hashes > 0)


def test_a_field_is_looked_up_and_typed_once(spark, tmp_dir, monkeypatch):
    """Before, a key was picked and typed from the payload for its digest, and the row again behind the shuffle."""
    typed = []
    once = FO.load.load_table
    monkeypatch.setattr(FO.load, "load_table", lambda rows, target, keep: typed.append(target.full_name) or once(rows, target, keep))
    monkeypatch.setattr(FO.load, "pick", None)
    rows = spark.createDataFrame([(i, _msg("b", {"code": f"c{i // 2}"})) for i in range(10)], "seq bigint, body string")
    root = os.path.join(tmp_dir, "root")
    FO.FanOut(root, TABLES, list(ARRIVAL)).load_batch(rows, "one")
    assert _ledger(spark, root) == {("table", "APP.B"): (10, 5, 5, 0, 0)}
    assert len(typed) == len(set(typed)) and "APP.B" in typed
    assert sorted(r.seq for r in FO.read_table(spark, root, TABLES["APP.B"], ARRIVAL).collect()) == [0, 2, 4, 6, 8]


def test_projected_fields_are_the_picked_ones(spark):
    bodies = [json.dumps({"Table": "b", "Payload": p}) for p in ({}, {"CODE": 1}, {"x": 2, "Code": "3", "code": None}, {"code": 4, "Code": [5]}, {"z": 6})]
    rows = FO.load.decode_envelopes(spark.createDataFrame([(b,) for b in bodies], "body string"))
    target = TABLES["APP.B"]
    want = rows.select("body", *[FO.load.pick(F.col("PAYLOAD"), c).alias(c) for c, _ in target.columns])
    text = lambda df: sorted(map(tuple, df.select("body", *[F.to_json(F.col(c)).alias(c) for c, _ in target.columns]).collect()), key=str)
    got = FO.load.project_raw(rows, target, keep=["body"])
    assert text(got) == text(want)
