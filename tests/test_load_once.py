"""The load report decodes a message once for all tables, and slices follow the rows."""
import datetime as dt
import json

from pyspark.sql import functions as F

from lotline import frames
from lotline.operators import dedup, load
from lotline.plans import load_path
from lotline.sources.views import ARRIVAL_MSG

T0 = dt.datetime(2024, 1, 1)


def _messages(spark):
    def body(table, payload):
        return json.dumps({"Table": table, "Payload": payload})

    bodies = [body("order_lines", {"order_id": k // 2, "line_no": 1}) for k in range(8)]
    bodies += [body("orders", {"ORDER_ID": k % 3}) for k in range(6)] + [body("type_demo", {"n9": 1})] * 5
    bodies += [body("nowhere", {}), "{broken", body("orders", {}), body("orders", {"ORDER_ID": "no number"})]
    rows = [(T0, 0, 7 if "type_demo" in b else k, 0, 0, 0, b) for k, b in enumerate(bodies)]  # arrivals of type_demo are equal
    return spark.createDataFrame(rows, "arr_ts timestamp_ntz, arr_src int, arr_k1 long, arr_k2 long, arr_k3 long, arr_k4 long, body string")


def test_report_decodes_once(spark, monkeypatch):
    decoded = []
    once = load.decode_envelopes
    monkeypatch.setattr(load, "decode_envelopes", lambda *a, **k: decoded.append(1) or once(*a, **k))
    written = []
    whole = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: written.append(1) or whole(df))
    got = load_path.load_report(_messages(spark), batch_size=2)
    assert len(decoded) == len(written) == 1
    assert sorted((r.TABLE_NAME, r.BATCH_ID, r.N_ROWS, r.FIRST_ROW, r.LAST_ROW) for r in got.collect()) == [
        ("APP.ORDERS", 0, 2, 1, 2), ("APP.ORDERS", 1, 2, 3, 4), ("APP.ORDER_LINES", 0, 2, 1, 2), ("APP.ORDER_LINES", 1, 2, 3, 4),
        ("APP.TYPE_DEMO", 0, 2, 1, 2), ("APP.TYPE_DEMO", 1, 2, 3, 4), ("APP.TYPE_DEMO", 2, 1, 5, 5)]


def test_typed_rows_of_several_tables(spark):
    tables = load_path.target_tables()
    rows = load.load_tables(load.good(load.decode_envelopes(_messages(spark))), list(tables.values()), ["arr_k1"])
    for name, t in tables.items():
        want = load.load_table(load.good(load.decode_envelopes(_messages(spark))), t, ["arr_k1"])
        got = rows.where(F.col("TABLE_NAME") == name).select("TABLE_NAME", "MSG_KEY", "arr_k1", F.col(f"`{name}`.*"))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_slices_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_PER_TASK", 10)
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    assert frames.slices_for(rows) == 30 and frames.slices_for(rows.limit(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = load.batch_ids(rows, ["id"], 5, group=(), partitions=30)
    kept = dedup.dedup_batch(chunked, ["k"], ["id"], partitions=30)
    assert kept.rdd.getNumPartitions() == 30
    assert sorted(r["id"] for r in kept.collect()) == [b + i for b in range(0, 300, 5) for i in range(3)]
