"""Literal tables with known answers (FIXTURES part 3) and reference scenarios."""
import datetime as dt
import decimal

from pyspark.sql import functions as F

from lotline.functions import coerce as C
from lotline.functions.keys import canonical_key, norm_name, norm_owner, norm_table
from lotline.operators import allocate as A
from lotline.operators import dedup, load, stats
from lotline.sources import catalog as CAT


def test_allocation_two_nodes(spark):
    nodes = spark.createDataFrame([("aaa", 4, 1), ("bbb", 2, 2)], "NODE_ID string, CAP int, SEQ int")
    edges = spark.createDataFrame([("aaa", "bbb", 1)], "SRC string, DST string, EDGE_SEQ int")
    n, adj = A.build_graph(nodes, edges)
    free = n.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))
    reqs = spark.createDataFrame([(i, "aaa") for i in range(1, 8)], "REQ_NO long, START_ID string")
    got = {r.REQ_NO: r.NODE_ID for r in A.allocate_bfs(reqs, free, adj).collect()}
    assert [got[i] for i in range(1, 8)] == ["aaa"] * 4 + ["bbb"] * 2 + [None]
    hop = {r.REQ_NO: r.NODE_ID for r in A.allocate_one_hop(reqs, free, adj).collect()}
    assert [hop[i] for i in range(1, 8)] == ["aaa"] * 4 + ["bbb"] * 2 + [None]


def test_unknown_start_and_isolated_zero_node(spark):
    nodes = spark.createDataFrame([("a", 1, 1), ("z", 0, 2)], "NODE_ID string, CAP int, SEQ int")
    edges = spark.createDataFrame([("a", "b", 1)], "SRC string, DST string, EDGE_SEQ int")
    n, adj = A.build_graph(nodes, edges)
    assert {r.NODE_ID: r.CAP for r in n.collect()} == {"a": 1, "z": 0, "b": 0}   # endpoint b created with 0
    free = n.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))
    reqs = spark.createDataFrame([(1, "q"), (2, "z"), (3, "b"), (4, "b")], "REQ_NO long, START_ID string")
    got = {r.REQ_NO: r.NODE_ID for r in A.allocate_bfs(reqs, free, adj).collect()}
    assert got == {1: None, 2: None, 3: "a", 4: None}
    hop = {r.REQ_NO: (r.NODE_ID, r.REASON) for r in A.allocate_one_hop(reqs, free, adj).collect()}
    assert hop[1] == (None, "unknown start")


def test_clamp_free_capacity(spark):
    nodes = spark.createDataFrame([("n1", 4), ("n2", 4), ("n3", 4)], "NODE_ID string, CAP int")
    used = spark.createDataFrame([("n1", 6), ("n2", -1), ("n3", 1), ("zz", 2)], "NODE_ID string, USED int")
    got = {r.NODE_ID: r.FREE for r in A.free_capacity(nodes, used).collect()}
    assert got == {"n1": 0, "n2": 4, "n3": 3}


def test_first_arrival_wins(spark):
    o = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "ORDER_ID int, CUST_ID int, seq int")
    r = dedup.dedup_lifetime(o, ["ORDER_ID"], ["seq"]).collect()
    assert [(x.ORDER_ID, x.CUST_ID) for x in r] == [(1, 10)]
    li = spark.createDataFrame([(1, 1, "A", 1), (1, 1, "B", 2)], "ORDER_ID int, LINE_NO int, SKU string, seq int")
    r = dedup.dedup_lifetime(li, ["ORDER_ID", "LINE_NO"], ["seq"]).collect()
    assert [x.SKU for x in r] == ["A"]


def test_canonical_key(spark):
    df = spark.createDataFrame([(" ab ", None, 7), ("\tab ", None, 7)], "a string, b string, c int")
    keys = [r.k for r in df.select(canonical_key([(F.col("a"), True), (F.col("b"), True),
                                                  (F.col("c"), False)]).alias("k")).collect()]
    assert keys == ["AB|<NULL>|7", "AB|<NULL>|7"]


def test_key_with_separator_does_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2)], "x string, y string, seq int")
    kept = dedup.dedup_lifetime(df, ["x", "y"], ["seq"])
    assert kept.count() == 2          # same joined text, different parts


def test_ttl_dedup_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([1, 5, 12, 14, 30])]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    kept = dedup.dedup_ttl(df, ["key"], "ts", ["id"], 10)
    assert sorted((r.ts - t0).seconds for r in kept.collect()) == [1, 12, 30]


def test_type_map():
    t = CAT.target_tables()["APP.TYPE_DEMO"]
    types = dict(t.columns)
    assert types == {"N9": "int", "N10": "bigint", "N18": "bigint", "N19": "decimal(19,0)",
                     "NN": "decimal(38,10)", "N52": "decimal(5,2)", "NNEG": "int", "TS6": "timestamp_ntz",
                     "TS3": "string", "F": "double", "B": "binary", "C": "string"}


def test_type_map_frame_matches_driver_side(spark):
    sch = CAT.schema_frame(CAT.columns_meta(spark)).where(F.col("table_name") == "TYPE_DEMO")
    got = {r.column_name: r.spark_type for r in sch.collect()}
    assert got == dict(CAT.target_tables()["APP.TYPE_DEMO"].columns)


def test_primary_key_order(spark):
    pk = CAT.pk_frame(CAT.constraints_meta(spark), CAT.cons_columns_meta(spark))
    got = {r.table_name: list(r.pk_columns) for r in pk.collect()}
    assert got == {"ORDERS": ["ORDER_ID"], "ORDER_LINES": ["ORDER_ID", "LINE_NO"]}


def test_table_names(spark):
    df = spark.createDataFrame([("orders",), ("x.y.z",), (" hr.emp ",)], "t string")
    got = [(r.o, r.n, r.f) for r in df.select(norm_owner(F.col("t")).alias("o"), norm_name(F.col("t")).alias("n"),
                                              norm_table(F.col("t")).alias("f")).collect()]
    assert got == [("APP", "ORDERS", "APP.ORDERS"), ("X", "Y.Z", "X.Y.Z"), ("HR", "EMP", "HR.EMP")]


def test_strict_coercion(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("2024-01-02",), ("02/01/2024",)], "s string")
    got = [r.d for r in df.select(C.strict_date(F.col("s")).alias("d")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), None]
    nums = spark.createDataFrame([("abc",), (" 1.50 ",)], "s string")
    n, raw = C.keep_raw_number(F.col("s"))
    got = [(r.n, r.raw) for r in nums.select(n.alias("n"), raw.alias("raw")).collect()]
    assert got == [(None, "abc"), (decimal.Decimal("1.5000000000"), None)]


def test_strict_timestamp(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("2024-01-02 03:04:05.123456",), ("junk",)], "s string")
    got = [r.t for r in df.select(C.strict_timestamp(F.col("s")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5, 678000), dt.datetime(2024, 1, 2, 3, 4, 5, 123456), None]


def test_lenient_coercion(spark):
    df = spark.createDataFrame([('{"v":"x"}',), ('{"v":2.5}',), ('{"v":3.5}',), ('{"v":" 7 "}',), ('{"v":"2.5"}',)],
                               "p string")
    v = F.try_variant_get(F.parse_json("p"), "$.v", "variant")
    got = [r.i for r in df.select(C.coerce_lenient(v, "int").alias("i")).collect()]
    assert got == [None, 2, 4, 7, None]


def test_guid_bytes(spark):
    df = spark.createDataFrame([("00112233-4455-6677-8899-aabbccddeeff",), ("not-a-guid",)], "g string")
    got = [r.h for r in df.select(F.lower(F.hex(C.guid_to_bytes(F.col("g")))).alias("h")).collect()]
    assert got == ["33221100554477668899aabbccddeeff", None]


def test_cycle_time_formula(spark):
    df = spark.createDataFrame([(0.0, 12.0), (4.0, 12.0)], "q double, s double")
    got = [r.t for r in df.select(stats.weighted_tat(F.col("s"), F.col("q")).alias("t")).collect()]
    assert got == [12.0, 3.0]


def test_state_hours_split_at_midnight(spark):
    iv = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 2, 3), "BUSY")],
                               "EQP_ID int, TS timestamp_ntz, END_TS timestamp_ntz, STATE string")
    got = {r.DAY.day: r.BUSY for r in stats.load_stat(iv).collect()}
    assert got == {1: 2.0, 2: 3.0}


def test_pegging(spark):
    sup = spark.createDataFrame([("p", 5.0, 1), ("p", 5.0, 2)], "P string, Q double, o int")
    dem = spark.createDataFrame([("p", 3.0, 1), ("p", 6.0, 2)], "P string, Q double, o int")
    peg = sorted((r.DEMAND_SEQ, r.SUPPLY_SEQ, r.PEG_QTY) for r in
                 stats.fifo_peg(sup, dem, "P", "Q", ["o"], ["o"], bucket=2.0).collect())
    # (supply, demand, qty) in the fixture's order: (1,1,3), (1,2,2), (2,2,4)
    assert peg == [(1, 1, 3.0), (2, 1, 2.0), (2, 2, 4.0)]
    assert 10.0 - sum(p[2] for p in peg) == 1.0


def test_envelope_decode_rules(spark):
    bodies = ['{"Table":"a.b","Key":"1","Payload":{"X":1}}', '{"Key":"1","Payload":{}}',
              '{"Table":"t","Payload":"oops"}', '{"Table":"t"}', '{"Table":"t","Payload":null}', "{bad", "[1]", ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = {r.i: (r.TABLE_NAME, r._reason, None if r.PAYLOAD is None else len(r.PAYLOAD))
           for r in load.decode_envelopes(df).collect()}
    assert got[0] == ("A.B", None, 1)
    assert got[1][1] == "missing table"
    assert got[2][1] == "payload not an object"
    assert got[3] == ("APP.T", None, 0) and got[4] == ("APP.T", None, 0)
    assert got[5][1] == got[6][1] == got[7][1] == "not a json object"


def test_projection_case_insensitive_exact_first(spark):
    df = spark.createDataFrame([('{"qty":1,"QTY":2}',), ('{"Qty":3}',), ('{}',)], "p string")
    m = F.from_json("p", "map<string,variant>")
    got = [r.v for r in df.select(F.try_variant_get(load.pick(m, "QTY"), "$", "int").alias("v")).collect()]
    assert got == [2, 3, None]


def test_batches_of_5000(spark):
    """20 000 rows per table -> four batches of 5000 each (loader scenario)."""
    df = spark.range(20000).select(F.lit("APP.ORDERS").alias("TABLE_NAME"), F.col("id").alias("seq"))
    rep = load.batch_report(load.batch_ids(df, ["seq"], 5000)).collect()
    assert sorted((r.BATCH_ID, r.N_ROWS) for r in rep) == [(0, 5000), (1, 5000), (2, 5000), (3, 5000)]
