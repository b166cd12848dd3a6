"""Token ids in patched frame-of-reference blocks: exact round trips, and the library's ids."""
import random
import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotline.llm import queries, tokenids

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")


def _library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(300, 400), max_size=3000), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, share):
    ids = np.array(values, np.uint32)
    made = tokenids.encode_blocks(ids, share)
    starts = np.cumsum([0, *map(len, made)])[:-1].tolist()
    assert tokenids.decode_blocks(b"".join(made), starts).tolist() == values


def test_width_is_a_percentile_and_the_rest_are_exceptions():
    ids = np.full(1024, 1000, np.uint32)
    ids[::100] = 40_000
    least, count, exceptions, width = tokenids._HEAD.unpack_from(tokenids.encode_blocks(ids, 0.9)[0])
    assert (least, count, exceptions, width) == (1000, 1024, 11, 0)
    assert tokenids._HEAD.unpack_from(tokenids.encode_blocks(ids, 1.0)[0])[2:] == (0, 16)


ROWS = [(3, "Hello, World. Hello"), (1, None), (2, ""), (None, "no id"), (None, None), (3, "Hello, World. Hello"), (3, "other"),
        (-5, "<|startoftext|> mid<|endoftext|>dle <|STARTOFTEXT|>"), (7, "J̌ ǰ É É K Σ ΣΑΣ ß İ"), (8, "it's A.B. 12.5, e.g., x., y.. (z.)"),
        (9, "a\x0bb\x0cc\x1cd\x85e\xa0f　g h​i\tj\r\nk"), (10, "字" * 3000), (11, "x" * 20_000), (12, " ́start ́"),
        (13, "🙂🙂 ١٢٣ ²³ ½ 'S 'll don'T"), (14, " ".join(f"word{k % 700}." for k in range(30_000))), (15, "\x00 �")]


def test_documents_have_the_library_ids(spark):
    rnd = random.Random(3)
    chars = "aAzZ09.,'’<|>-_ \t\nÉéß字Σ́̌"
    rows = ROWS + [(100 + k, "".join(rnd.choice(chars) for _ in range(200))) for k in range(200)]
    docs = spark.createDataFrame([(d, t, "x", 5, 6) for d, t in rows], "doc_id long, text string, id string, start int, slice int")
    library = _library()
    folder = tempfile.mkdtemp(prefix="lotline-ids-")
    for docs_per_file in (20_000, 10):
        manifest = tokenids.write_ids(docs, VOCABULARY, f"file:{folder}/{docs_per_file}", docs_per_file=docs_per_file)
        found = sorted(tokenids.read_ids(manifest).collect(), key=lambda r: r["start"])
        got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found]
        want = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ((d, library(t)) for d, t in rows)]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        assert sorted(got, key=key) == sorted(want, key=key)
        assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
        assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()
        row = next(r for r in found if r["doc_id"] == 14)
        reader = tokenids.IdReader(row["file"])
        ids = library(dict(ROWS)[14])
        assert reader.ids(row["first"] + 1500, row["first"] + 4100).tolist() == ids[1500:4100]
        assert reader.ids(5, 5).tolist() == []
        reader.close()


def test_empty_table_and_repeated_ids_over_many_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenids.round_trip(docs, VOCABULARY).collect() == []
    hot = spark.range(400, numPartitions=4).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"))
    folder = tempfile.mkdtemp(prefix="lotline-ids-")
    manifest = tokenids.write_ids(hot, VOCABULARY, folder, docs_per_file=20)
    assert manifest.count() > 8 and manifest.agg(F.max("n_docs")).first()[0] < 100
    assert sorted(r["start"] for r in tokenids.read_ids(manifest).collect()) == list(range(0, 1600, 4))


def test_a_worker_forgets_its_strings(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokenids, "KNOWN_IDS", 50)
    encoder, library = tokenids.StringEncoder(VOCABULARY), _library()
    for k in range(20):
        texts = [f"alpha{k} beta{k * 7} Gamma, delta.", None and "", "x" * k]
        lengths, ids = encoder.encode(pa.array([t or "" for t in texts], pa.large_string()), 1)
        assert ids.tolist() == [i for t in texts for i in library(t)] and lengths.tolist() == [len(library(t)) for t in texts]
    assert encoder.used < 400


def test_query_matches_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in queries.op11_token_ids_pfor(spark, sf_dir).collect()}
    library, start = _library(), 0
    for row in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = library(row["text"])
        got = found[row["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
