"""The corpus pipeline: each stage against a plain reading of its rule."""
import random

import pytest

import corpus_pipeline
from lotline.llm import bpe
from test_operators import _contaminated, _secrets, _shingles

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus: good and bad texts, copies, a benchmark passage, a secret, null and repeated rows."""
    root = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(11)
    sentence = lambda: "The " + " ".join("".join(rnd.sample("aeioutnrsl", 5)) for _ in range(9)) + "."
    good = [" ".join(sentence() for _ in range(12)) for _ in range(60)]
    bad = [f"{''.join(rnd.sample('abcdefgh', 4))} " * 60 + "!!! $$$" for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    rows += [(200, good[0]), (201, good[1].replace("The", "the", 1)), (202, good[2] + " " + " ".join(["it"] * 3)),
             (203, good[3]), (203, good[3]), (None, good[4] + " More of it here. " + good[5])]
    item = sentence() + " " + sentence()
    rows += [(300, good[6] + " " + item), (301, f'{good[7]} token = "0123456789abcdef0123456789abcdef" {sentence()} {sentence()} {sentence()} {sentence()} {good[8]}')]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir))
        if len(frames) <= len(corpus_pipeline.STAGES):
            assert frames[-1].columns == docs.columns
    start, chosen, single, clean, safe, ids = ([r.asDict() for r in f.collect()] for f in frames)
    assert {r["doc_id"] for r in chosen} == {r["doc_id"] for r in start} - set(range(60, 100))
    # one document of each group of near duplicates, one row of each repeated id
    kept = [(r["doc_id"], _shingles(r["text"])) for r in single]
    for k, (a, x) in enumerate(kept):
        for b, y in kept[:k]:
            assert a is None or b is None or 100 * len(x & y) < 75 * len(x | y), (a, b)
    assert {r["doc_id"] for r in single} >= {None, 0, 1, 2, 3} and len([1 for d, _ in kept if d == 203]) == 0
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not _contaminated(r["text"], [(1, item)])[1]}
    assert 300 not in {r["doc_id"] for r in clean}
    before = {r["doc_id"]: r["text"] for r in clean}
    for r in safe:
        spans = _secrets(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) == (not spans) and r["n_chars"] == len(r["text"])
        assert not _secrets(r["text"])
    assert any("[SECRET]" in r["text"] for r in safe)
    import public_tokenizers
    encoder = bpe.WordBpe.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in safe}
    assert {r["doc_id"]: r["input_ids"] for r in ids} == {d: encoder.encode(t) for d, t in texts.items()}
    assert all(r["n_tokens"] == len(r["input_ids"]) and r["decoded"] == encoder.decode(r["input_ids"]) for r in ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "input_ids", "n_tokens", "decoded"] and got.count() > 50


def test_near_duplicate_stage_judges_rows(spark):
    """Repeated ids with other texts, and rows without ids, are rows of their own."""
    rnd = random.Random(12)
    text = lambda: " ".join("".join(rnd.sample("aeioutnrsl", 6)) for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(1, a), (7, b), (7, c), (7, a + " more"), (8, d), (8, d), (8, e), (None, f), (None, f + " more"), (None, f),
            (None, b), (None, g), (9, ""), (9, None), (10, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    of_f = [x for x in kept if x[1] and x[1].startswith(f)]
    assert len(of_f) == 1 and of_f[0][0] is None
    key = lambda x: (x[0] or 0, x[1] is None, x[1] or "")
    want = [(1, a), (7, b), (7, c), (8, d), (8, e), (None, g), (9, ""), (9, None), (10, "")]
    assert sorted((x for x in kept if x not in of_f), key=key) == sorted(want, key=key)
    assert {r.source for r in got.collect() if r.text == d} == {"s4"}


CLASHES = ["__key", "__stage_key", "__spans", "__key_", "id", "row", "spans", "score", "n", "component", "n_hit", "decoded", "a.b"]


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3, None], ids=["empty table", "null texts", "odd rows"])
def test_stages_take_odd_tables(spark, sf_dir, rows):
    """Null, empty, repeated and very long texts, null ids, no ``n_chars``, columns named like the stages' own."""
    rnd = random.Random(13)
    if rows is None:
        long = " ".join("".join(rnd.sample("aeioutnrsl", 5)) for _ in range(30_000))
        first = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 0").first().text
        rows = [(1, None), (1, ""), (2, ""), (2, ""), (None, " \t"), (None, first), (0, first), (0, first), (5, long), (6, long + " x"),
                (7, first + ' token = "0123456789abcdef0123456789abcdef"'), (None, None), (None, None), (8, "😂" * 9)]
    docs = spark.createDataFrame([(d, t, *CLASHES) for d, t in rows],
                                 ", ".join(["doc_id long, text string", *(f"`{c}` string" for c in CLASHES)]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert {d for d, _ in got} <= {d for d, _ in rows}
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        if stage is corpus_pipeline.secrets_stage:
            want = [(d, t and t.replace('token = "0123456789abcdef0123456789abcdef', "[SECRET]")) for d, t in rows]
            assert sorted(got, key=key) == sorted(want, key=key)
        if stage is corpus_pipeline.decontamination_stage:
            assert sorted(got, key=key) == sorted(rows, key=key)
        if stage is corpus_pipeline.near_duplicate_stage and len(rows) > 3:
            assert len(got) == len(set(got)) and {(1, None), (1, ""), (2, ""), (5, rows[8][1])} <= set(got)
            assert [d for d, t in got if t == rows[5][1]] == [0] and 6 not in {d for d, _ in got}
        for r in out.take(3):
            assert [r[c] for c in CLASHES] == CLASHES
    ids = corpus_pipeline.bpe_stage(spark, docs, sf_dir).collect()
    assert len(ids) == len(rows) and all((r.n_tokens == 0) == (r.decoded == "") for r in ids)
