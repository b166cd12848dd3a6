"""One registered query per operator of this subpackage, over the driver tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import (bpe, conversations, decontaminate, embeddings, langid, licenses, minhash, negatives, quality, secrets, tokenids,
                         toxicity, warc)
from lotline.sources.tables import table


def _remainder(by: int) -> Column:
    """``crc32(doc_id as text) mod by``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def _held_out(by: int, remainder: int) -> Column:
    return F.coalesce(_remainder(by) == remainder, F.lit(False)).alias("held_out")


def op1_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                   _remainder(3) != 1)
    return scored.select("doc_id", _held_out(3, 1), "score", "predicted")


def op2_decontaminate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
place AS (
  SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM item WHERE len(words) > 0),
win AS (
  SELECT DISTINCT item_id, array_to_string(words[i : i + 9], ' ') AS w, len(words[i : i + 9]) AS n FROM place),
spot AS (SELECT r, words, unnest(generate_series(1, len(words))) AS i FROM doc),
hit AS (
  SELECT r, i, n, item_id FROM (
    SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
    FROM spot, (SELECT DISTINCT n FROM win) AS sizes WHERE i + n - 1 <= len(words)) AS s
  JOIN win USING (w, n)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) AS c GROUP BY r),
which AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) AS u GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN which USING (r)
"""


def op3_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_langid_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), _remainder(4) != 2)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op6_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM page),
keeper AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM sized WHERE payload_bytes >= 1000
           GROUP BY payload_digest, payload_bytes)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN coalesce(page_id, keeper - 1) < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id, keeper - 1) < keeper THEN keeper END AS refers_to
FROM sized LEFT JOIN keeper USING (payload_digest, payload_bytes)
"""


def op7_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                     _remainder(4) != 2)
    return scored.select("doc_id", _held_out(4, 2), "score", "predicted")


def op8_secrets_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op9_bpe_trie(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary)


def op10_licence_digests(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents"), known)
    return found.withColumn("licenses", F.array_join("licenses", ","))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '{licenses.COPYRIGHT}', ' ', 'g')"
    out = f"trim(regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    out = f"regexp_replace({out}, '{licenses.ENDINGS}', '\\1iz\\2', 'g')"
    for other, usual in licenses.SPELLINGS.items():
        out = f"replace({out}, '{other}', '{usual}')"
    return out


_KNOWN_SQL = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.KNOWN)
OP10_SQL = f"""
WITH known AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(k) AS license FROM (VALUES {_KNOWN_SQL}) AS v(k, t)
               WHERE {_canonical_sql('t')} <> '' GROUP BY 1),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT r, doc_id, sha256({_canonical_sql('text')}) AS digest FROM doc),
line AS (SELECT r, unnest(string_split_regex(text, '\r?\n')) AS part FROM doc),
hit AS (SELECT r, license FROM line JOIN known ON sha256({_canonical_sql('part')}) = digest),
lines AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
ids AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (
          SELECT r, license FROM hit UNION SELECT r, license FROM whole JOIN known USING (digest)) AS u GROUP BY r)
SELECT doc_id, digest AS canonical_sha256, license AS license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines,
  coalesce(licenses, '') AS licenses
FROM whole LEFT JOIN known USING (digest) LEFT JOIN lines USING (r) LEFT JOIN ids USING (r)
"""


def op11_token_ids_pfor(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    found = tokenids.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 50 == 0)


OP12_SQL = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
item AS (SELECT vec_id, label, unnest(q) AS v, generate_subscripts(q, 1) AS d FROM part),
score AS (
  SELECT a.vec_id AS anchor, a.label AS label, b.vec_id AS other, b.label AS other_label, CAST(sum(a.v * b.v) AS BIGINT) AS s
  FROM item AS a JOIN item AS b ON a.d = b.d WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
positive AS (
  SELECT anchor, label, other AS positive, s AS ps FROM score WHERE other_label = label
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, other) <= 5)
SELECT anchor AS anchor_id, positive AS positive_id,
  CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY s DESC, other) AS INTEGER) AS rank,
  other AS negative_id, ps AS positive_score, s AS negative_score
FROM positive JOIN score USING (anchor)
WHERE other_label <> positive.label AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY s DESC, other) <= 3
"""


def op13_conversation_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair_conversations(conversations.damage(rows)))
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    found = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fourier": op1_quality_fourier,
    "op2_decontaminate_prefix": op2_decontaminate_prefix,
    "op3_minhash_odd_sketch": op3_minhash_odd_sketch,
    "op4_embedding_collisions": op4_embedding_collisions,
    "op5_langid_bayes": op5_langid_bayes,
    "op6_warc_seekable": op6_warc_seekable,
    "op7_toxicity_compression": op7_toxicity_compression,
    "op8_secrets_markov": op8_secrets_markov,
    "op9_bpe_trie": op9_bpe_trie,
    "op10_licence_digests": op10_licence_digests,
    "op11_token_ids_pfor": op11_token_ids_pfor,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_agenda": op13_conversation_agenda,
}

#: DuckDB SQL by query; the queries without an entry are tested by brute force in ``tests/llm``.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate_prefix": OP2_SQL,
    "op6_warc_seekable": OP6_SQL,
    "op10_licence_digests": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}
