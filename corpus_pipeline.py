"""From raw documents to token ids: the stages of a training corpus.

``STAGES`` names the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a frame; all but the last return the columns of ``docs``.  ``run``
writes every stage's result as Parquet in the shared scratch folder and reads
it again as the next one's input.

Rows are told apart by document id and text together, so a null or repeated
``doc_id`` is judged row by row; columns beyond those of ``documents`` are
carried along, whatever their names; of its columns ``doc_id`` and ``text`` must
be there.  A null text is judged as an empty one (but stays null), texts of any
length are judged whole, and an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.frames import written
from lotline.llm import bpe, decontaminate, minhash, quality, secrets
from lotline.sources.tables import table

#: Keys of a stage's decisions are broadcast up to this number, else joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Redactions (key and spans) are broadcast up to this number, else joined by a shuffle.
BROADCAST_SPANS = 100_000
#: Arrow batches of whole texts stand in the executor and in its Python worker at once: at most this many bytes each.
BATCH_BYTES = 4 << 20
_KEY = "__stage_key"


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _node() -> Column:
    """Like ``_key``, but a null text is not an empty one."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull())


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has a bound of its own; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _columns(names: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def _bounded(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _without(docs: DataFrame, keys: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` less the rows whose key is in ``keys``."""
    name = _free(docs, "__key")
    keys = written(keys.select(F.col(_KEY).alias(name)).distinct(), "rejected")
    return docs.join(_bounded(keys, BROADCAST_KEYS), (_key() if key is None else key) == F.col(name), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it never learns from a third of the labels.

    A document goes if its score is less than 0.5; at 0.5 it stays.  Empty and
    null texts have a score like any other; equal rows have equal scores; rows
    with a null id are scored, too, but no label is theirs.
    """
    _small_batches(spark)
    keyed = docs.select("doc_id", "text", _key().alias(_KEY))
    stats = written(quality.document_statistics(keyed, _KEY, "text"), "statistics")
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "quality")
    model = quality.fit(stats, keyed.select("doc_id", _KEY).join(labels, "doc_id").select(
        F.col(_KEY).alias("id"), F.col("quality").alias("y")))
    return _without(docs, quality.apply(stats, model).where("score < 0.5").withColumnRenamed("id", _KEY))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, and one of all rows that are equal in id and text.

    Every id with a text is a node of its own, so texts that share an id, or
    have none, are judged each by itself.  A group keeps its smallest id; a row
    without an id only if none has one.  Of rows equal in id and text that
    differ in other columns, the least by these columns stays.  Texts without
    words have no near duplicates but their equal rows.
    """
    _small_batches(spark)
    nodes = written(docs.groupBy(_node().alias(_KEY)).agg(
        F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "nodes")
    found = minhash.near_duplicates(docs.select(_node().alias(_KEY), "text"), id_col=_KEY).groupBy(_KEY).agg(
        F.first("component_id").alias("component"))
    members = written(nodes.join(found, _KEY), "components")
    first = members.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", _KEY)).alias("m")).select(F.col(f"m.{_KEY}").alias(_KEY))
    stays = written(members.select(_KEY, "n").join(first.withColumn("stays", F.lit(True)), _KEY, "left"), "decided")
    kept = _without(docs, stays.where("stays is null"), _node())
    name = _free(docs, "__key")
    again = written(stays.where("stays and n > 1").select(F.col(_KEY).alias(name)), "repeated")
    if again.isEmpty():
        return kept
    repeated = _bounded(again, BROADCAST_KEYS)
    same = _node() == F.col(name)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*_columns(rest))) if rest else F.lit("")
    one = kept.join(repeated, same, "left_semi").groupBy(_node().alias(_KEY)).agg(
        F.min_by(F.struct(*_columns(docs.columns)), order).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null texts and texts without words hold none and stay; equal rows go or stay
    together; without items everything stays.
    """
    found = decontaminate.contamination(docs.select(_key().alias(_KEY), "text"), table(spark, sf_dir, "benchmark"), id_col=_KEY)
    return _without(docs, found.where("n_hit > 0"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; ``n_chars``, if there, follows.

    Overlapping spans become one mask; equal rows get equal texts; null and
    empty texts, and texts without secrets, stay as they are.
    """
    found = secrets.find_secrets(docs.select(_key().alias(_KEY), "text"), id_col=_KEY).where(F.size("spans") > 0)
    key, cut = _free(docs, "__key"), _free(docs, "__spans")
    spans = written(found.select(F.col(_KEY).alias(key), F.col("spans").alias(cut)).dropDuplicates([key]), "redactions")
    joined = docs.join(_bounded(spans, BROADCAST_SPANS), _key() == F.col(key), "left")
    has = F.col(cut).isNotNull()
    text = F.when(has, secrets.redacted(F.col("text"), F.col(cut))).otherwise(F.col("text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(has, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return joined.withColumn("text", text).select(*_columns(docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document and the text that they decode to: doc_id, input_ids, n_tokens, decoded.

    Null and empty texts have no ids and decode to the empty text; every row is
    encoded by itself, repeated ones, too.  It keeps fewer strings and pairs than
    the operator by itself, since earlier stages' workers share the executors.
    """
    _small_batches(spark)
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(docs, vocabulary, known_strings=50_000, known_pairs=40_000, decoded=True).select(
        "doc_id", "input_ids", F.size("input_ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL cannot express the classifier's fit, nor BPE; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
