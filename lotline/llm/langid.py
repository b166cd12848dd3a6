"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered and everything else becomes a space.  The n-grams of up to
three characters are hashed into ``buckets``; per language their counts, added
up over the partitions of the training rows, give a matrix of smoothed log
probabilities.  The matrix (languages x buckets, fixed by the parameters) is
broadcast, and each batch of texts is scored by gathering matrix rows.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.llm import textnum as tn
from lotline.llm.partial import summed

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
_CHUNK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if "letters" not in _tables:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(x := chr(c))[0] == "L":
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j`` as one array of letters, with the offset of each row."""
    buf, off = tn.utf8(column)
    for i, j in tn.blocks(off):
        part, rows = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        yield i, j, _letters()[codes], lead[rows]


def _grams(letters: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram that holds a letter and lies in one row.

    Rows are taken as if a space stood on either side.
    """
    n = len(rows) - 1
    padded = np.full(len(letters) + 2 * n, 32, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(rows) + 2)
    inner = np.ones(len(padded), bool)
    start = rows[:-1] + 2 * np.arange(n)
    inner[start] = inner[rows[1:] + 2 * np.arange(n) + 1] = False
    padded[inner] = letters
    for k in range(0, len(padded), _CHUNK):
        part = padded[k:k + _CHUNK + ORDERS[-1] - 1]
        who = owner[k:k + _CHUNK + ORDERS[-1] - 1]
        solid = part != 32
        for order in ORDERS:
            m = min(_CHUNK, len(part) - order + 1)
            if m <= 0:
                continue
            h, some = np.full(m, order, np.uint64), np.zeros(m, bool)
            for d in range(order):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[d:d + m]
                some |= solid[d:d + m]
            keep = some & (who[:m] == who[order - 1:order - 1 + m])
            yield (tn.mix(h[keep]) % np.uint64(buckets)).astype(np.int64), who[:m][keep]


def train(rows: DataFrame, languages: list[str], *, buckets: int = 1 << 16, smoothing: float = 0.5) -> np.ndarray:
    """Log probabilities ``(languages, buckets + 1)`` from ``rows(text, lang)``; the last column is the prior."""
    index = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            who = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()])
            for i, j, letters, off in _blocks(batch.column(0)):
                lang = who[i:j]
                for k in np.unique(lang[lang >= 0]):
                    total.setdefault(int(k), np.zeros(buckets + 1))[-1] += (lang == k).sum()
                for bucket, owner in _grams(letters, off, buckets):
                    for k in np.unique(lang[lang >= 0]):
                        total[int(k)][:-1] += np.bincount(bucket[lang[owner] == k], minlength=buckets)
        return total

    sums = summed(rows.select("text", "lang"), count, max_partitions=16)
    counts = np.array([sums.get(k, np.zeros(buckets + 1)) for k in range(len(languages))])
    grams = counts[:, :-1] + smoothing
    prior = counts[:, -1] + 1
    return np.column_stack([np.log(grams / grams.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())])


def identify(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", *, max_documents: int = 20_000, buckets: int = 1 << 16, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    Learns from rows with a language where ``trainable`` holds; of more than
    ``max_documents`` of them, a share chosen by a hash of the id.  The
    prediction uses the text alone: ``score`` is the posterior probability of
    the language predicted, the first by name among equals.  A text that is
    null or has no letter is ``und`` with score 0, and so is every text if
    there is nothing to learn from.  Repeated rows and null ids are scored like
    any other; other columns are ignored; an empty table gives no rows.
    """
    known = docs.where(trainable & F.col(lang_col).isNotNull())
    total = known.count()
    if total > max_documents:
        known = known.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1_000_000)) < int(1e6 * max_documents / total))
    sample = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    matrix = train(sample, languages, buckets=buckets) if languages else np.zeros((0, buckets + 1))
    # a row per bucket, so that one gather reads all languages; shared by the tasks of an executor
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix.T.astype(np.float32).copy()))

    def run(batches):
        names, table = shared.value
        for batch in batches:
            for i, j, letters, off in _blocks(batch.column(1)):
                n = j - i
                some = np.diff(np.concatenate([[0], np.cumsum(letters != 32)])[off]) > 0
                score = np.tile(table[-1].astype(np.float64), (n, 1))
                if names:
                    for bucket, owner in _grams(letters, off, buckets):
                        sums = np.cumsum(table[bucket], axis=0, dtype=np.float64)
                        cut = np.flatnonzero(np.diff(owner, append=n))
                        part = np.diff(sums[cut], axis=0, prepend=0)
                        np.add.at(score, owner[cut], part)
                    best = score.argmax(axis=1)
                    chance = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
                lang = [names[best[k]] if names and some[k] else UNDETERMINED for k in range(n)]
                value = np.where(some, chance, 0.0) if names else np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(lang, pa.string()), pa.array(value)],
                                                 names=["id", "lang_pred", "score"])

    return texts.mapInArrow(run, T.StructType(
        [texts.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    ).withColumnRenamed("id", id_col)
