"""Quality classifier: random Fourier features of document statistics.

Every text is reduced to a vector of statistics (shares of byte classes, word
lengths, repetition, entropy).  The cosine features ``sqrt(2/D) cos(Wx + b)``
of the standardised vector approximate a Gaussian kernel; each partition of the
training rows sums its part of the normal equations, whose size depends on
``D`` alone, and the driver solves the ridge system.  Scores of a fold that
the fit has not seen are counted in fixed bins and pooled into an isotonic
curve, which maps a raw score to a probability.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.frames import written
from lotline.llm import textnum as tn
from lotline.llm.partial import summed

#: Byte classes: each string lists the bytes of one class; the rest are by range.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?",
            "#$%&*@^~=+", "|<>{}[]\\_/", "\"'`()-:;"]
_MEMBER = np.zeros((256, len(_CLASSES) + 3))
for _k, _s in enumerate(_CLASSES):
    _MEMBER[[ord(c) for c in _s], _k] = 1
_MEMBER[0x80:0xC0, -3] = 1
_MEMBER[0xC0:, -2] = 1
_MEMBER[:, -1] = _MEMBER.sum(axis=1) == 0
N_FEATURES = _MEMBER.shape[1] + 13
#: Raw ridge scores in [-1, 2) are counted in this many bins for the isotonic curve.
_BINS, _LOW, _SPAN = 3072, -1.0, 3.0


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the values of each row's range of items."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[rows])


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner."""
    _, first = np.unique(tn.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner[first], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``N_FEATURES`` statistics for each text of a block."""
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n) * 256, size)
    hist = np.bincount(owner + buf, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1)
    share = hist / total[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, rows = tn.words(buf, off)
    m = np.diff(rows)
    safe = np.maximum(m, 1)
    word = tn.word_hashes(buf, starts, ends)
    whose = np.repeat(np.arange(n), m)
    length = (ends - starts).astype(np.float64)
    mean = _per_row(length, rows) / safe
    spread = np.sqrt(np.maximum(_per_row(length ** 2, rows) / safe - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, whose, length)
    again, triple = np.zeros(len(word)), np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (whose[1:] == whose[:-1])
    three = word.copy()
    three[:-2] += word[1:-1] * np.uint64(3) + word[2:] * np.uint64(7)
    inside = np.zeros(len(word), bool)
    inside[:-2] = whose[2:] == whose[:-2]
    triples = np.bincount(whose[inside], minlength=n)
    first, last = buf[starts], buf[ends - 1]
    lines = hist[:, 10] + 1
    columns = [np.log1p(size), entropy, np.log1p(m), np.log1p(mean), np.log1p(spread), np.log1p(longest),
               _distinct(word, whose, n) / safe,
               _distinct(three[inside], whose[inside], n) / np.maximum(triples, 1),
               _per_row(again, rows) / safe,
               _per_row((first >= 65) & (first <= 90), rows) / safe,
               _per_row(last == 46, rows) / safe,
               _per_row((last < 48) & (last != 46) & (last != 44), rows) / safe,
               np.log1p(m / lines)]
    return np.column_stack([share @ _MEMBER, *columns])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every whole text; null counts as empty."""
    @tn.tidy
    def run(batches):
        for batch in batches:
            buf, off = tn.utf8(batch.column(1))
            parts = [statistics(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in tn.blocks(off)]
            x = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, N_FEATURES), np.float32)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, T.StructType([T.StructField("id", texts.schema["id"].dataType),
                                               T.StructField("x", T.ArrayType(T.FloatType()))]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Standardisation, random directions, ridge weights, isotonic curve."""
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def pool_adjacent(counts: np.ndarray, positive: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling: knots and non-decreasing levels.

    One half-count of either label is spread over a pool, so no level is 0 or 1.
    """
    pools: list[list[float]] = []
    for c, p, x in zip(counts, positive, at, strict=True):
        pools.append([c, p, c * x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            c2, p2, x2 = pools.pop()
            pools[-1] = [pools[-1][0] + c2, pools[-1][1] + p2, pools[-1][2] + x2]
    total = np.array(pools)
    levels = np.maximum.accumulate((total[:, 1] + 0.5) / (total[:, 0] + 1))
    return total[:, 2] / total[:, 0], levels


def fit(stats: DataFrame, labels: DataFrame, *, n_features: int = 256, ridge: float = 1e-4,
        max_rows: int = 200_000, seed: int = 3) -> Model:
    """Fit on ``labels(id, y)``: y is 0 or 1, other values and null ids do not count.

    An id labelled more than once takes the mean of its labels, rounded half
    up.  Of more than ``max_rows`` labelled ids, a share chosen by a hash of
    the id is used.  Without rows, every score is 0.5.
    """
    y = labels.where("id is not null and y in (0, 1)").groupBy("id").agg(
        F.floor(F.avg("y") + 0.5).cast("double").alias("y"))
    known = y.count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    if known > max_rows:
        y = y.where(part < int(1e6 * max_rows / known))
    rows = written(stats.join(y, "id").select("x", "y", (part % 5 == 0).alias("held")), "training")
    fold = rows.where("not held").select("x", "y")

    def moments(batches):
        total = np.zeros(1 + 2 * N_FEATURES)
        for b in batches:
            x = _matrix(b.column(0))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x ** 2).sum(axis=0)])
        return {0: total}

    m = summed(fold, moments).get(0, np.zeros(1 + 2 * N_FEATURES))
    count = max(m[0], 1)
    mean = m[1:1 + N_FEATURES] / count
    scale = np.sqrt(np.maximum(m[1 + N_FEATURES:] / count - mean ** 2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, n_features)),
                  rng.uniform(0, 2 * np.pi, n_features))
    if not m[0]:
        return model

    def normal(batches):
        size = n_features + 1
        gram = np.zeros((size, size + 1))
        for b in batches:
            z, t = model.features(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False)
            gram += z.T @ np.column_stack([z, t])
        return dict(enumerate(gram))

    g = summed(fold, normal)
    gram = np.array([g[k] for k in range(n_features + 1)])
    penalty = ridge * count * np.eye(n_features + 1)
    penalty[-1, -1] = 0
    model = Model(mean, scale, model.directions, model.phases, np.linalg.solve(gram[:, :-1] + penalty, gram[:, -1]))

    def bins(batches):
        total = np.zeros(2 * _BINS)
        for b in batches:
            t = b.column(1).to_numpy(zero_copy_only=False)
            k = np.clip((model.raw(_matrix(b.column(0))) - _LOW) / _SPAN * _BINS, 0, _BINS - 1).astype(int)
            total += np.concatenate([np.bincount(k, minlength=_BINS), np.bincount(k, t, minlength=_BINS)])
        return {0: total}

    c = summed(rows.where("held").select("x", "y"), bins).get(0, np.zeros(2 * _BINS))
    if not c.any():  # too few rows to hold any out
        c = summed(fold, bins)[0]
    used = np.flatnonzero(c[:_BINS])
    knots, levels = pool_adjacent(c[used], c[used + _BINS], _LOW + (used + 0.5) * _SPAN / _BINS)
    return Model(mean, scale, model.directions, model.phases, model.weights, knots, levels)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """``(id, score)`` of every row of ``stats``."""
    @tn.tidy
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))],
                                             names=["id", "score"])

    return stats.select("id", "x").mapInArrow(run, T.StructType(
        [stats.schema["id"], T.StructField("score", T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", threshold: float = 0.5,
                  **options) -> DataFrame:
    """One row per row of ``docs``: id, score in [0, 1], predicted 0 or 1.

    Labels are learnt from rows of ``labels`` where ``trainable`` holds; a
    score depends on the text alone.  Null and empty texts get the score of an
    empty text; repeated rows and null ids are scored like any other; other
    columns are ignored.  An empty ``docs`` gives no rows, empty labels 0.5.
    """
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels.where(trainable).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")), **options)
    return apply(stats, model).select(F.col("id").alias(id_col), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))
