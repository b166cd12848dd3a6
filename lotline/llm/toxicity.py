"""Toxicity by compression distance: one zstandard dictionary per class.

A window is a word between spaces, lowered and without ASCII punctuation
around it; what is longer than a window is cut at ASCII punctuation, and, where
that does not do (scripts without spaces), into byte windows that overlap.  A
fixed filler that both dictionaries know stands behind it (zstandard does not
compress a few bytes alone).  The ordinary dictionary is trained on windows of
ordinary texts, the toxic one on words that are much more frequent in toxic
texts and on byte windows of toxic texts.  What a window's lengths
under the two dictionaries say is calibrated: the log ratio of toxic to
ordinary labelled texts that hold a window of this size with this pair of
lengths.  A text scores by its highest windows, and an isotonic curve over a
fold that the ratios have not seen turns that into a probability.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.frames import written
from lotline.llm.partial import summed
from lotline.llm.quality import pool_adjacent
from lotline.llm.textnum import blocks, utf8

TRIMMED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FILLER = b"\n=~=~0123456789=~=~\n"
#: A word of this many bytes is cut; byte windows begin this far apart, so 18 bytes always lie whole in one.
WINDOW, STRIDE = 24, 6
_CUTS = re.compile(("[" + re.escape(TRIMMED) + "]+").encode())
#: More than any size of a word or part (with the blanks around it) and any compressed length; runs have the last size.
_SIZES, _LENGTHS = WINDOW + 3, 64
_RUN = (_SIZES - 1) * _LENGTHS * _LENGTHS
_CELLS = _SIZES * _LENGTHS * _LENGTHS
#: Scores in [-10, 20) are counted in this many bins for the isotonic curve.
_BINS, _LOW, _SPAN = 3000, -10.0, 30.0
#: A worker forgets its words when it knows more than this; words of several windows are never kept.
KNOWN_WORDS = 250_000


def words_of(text: str) -> set[str]:
    return {w.strip(TRIMMED) for w in text.lower().split()} - {""}


def windows(word: str) -> Iterator[bytes]:
    """A word of less than ``WINDOW`` bytes, else its parts and byte windows; only the latter have that size."""
    whole = word.encode()
    for part in [whole] if len(whole) < WINDOW else _CUTS.split(whole):
        if len(part) < WINDOW:
            if part:
                yield part
        else:
            for i in range(0, len(part) - WINDOW, STRIDE):
                yield part[i:i + WINDOW]
            yield part[-WINDOW:]


def window_counts(rows: DataFrame) -> DataFrame:
    """``word, cut, toxic, ordinary``: texts of either class that hold each; rows are ``(text, y, taught)``.

    Words are whole here; the byte windows (``cut``) are those of words that are
    not plain ASCII, in the rows to be ``taught``.
    """
    def emit(batches):
        for batch in batches:
            y, taught, k = batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
            for texts in _texts(batch.column(0)):
                found, cut, whose = [], [], []
                for t in texts:
                    words = words_of(t)
                    each = {x for w in words if not w.isascii() for x in windows(w) if len(x) == WINDOW} if taught[k] else set()
                    found += [w.encode() for w in words]
                    found += each
                    cut += [False] * len(words) + [True] * len(each)
                    whose += [y[k]] * (len(words) + len(each))
                    k += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array(cut, pa.bool_()), pa.array(whose, pa.int32())], names=["word", "cut", "y"])

    return rows.select("text", "y", "taught").mapInArrow(emit, "word binary, cut boolean, y int").groupBy("word", "cut").agg(
        F.sum("y").cast("double").alias("toxic"), F.sum(1 - F.col("y")).cast("double").alias("ordinary"))


def _dictionary(words: list[tuple[bytes, int]], size: int) -> bytes:
    """A trained dictionary; too few samples to train on are its content as they are."""
    samples = [b" " + w + b" " + FILLER for w, times in words for _ in range(times)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or FILLER


@dataclass
class Model:
    """Two dictionaries, the log ratios of the cells, the isotonic curve."""
    toxic: bytes
    ordinary: bytes
    level: int
    ratios: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.compressors: list[zstandard.ZstdCompressor] = []

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.level, self.ratios, self.knots, self.levels)

    def __setstate__(self, state):
        self.__init__(*state)

    def cell(self, window: bytes) -> int:
        if not self.compressors:
            for content in (self.toxic, self.ordinary):
                d = zstandard.ZstdCompressionDict(content)
                self.compressors.append(zstandard.ZstdCompressor(
                    level=self.level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        a, b = (len(c.compress(b" " + window + b" " + FILLER)) for c in self.compressors)
        return ((len(window) + 2) * _LENGTHS + a) * _LENGTHS + b

    def cells(self, text: str) -> set[int]:
        """The cells of all words and parts of a text, and for each run its greatest lead of the toxic dictionary.

        A run has many byte windows, whose chance lengths would add up to noise.
        """
        out, known = set(), self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words_of(text):
            c = known.get(w)
            if c is None:
                lead = -1
                for window in windows(w):
                    c = self.cell(window)
                    if len(window) < WINDOW:
                        out.add(c)
                    else:
                        lead = max(lead, c % _LENGTHS - c // _LENGTHS % _LENGTHS, 0)
                if lead >= 0:
                    out.add(_RUN + lead)
                if len(w.encode()) < WINDOW:  # its only window
                    known[w] = c
            else:
                out.add(c)
        return out

    def raw(self, text: str) -> float:
        """The highest log ratio, and a tenth of the next, so that a second window counts."""
        values = np.sort(self.ratios[list(self.cells(text))])[-2:]
        return float(values[-1] + 0.1 * max(values[0], 0) * (len(values) > 1)) if len(values) else _LOW

    def score(self, text: str) -> float:
        if self.knots is None:
            return 0.5
        return float(np.clip(np.interp(self.raw(text), self.knots, self.levels), 0, 1))


def _texts(column: pa.Array):
    """Texts in lists of bounded size; null is empty."""
    _, off = utf8(column)
    for i, j in blocks(off):
        yield [t or "" for t in column.slice(i, j - i).to_pylist()]


def fit(rows: DataFrame, *, max_rows: int = 40_000, toxic_words: int = 3_000, ordinary_words: int = 40_000,
        toxic_size: int = 16_384, ordinary_size: int = 112_640, level: int = 9, least_share: float = 0.006,
        least_ratio: float = 20.0, seed: int = 9) -> Model | None:
    """Fit on ``rows(id, text, y)`` with y 0 or 1; None without rows of both classes.

    Of more than ``max_rows`` rows, a share chosen by a hash of the id is used.
    A toxic word is in at least 3 toxic texts and a ``least_share`` of them, and
    ``least_ratio`` times likelier there than in an ordinary text.  Byte windows
    begin anywhere, so few repeat: up to ``toxic_words`` of those that only toxic
    texts hold are samples, too, and what these have in common is left to the
    training of the dictionary.  They come from two fifths of the rows, the
    ratios of runs from other two.
    """
    total = rows.count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    if total > max_rows:
        rows = rows.where(part < int(1e6 * max_rows / total))
    rows = written(rows.select("text", "y", (part % 5 == 0).alias("held"), (part % 5).isin(1, 2).alias("taught")), "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    # copies of a text teach its words once
    counts = written(window_counts(rows.groupBy("text", "y").agg(F.bool_and("taught").alias("taught"))), "words")
    cut = F.col("cut")
    typical = ~cut & (F.col("toxic") >= max(3, least_share * n[1])) & (
        F.col("toxic") / n[1] >= least_ratio * F.col("ordinary") / n[0])

    def samples(which: Column, label: str, limit: int, most: int) -> list[tuple[bytes, int]]:
        chosen = counts.where(which).orderBy(F.desc(label), F.asc("word")).limit(limit).collect()
        return [(bytes(r["word"]), int(min(most, r[label]))) for r in chosen]

    toxic = samples(typical, "toxic", toxic_words, 40) + samples(cut & (F.col("ordinary") == 0), "toxic", toxic_words, 1)
    some = F.col("ordinary") > 0
    ordinary = samples(~cut & ~typical & some, "ordinary", ordinary_words, 1) + samples(cut & some, "ordinary", ordinary_words, 1)
    model = Model(_dictionary(toxic, toxic_size), _dictionary(ordinary, ordinary_size), level)

    def count(batches):
        out = {0: np.zeros(_CELLS), 1: np.zeros(_CELLS)}
        for b in batches:
            y, taught, k = b.column(1).to_pylist(), b.column(2).to_pylist(), 0
            for texts in _texts(b.column(0)):
                for t in texts:
                    out[y[k]][[c for c in model.cells(t) if c < _RUN or not taught[k]]] += 1
                    k += 1
        return out

    fold = rows.where("not held").select("text", "y", "taught")
    m = {r["y"]: r["n"] for r in fold.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = summed(fold, count, max_partitions=16)
    a, b = (sums.get(k, np.zeros(_CELLS)) for k in (1, 0))
    model.ratios = np.where(a + b > 0, np.log((a + 0.2) / (m.get(1, 0) + 1)) - np.log((b + 0.2) / (m.get(0, 0) + 1)), 0)

    def bins(batches):
        out = np.zeros(2 * _BINS)
        for b in batches:
            y, k = b.column(1).to_pylist(), 0
            for texts in _texts(b.column(0)):
                for t in texts:
                    at = int(np.clip((model.raw(t) - _LOW) / _SPAN * _BINS, 0, _BINS - 1))
                    out[at] += 1
                    out[_BINS + at] += y[k]
                    k += 1
        return {0: out}

    c = summed(rows.where("held").select("text", "y"), bins, max_partitions=16).get(0)
    if c is None or not c.any():  # too few rows to hold any out
        c = summed(fold.select("text", "y"), bins, max_partitions=16)[0]
    used = np.flatnonzero(c[:_BINS])
    model.knots, model.levels = pool_adjacent(c[used], c[used + _BINS], _LOW + (used + 0.5) * _SPAN / _BINS)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: id, score in [0, 1], predicted 0 or 1.

    Learns from the texts of rows of ``labels`` (y 0 or 1) where ``trainable``
    holds; an id labelled more than once takes the mean, rounded half up.  A
    score depends on the text alone.  Null and empty texts get the score of a
    text without windows; repeated rows and null ids are scored like any other;
    other columns are ignored; an empty ``docs`` gives no rows, labels of fewer
    than two classes score 0.5.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    y = labels.where(trainable).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.floor(F.avg("y") + 0.5).cast("int").alias("y"))
    bound = options.get("max_rows", 40_000)
    known = y.count()
    if known > 2 * bound:  # read no more texts than may be used
        y = y.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(2e6 * bound / known))
    model = fit(written(texts.join(F.broadcast(y), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "y"),
                        "labelled"), **options) or Model(b"", b"", 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            scores = [m.score(t) for part in _texts(batch.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = texts.mapInArrow(run, T.StructType([texts.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
