"""Near-duplicate documents by MinHash bands and odd sketches.

1. One pass over the texts gives each document its number of distinct word
   shingles, a digest of that set, ``bands`` keys of MinHash minima, and an odd
   sketch of its k minimum hashes: every sample flips one bit of a parity
   bitmap.  Samples that two documents share cancel in the XOR of the bitmaps,
   whose population count thus estimates a high similarity precisely.  The
   samples are all hashes below a power of two that leaves ``SAMPLES`` at most;
   a second bitmap one power lower lets neighbouring sizes be compared.
2. Documents with equal sets become one class (its smallest id).
3. In every bucket of classes with a band in common, each class is compared
   with one centre, not with all others.  Links found join classes to
   components.
4. Then only classes of *different* components in one bucket are compared, so
   a large group of copies costs a row per copy.  While another round of
   centres would leave far fewer such pairs, it comes first; the last step
   compares all of the rest, so no candidate of a bucket is left out.
5. A pair is compared by lengths and sketches first, then by its full sets.

With 51 bands of 5 minima a pair of similarity 0.75 shares no band with
probability 1e-6, and the sketch test keeps it up to 4.5 deviations.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.frames import tasks_for, written
from lotline.graph import components
from lotline.llm import textnum as tn

SHINGLE_WORDS = 5
BANDS, ROWS = 51, 5
SAMPLES, SKETCH_LONGS = 1024, 16
#: Ids of texts to read again are broadcast up to this number, else joined by a shuffle.
BROADCAST_IDS = 2_000_000
_BITS = SKETCH_LONGS * 64
_STEP = [np.uint64(x) for x in np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)]
_TILE = 512


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a block."""
    low = tn.lower_ascii(buf)
    starts, ends, rows = tn.words(low, off)
    w = tn.word_hashes(low, starts, ends)
    full = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for k in range(width):
        full += w[k:k + len(full)] * _STEP[k]
    full = tn.mix(full)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= width:
            yield np.unique(full[a:b - width + 1])
        elif b > a:
            part = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                part += w[a + k:a + k + 1] * _STEP[k]
            yield tn.mix(part)
        else:
            yield np.zeros(0, np.uint64)


def _samples(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One minimum per factor over the set, in tiles that stay in the cache."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), _TILE):
        np.minimum(low, (h[k:k + _TILE, None] * factors[None, :]).min(axis=0), out=low)
    return low


def _signer(width: int, bands: int, per_band: int):
    n = bands * per_band
    factors = np.random.default_rng(11).integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    salts = tn.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    band_salt = tn.mix(np.arange(1, bands + 1, dtype=np.uint64))

    longs = pa.list_(pa.int64())
    numbers = ("n", "d1", "d2", "level", "s0", "s1")

    @tn.tidy
    def sign(batches):
        for batch in batches:
            buf, off = tn.utf8(batch.column(1))
            for i, j in tn.blocks(off):
                out: dict[str, list] = {c: [] for c in ("n", "d1", "d2", "bands", "level", "s0", "s1", "sketch")}
                for s in shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], width):
                    out["n"].append(len(s))
                    if not len(s):
                        for k in ("d1", "d2", "level", "s0", "s1"):
                            out[k].append(0)
                        for k in ("bands", "sketch"):
                            out[k].append(None)
                        continue
                    out["d1"].append(int(tn.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    out["d2"].append(int(np.bitwise_xor.reduce(tn.mix(s * _STEP[9])).view(np.int64)))
                    mins = tn.mix(_samples(s, factors).astype(np.uint64) + salts)
                    key = band_salt.copy()
                    for r in mins.reshape(bands, per_band).T:
                        key = tn.mix(key + r)
                    out["bands"].append(key.view(np.int64))
                    level = max(0, math.ceil(math.log2(len(s) / SAMPLES)))
                    out["level"].append(level)
                    bits = []
                    for k in (0, 1):
                        below = s if level + k == 0 else s[:np.searchsorted(s, np.uint64(1 << (64 - level - k)))]
                        out[f"s{k}"].append(len(below))
                        odd = np.bincount((tn.mix(below) >> np.uint64(40)).astype(np.int64) % _BITS, minlength=_BITS)
                        bits.append(np.packbits((odd & 1).astype(np.uint8)).view(np.int64))
                    out["sketch"].append(np.concatenate(bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(out[c], pa.int64()) for c in numbers],
                     pa.array(out["bands"], longs), pa.array(out["sketch"], longs)],
                    names=["id", *numbers, "bands", "sketch"])
    return sign


def _sets(width: int):
    @tn.tidy
    def read(batches):
        for batch in batches:
            buf, off = tn.utf8(batch.column(1))
            for i, j in tn.blocks(off):
                sets = [s.view(np.int64) for s in shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])
    return read


def _alike(percent: int, deviations: float = 4.5) -> Column:
    """Lengths and sketches of ``a`` and ``b`` allow the similarity.

    At similarity J, two samples of S hashes together differ in
    ``S (1 - J) / (1 + J)``; where the sample is not the whole set, that number
    is binomial.  After D flips in a bitmap of N bits, the expected odd bits
    are ``N/2 (1 - (1 - 2/N)^D)``, and their variance is that of a parity count.
    """
    q = (100 - percent) / (100 + percent)
    spread = (100 - percent) / 100 * percent / 100 / (1 + percent / 100)
    size = "(if(level_a >= level_b, s0_a, s1_a) + if(level_b >= level_a, s0_b, s1_b))"
    flips = f"({q!r}D * {size} + if(greatest(level_a, level_b) = 0, 0D, {deviations} * sqrt({spread!r}D * {size})))"
    one, two = f"pow({1 - 2 / _BITS!r}D, {flips})", f"pow({1 - 4 / _BITS!r}D, {flips})"
    deviation = f"sqrt(greatest(0D, {_BITS / 4} * (1 - {two}) + {_BITS ** 2 / 4} * ({two} - {one} * {one})))"
    odd = " + ".join(f"bit_count(if(level_a >= level_b, sketch_a[{k}], sketch_a[{k + SKETCH_LONGS}]) "
                     f"^ if(level_b >= level_a, sketch_b[{k}], sketch_b[{k + SKETCH_LONGS}]))" for k in range(SKETCH_LONGS))
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and abs(level_a - level_b) <= 1 "
                  f"and {odd} <= {_BITS / 2} * (1 - {one}) + {deviations} * {deviation} + 1")


_SKETCH = ("n", "level", "s0", "s1", "sketch")


def _end(reps: DataFrame, x: str, *more: Column) -> DataFrame:
    return reps.select(F.col("class_id").alias(x), *more, *[F.col(c).alias(f"{c}_{x}") for c in _SKETCH])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity, as a written table."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", tasks)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kind = texts.schema["id"].dataType
    sets = written(texts.join(wanted, "id", "left_semi").mapInArrow(
        _sets(width), T.StructType([T.StructField("id", kind), T.StructField("shingles", T.ArrayType(T.LongType()))])), "sets")
    joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
              .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                      F.size(F.array_intersect("sa", "sb")).alias("both")))
    return written(joined.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b").distinct(), "links", tasks)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75,
                    width: int = SHINGLE_WORDS, bands: int = BANDS, per_band: int = ROWS,
                    pairs_per_row: float = 8.0, worth: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.
    Two documents are linked if ``100 * intersection >= percent * union`` of
    their sets of distinct ``width``-word shingles (all words, if fewer).
    Null and empty texts have no shingles and link with nothing; repeated rows
    are linked copies; an id that repeats with other text is one node with the
    links of all its texts.  A row with a null id joins no links: its component
    is null and it is kept.  An empty table gives no rows; other columns of
    ``docs`` are ignored.  Another round of centres is taken while more than
    ``pairs_per_row`` pairs a class are left and the last round brought their
    number down to ``worth`` times what it was.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longs = T.ArrayType(T.LongType())
    sigs = written(texts.mapInArrow(_signer(width, bands, per_band), T.StructType(
        [T.StructField("id", texts.schema["id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n", "d1", "d2", "level", "s0", "s1")]
        + [T.StructField(c, longs) for c in ("bands", "sketch")])), "signatures")
    tasks = tasks_for(sigs.count())
    real = sigs.where("id is not null and n > 0")
    classes = written(real.groupBy("d1", "d2").agg(F.min("id").alias("class_id")), "classes", tasks)
    reps = written(real.join(classes, ["d1", "d2"]).where("id = class_id")
                   .select("class_id", "bands", *_SKETCH), "representatives", tasks)
    keys = reps.select(F.explode("bands").alias("key"), "class_id")
    buckets = written(keys.groupBy("key").agg(
        F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count(F.lit(1)).alias("c"))
        .where("low < high"), "buckets", tasks)
    rows = written(keys.join(buckets.select("key"), "key", "left_semi"), "band_rows", tasks)
    alike = _alike(percent)
    texts = texts.where("id is not null")

    centres = buckets.select("key", F.col("low").alias("b"))
    links, turn = None, 0
    pairs_before = buckets.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()[0] or 0
    while True:
        if centres is not None:
            pairs = rows.join(centres, "key").where("class_id <> b").select(F.col("class_id").alias("a"), "b").distinct()
        else:
            left = _end(rest, "a", "key", F.col("label").alias("la"), F.col("bands").alias("bands_a"))
            right = _end(rest, "b", F.col("key").alias("key_b"), F.col("label").alias("lb"), F.col("bands").alias("bands_b"))
            # of all buckets that two classes share, the first one gives the pair
            first = F.expr("array_position(zip_with(bands_a, bands_b, (x, y) -> x = y), true) = array_position(bands_a, key)")
            pairs = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("la") < F.col("lb")) & alike & first).select(
                "a", "b").distinct()
        if centres is not None:
            pairs = (pairs.join(_end(reps, "a"), "a").join(_end(reps, "b"), "b")
                     .where(alike).select("a", "b"))
        found = _confirmed(written(pairs, "pairs", tasks), texts, width, percent, tasks)
        links = found if links is None else links.unionByName(found)
        labels = written(components(links, "a", "b", tasks), "labels", tasks)
        if centres is None:
            break
        tagged = written(rows.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
            "key", "class_id", F.coalesce("component", "class_id").alias("label")), "tagged", tasks)
        mixed = written(tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                        .where("low < high").select("key"), "mixed", tasks)
        rows = written(tagged.join(mixed, "key", "left_semi"), "band_rows", tasks)
        # pairs of different components: all pairs of a bucket less those within one label
        sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
            F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        total, left_pairs = sizes.agg(F.sum("s"), F.sum(F.col("s").cast("double") * F.col("s") - F.col("q")) / 2).first()
        if not total:
            break
        turn += 1
        if pairs_per_row * total < left_pairs < worth * pairs_before:
            pairs_before = left_pairs
            # the centre of the next round: the class with the least hash in each bucket
            centres = written(rows.groupBy("key").agg(F.min(F.struct(
                F.xxhash64("class_id", F.lit(turn)).alias("h"), "class_id")).alias("m"))
                .select("key", F.col("m.class_id").alias("b")), "centres", tasks)
        else:
            rest = written(rows.join(reps, "class_id"), "rest", tasks)
            centres = None
        rows = rows.select("key", "class_id")
    member = sigs.select("id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.col("class_id")).alias("class_id"))
    return (member.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "class_id", "id")).alias("component_id"))
            .withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col))))
