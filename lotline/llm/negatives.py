"""Hard negatives by threshold joins over inverted indexes with norm bounds.

Vectors of integers are put into blocks of one label.  A join finds, for a
block of anchors and a block of rows, all pairs whose inner product reaches the
anchor's threshold.  The dimensions of a block stand in order of their weight;
a row is indexed under its leading dimensions only, those behind it being left
out as soon as the norm of the rest times any anchor's norm stays below the
threshold.  Partial scores are summed up over the lists of the index, a group of
dimensions at a time; a pair whose partial score and the product of both
remaining norms stay below the threshold is dropped, and the pairs that are left
get the rest of their dimensions.  Where the bounds leave most pairs open, as
between dense vectors of equal norms, the rest is summed up for all of them.

The blocks of rows are dealt to shards, and every shard meets the anchors once.
An anchor's threshold begins at the lower ends of its windows and rises with the
rows found so far: a window that is full asks for what reaches its last row
only.  First come the nearest rows of the same label, then the rows of other
labels in the window below each of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.frames import row_number_by, tasks_for, written

BLOCK_ROWS, BLOCK_ANCHORS, DIMENSIONS = 4096, 512, 16
#: Numbers are clipped here, so that scores stay within 64 bits up to 16 384 dimensions.
LARGEST = 1 << 24
#: Bytes of the rows of a shard, a block of them at least; the first rows of a shard, by which thresholds rise before the others come.
SHARD_BYTES, FIRST_ROWS = 1 << 24, (64, 512)
#: Pairs are looked at one by one if the bounds leave fewer than this share of them.
OPEN_SHARE = 0.25
#: A bound counts as reached if it falls short by this share, more than rounding takes.
SLACK = 1e-9


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the rest from each dimension on; one more column of zeros."""
    out = np.zeros((x.shape[0], x.shape[1] + 1))
    np.cumsum(np.square(x[:, ::-1], dtype=np.float64), axis=1, out=out[:, 1:])
    return np.sqrt(out[:, ::-1])


def _exact(a: np.ndarray, y: np.ndarray) -> type:
    """Floats or doubles where every sum of products is exact in them, else 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Index:
    """Rows with their dimensions in order of weight, and the norms of the rest behind each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.width = ids, rows.shape[1]
        self.heavy = np.argsort(-np.square(rows, dtype=np.float64).sum(axis=0), kind="stable")
        self.rows = rows[:, self.heavy]
        self.rest = _suffix_norms(self.rows)
        self._cast = {}

    def __len__(self) -> int:
        return len(self.rows)

    def cast(self, kind: type) -> np.ndarray:
        if kind not in self._cast:
            self._cast = {kind: self.rows.astype(kind)}
        return self._cast[kind]


def _mostly_open(score: np.ndarray, rest_a: np.ndarray, rest_y: np.ndarray, least: np.ndarray) -> bool:
    """Whether the bounds leave most of some pairs, told from pairs spread over the block: only how, not which pairs are scored."""
    i, j = slice(None, None, max(1, len(rest_a) // 32)), slice(None, None, max(1, len(rest_y) // 32))
    return bool((score[i, j] + np.outer(rest_a[i], rest_y[j]) * (1 + SLACK) >= least[i, None]).mean() > OPEN_SHARE)


def threshold_join(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray | Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every pair (anchor, row, score) whose score is at least ``least`` of the anchor, in several batches."""
    index = rows if isinstance(rows, Index) else Index(np.arange(len(rows)), rows)
    m, n, width = len(anchors), len(index), index.width
    if not m or not n:
        return
    if not width:
        a, y = np.nonzero(np.broadcast_to(least[:, None] <= 0, (m, n)))
        yield a, y, np.zeros(len(a), np.int64)
        return
    if anchors.shape[1] < width:
        anchors = np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
    a = anchors[:, index.heavy]  # dimensions beyond the rows' add nothing
    kind = _exact(a, index.rows)
    a, y, rest_a, rest_y = a.astype(kind), index.cast(kind), _suffix_norms(a), index.rest
    # scores are whole numbers, and floats hold those below 2**24
    bar = np.clip(np.ceil(least), -(1 << 24), 1 << 24).astype(kind) if kind is np.float32 else least
    # the index: a row stands under the dimensions before the first from which on its norm can reach no threshold
    norm = rest_a[:, 0]
    need = np.min(np.divide(least, norm, out=np.where(least > 0, np.inf, -np.inf), where=norm > 0))
    depth = np.full(n, width) if need <= 0 else (rest_y[:, :-1] * (1 + SLACK) >= need).sum(axis=1)
    depth = np.minimum(width, -(-depth // DIMENSIONS) * DIMENSIONS)
    at = np.arange(n)
    if depth.min() < width:
        at = np.argsort(-depth, kind="stable")
        at = at[depth[at] > 0]
        y, rest_y, depth = y[at], rest_y[at], depth[at]
    score, high = np.zeros((m, len(at)), kind), 0
    while high < width and len(at):
        low, high = high, min(width, high + DIMENSIONS)
        # rows stand by depth, so a list of the index is a prefix of them
        score += a[:, low:high] @ y[:, low:high].T
        if high < width and _mostly_open(score, rest_a[:, high], rest_y[:, high], least):
            low, high = high, width
            score += a[:, low:] @ y[:, low:].T
        if high == width:
            i, j = np.nonzero(score >= bar[:, None])
            yield i, at[j], score[i, j].astype(np.int64)
            return
        open_pairs = score + np.outer(rest_a[:, high], rest_y[:, high]) * (1 + SLACK) >= least[:, None]
        deeper = int(np.searchsorted(-depth, -high, "left"))
        if deeper < len(at):  # these end here: the rest of their dimensions for the pairs that are left
            i, j = np.nonzero(open_pairs[:, deeper:])
            j += deeper
            found = score[i, j]
            for p in range(0, len(i), 1 << 16):
                q = slice(p, p + (1 << 16))
                found[q] += np.einsum("pd,pd->p", a[i[q], high:], y[j[q], high:])
            keep = found >= bar[i]
            yield i[keep], at[j[keep]], found[keep].astype(np.int64)
        kept = np.flatnonzero(open_pairs[:, :deeper].any(axis=0))
        if not len(kept):
            return
        if len(kept) < len(at):
            at, y, rest_y, depth, score = at[kept], y[kept], rest_y[kept], depth[kept], score[:, kept]


def _matrix(lists: list, width: int) -> np.ndarray:
    """Rows of lists of numbers as a matrix; short ones are filled up with zeros."""
    out = np.zeros((len(lists), width), np.int32)
    for k, x in enumerate(lists):
        out[k, :len(x)] = x
    return out


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group, by score down, then id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.searchsorted(sorted_group, sorted_group, "left")
    return order[np.arange(len(order)) - start < k]


def _blocks(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """Rows (id, label, vector, number in the label) in blocks of one label: ids, vectors, and more columns as lists."""
    grouped = rows.groupBy("label", F.floor((F.col("number") - 1) / size).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "vector", *more))).alias("items"))
    part = lambda c, name: F.transform("items", lambda s: s[c]).alias(name)
    return grouped.select("label", "block", part("id", "ids"), part("vector", "vectors"), *[part(c, c) for c in more])


def _packed(blocks: DataFrame) -> DataFrame:
    """Blocks with their vectors as one binary matrix; a written table.

    Blocks of anchors have their windows as binary columns, too: of each anchor
    the place of its first window, and of each window its ends and its positive.
    """
    asking = "windows" in blocks.columns
    ends = ["first", "low", "high", "positive_id", "positive_score"] if asking else []

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, vectors = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                width = max(map(len, vectors))
                columns = [pa.array([np.array(ids, "<i8").tobytes()]), pa.array([width], pa.int32()),
                           pa.array([_matrix(vectors, width).astype("<i4").tobytes()])]
                if asking:
                    windows = batch.column(4)[k].as_py()
                    flat = [w for ws in windows for w in ws]
                    number = lambda c, none, kind: np.array([none if w[c] is None else w[c] for w in flat], kind).tobytes()
                    known = flat[0]["positive_id"] is not None
                    values = [np.cumsum([0, *map(len, windows)]).astype("<i8").tobytes(), number("low", -np.inf, "<f8"), number("high", np.inf, "<f8"),
                              *(number(c, 0, "<i8") if known else None for c in ("positive_id", "positive_score"))]
                    columns += [pa.array([v], pa.binary()) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *columns],
                                                 names=["label", "block", "ids", "width", "matrix", *ends])

    kind = blocks.schema["label"].dataType.simpleString()
    more = "".join(f", {c} binary" for c in ends)
    return written(blocks.mapInArrow(run, f"label {kind}, block long, ids binary, width int, matrix binary{more}"), "anchors" if asking else "blocks")


def _dealt(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """Partitions of shards, each with its blocks of rows before the blocks of anchors that it meets.

    The blocks of rows are dealt out to shards of bounded size, and each shard
    gets all anchors, or those of its labels: every anchor meets every row.
    """
    widest, n = blocks.agg(F.max("width"), F.count(F.lit(1))).first()
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = tasks_for(n, max(1, SHARD_BYTES // (4 * BLOCK_ROWS * max(1, widest or 0))), least)
    rows = blocks.withColumn("shard", F.pmod(F.hash("label") + F.col("block"), F.lit(shards)).cast("int"))
    if same:
        meeting = anchors.join(rows.select("label", "shard").distinct(), "label")
    else:
        meeting = anchors.join(rows.select("shard").distinct(), how="cross")  # shards at most
    every = rows.withColumn("asks", F.lit(False)).unionByName(meeting.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return every.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "label", "block")


FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _slices(label, ids: np.ndarray, rows: np.ndarray, first: bool) -> list[tuple]:
    """A block's index; the first block of a label in small parts before, so that thresholds rise early."""
    cuts = np.unique(np.minimum([0, *np.cumsum(FIRST_ROWS), len(ids)] if first else [0, len(ids)], len(ids)))
    return [(label, Index(ids[p:q], rows[p:q])) for p, q in zip(cuts[:-1], cuts[1:])]


def _best(a_ids: np.ndarray, a: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, indexes: list[Index], k: int):
    """The first ``k`` rows of the windows of some anchors: window, id and score."""
    windows = np.diff(first)
    bar = low.copy()  # what a row has to reach: the window's lower end, or its last row once it is full
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    for index in indexes:
        least = np.minimum.reduceat(bar, first[:-1])
        for i, j, score in threshold_join(a, least, index):
            other = a_ids[i] != index.ids[j]
            i, j, score = i[other], j[other], score[other]
            # a pair may fall into several windows of its anchor
            pair = np.repeat(np.arange(len(i)), windows[i])
            w = first[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(windows[i]) - windows[i], windows[i])
            fits = (bar[w] <= score[pair]) & (score[pair] <= high[w])
            w, pair = w[fits], pair[fits]
            if not len(w):
                continue
            w, found, score = (np.concatenate(x) for x in zip(best, (w, index.ids[j[pair]], score[pair])))
            kept = _first(k, w, score, found)
            best = w, found, score = w[kept], found[kept], score[kept]
            last = np.flatnonzero(np.diff(w, append=-1))  # of each window that has any
            full = last[np.bincount(w, minlength=len(bar))[w[last]] >= k]
            bar[w[full]] = score[full]
    return best


def _search(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of every window of every anchor, in order (``rank``).

    ``anchors`` has a row per window: id, label, vector, number in the label,
    positive_id, positive_score, and low and high, the ends of its scores (null: none).
    """
    names = ["shard", "asks", "label", "ids", "width", "matrix", "first", "low", "high", "positive_id", "positive_score"]

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                here, asks, label = (batch.column(n)[r].as_py() for n in names[:3])
                if here != shard:
                    shard, held = here, []
                ids, matrix = (np.frombuffer(batch.column(n)[r].as_buffer(), kind) for n, kind in (("ids", "<i8"), ("matrix", "<i4")))
                matrix = matrix.reshape(len(ids), batch.column("width")[r].as_py())
                if not asks:
                    held += _slices(label, ids, matrix, not held or held[-1][0] != label)
                    continue
                first, low, high = (np.frombuffer(batch.column(n)[r].as_buffer(), kind) for n, kind in (("first", "<i8"), ("low", "<f8"), ("high", "<f8")))
                w, found, score = _best(ids, matrix, first, low, high, [x for y, x in held if (y == label) == same], k)
                if not len(w):
                    continue
                owner = np.repeat(np.arange(len(ids)), np.diff(first))
                nothing = pa.nulls(len(w), pa.int64())
                known = [nothing if batch.column(n)[r].as_py() is None else pa.array(np.frombuffer(batch.column(n)[r].as_buffer(), "<i8")[w])
                         for n in names[-2:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[w]]), *known, pa.array(found), pa.array(score)],
                                                 names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    window = F.struct("positive_id", "positive_score", "low", "high")
    grouped = anchors.groupBy("id", "label", "vector", "number").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    packed = _packed(_blocks(grouped, BLOCK_ANCHORS, "windows"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "found_id")
    found = _dealt(packed, blocks, same).select(*names).mapInArrow(run, FOUND)
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as a double; null if a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    number = lambda x: F.least(F.greatest(F.floor(x.cast("double") * float(scale)).cast("long"), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return F.when(fine, F.transform(vector, number))


def mine_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", *, positives: int = 5, negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, both scores.

    Scores are inner products of ``floor(scale * x)``; higher come first, ties by
    smaller id.  An anchor's positives are its first other rows of the same
    label; of each, the first rows of other labels are returned whose score is
    from ``low_percent`` to ``high_percent`` percent of the positive's.
    ``is_anchor`` is a condition on the column ``id``.

    Rows with a null id, label or vector, or with a component that is null or not
    finite, take no part.  Of rows that share an id, the least by label and
    vector takes part.  Short vectors are filled up with zeros; components beyond
    2**24 after scaling count as 2**24.  Other columns are ignored; an empty
    table, a label without other rows and a window without rows give no rows.
    """
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), quantised(F.col(vector_col), scale).alias("vector"))
    x = x.where("id is not null and label is not null and vector is not null")
    x = x.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_r")).select("id", "_r.label", "_r.vector")
    x = row_number_by(written(x, "vectors"), ["label"], ["id"], "number")
    blocks = _packed(_blocks(x, BLOCK_ROWS))
    nothing = F.lit(None).cast("long")
    asking = row_number_by(x.where(is_anchor).drop("number"), ["label"], ["id"], "number")
    no_end = F.lit(None).cast("double")
    anchors = asking.select("*", nothing.alias("positive_id"), nothing.alias("positive_score"), no_end.alias("low"), no_end.alias("high"))
    near = written(_search(anchors, blocks, positives, True), "positives")
    near = near.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole scores between both ends; a negative score of the positive leaves none
    low_end = F.ceil(F.col("positive_score") * low_percent / F.lit(100).cast("decimal(3,0)"))
    high_end = F.floor(F.col("positive_score") * high_percent / F.lit(100).cast("decimal(3,0)"))
    wanted = near.select("*", low_end.cast("double").alias("low"), high_end.cast("double").alias("high")).where("low <= high")
    wanted = wanted.join(asking.withColumnRenamed("id", "anchor_id"), "anchor_id").select(
        F.col("anchor_id").alias("id"), "label", "vector", "number", "positive_id", "positive_score", "low", "high")
    return written(_search(wanted, blocks, negatives, False), "found").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
