"""Benchmark decontamination by a prefix-filtered set join, in SQL functions only.

A window is ``window`` consecutive words of a benchmark item (all its words,
if fewer).  As a set of word shingles it is contained in a document only if
every one of its shingles is, so by the prefix filter a single shingle of each
window, the rarest in the corpus, finds all its candidates.

1. One pass over the documents keeps the positions of shingles that occur in
   any window, and one row per document with its word count.
2. Shingle frequencies over the whole corpus order each window's shingles by
   rarity; the rarest (with its offset) is its necessary prefix.
3. Joining prefix shingles with positions gives candidates ``(document,
   start, window)``; the length and positional bounds drop those that would
   begin before or end behind the document.
4. A candidate is verified exactly: the shingle at every offset of the window
   must be at that offset of the document.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.frames import written

WINDOW, SHINGLE = 10, 3
#: Distinct shingles of the benchmark are broadcast up to this number, else joined by a shuffle.
BROADCAST_SHINGLES = 500_000
#: What separates words once A-Z are lowered: all ASCII but digits and letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, with A-Z alone lowered; null has none."""
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(plain, _BETWEEN), ""), F.array().cast("array<string>"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows as ``(w, words, items)``; w numbers them by a digest of their words."""
    spans = items.where(F.size("words") > 0).select("item", F.explode(F.expr(
        f"transform(sequence(1, greatest(1, size(words) - {window - 1})), i -> slice(words, i, {window}))")).alias("words"))
    return spans.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.sha2(F.array_join("words", " "), 256).alias("w"), "words", "items")


def _grams(array: str, k: int) -> str:
    """SQL: the ``k``-word shingles of an array column, in order."""
    parts = ", ".join(f"{array}[i + {j}]" for j in range(k))
    return f"transform(sequence(0, size({array}) - {k}), i -> concat_ws(' ', {parts}))"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted array of strings).

    Words are runs of digits, letters a-z and bytes above ASCII after A-Z are
    lowered.  ``n_hit`` counts the words inside any occurrence of a window of
    the benchmark, ``items`` has the ids of items with such a window.  Null and
    empty texts have no words; an item without words or id counts for nothing;
    repeated rows, and rows with a null id, are counted each by itself; other
    columns are ignored.  An empty benchmark hits nothing.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("words"))
    windows = written(_windows(items, window), "windows")
    # windows shorter than a shingle are one shingle of their own length
    sizes = sorted({r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()})
    parts = [windows.where((F.size("words") >= k) if k == shingle else (F.size("words") == k)).select(
        "w", F.posexplode(F.expr(_grams("words", k))).alias("at", "gram")) for k in sizes]
    empty = windows.select("w", F.lit(0).alias("at"), F.lit("").alias("gram")).where("false")
    grams = empty
    for p in parts:
        grams = grams.unionByName(p)
    grams = written(grams, "window_shingles")
    small = grams.count() <= BROADCAST_SHINGLES
    bounded = F.broadcast if small else (lambda x: x)
    known = bounded(grams.select("gram").distinct().withColumn("known", F.lit(True)))

    # a row of its own for each input row, so that repeated ids stay apart
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")).select(
        F.monotonically_increasing_id().alias("row"), "id", F.size("words").alias("n_words"), "words")
    shingles = [f"case when size(words) >= {k} then {_grams('words', k)} else array() end" for k in sizes]
    placed = texts.select("row", "id", "n_words", F.posexplode_outer(F.expr(
        f"arrays_zip({', '.join(shingles)})" if len(sizes) > 1 else (shingles[0] if sizes else "array('')"))).alias("at", "g"))
    if len(sizes) > 1:
        placed = placed.select("row", "id", "n_words", "at", F.explode_outer(F.array("g.*")).alias("gram"))
    else:
        placed = placed.withColumnRenamed("g", "gram")
    # every document keeps its first position, and so its row, even if nothing matches there
    seen = placed.join(known, "gram", "left").where("known or coalesce(at, 0) = 0").select(
        "row", "id", "n_words", "at", F.when(F.col("known"), F.col("gram")).alias("gram"))
    seen = written(seen, "positions")
    hits = seen.where("gram is not null").select("row", "n_words", "at", "gram")

    rarity = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    prefix = (grams.join(rarity, "gram").join(windows.select("w", F.size("words").alias("len")), "w")
              .groupBy("w", "len").agg(F.min(F.struct("df", "at", "gram")).alias("p"),
                                       F.collect_list(F.struct("at", "gram")).alias("all"))
              # a shingle that the corpus lacks excludes its window
              .where(F.size("all") == F.greatest(F.lit(1), F.col("len") - (shingle - 1)))
              .select("w", "len", F.col("p.at").alias("offset"), F.col("p.gram").alias("gram")))
    prefix = written(prefix, "prefixes")
    candidates = (hits.join(bounded(prefix), "gram").select("row", "w", "len", (F.col("at") - F.col("offset")).alias("start"), "n_words")
                  .where("start >= 0 and start + len <= n_words").select("row", "w", "len", "start"))
    # verify: as many shingles of the window at their places as it has
    expected = grams.join(prefix.select("w"), "w", "left_semi").withColumnRenamed("at", "offset")
    wanted = candidates.join(bounded(expected), "w").select("row", "w", "len", "start", (F.col("start") + F.col("offset")).alias("at"), "gram")
    met = (wanted.join(hits.select("row", "at", "gram"), ["row", "at", "gram"])
           .groupBy("row", "w", "start", "len").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") == F.greatest(F.lit(1), F.col("len") - (shingle - 1))))
    found = written(met.select("row", "w", "start", "len"), "occurrences")

    # words covered by a union of intervals: each adds what lies behind the furthest end so far
    covered = F.expr("""aggregate(array_sort(collect_set(struct(start, start + len as stop))),
        named_struct('reach', 0, 'n', 0L),
        (a, x) -> named_struct('reach', greatest(a.reach, x.stop),
                               'n', a.n + greatest(0, x.stop - greatest(a.reach, x.start))), a -> a.n)""")
    counts = found.groupBy("row").agg(covered.alias("n_hit"))
    which = (found.select("row", "w").distinct().join(windows.select("w", F.explode("items").alias("item")), "w")
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    rows = seen.where("coalesce(at, 0) = 0").groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"))
    return (rows.join(counts, "row", "left").join(which, "row", "left")
            .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
