"""Secret scan: fixed patterns, and Markov models of characters, in SQL functions only.

Spans of the three pattern kinds are found first.  Their values are the
labelled samples of random strings; the whole texts of all documents, counted
word by word, are those of ordinary ones.  Two first-order Markov chains over
characters give each transition of a further token a log-likelihood ratio
(random against ordinary).  A token's score is that of its best stretch, so an
ordinary prefix does not thin out a random string behind it; tokens whose score
reaches a threshold, calibrated by length on all tokens, are spans of kind
``random``.  Letters and digits are symbols of their own and every other
character is one boundary symbol: a path, slug or snake-case name then reads
like the words between blanks that it is made of, a ruler like white space.

Positions come from the lengths between and of all matches, added up in order,
so a text is searched twice per kind that it may hold, whatever its length.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.frames import written

#: The kinds in order, their patterns, and the least length of what must be long enough.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Alphabet of the models; any other character is symbol 0, the boundary.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYMBOLS = len(ALPHABET) + 1
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"


def _kind(kind: str, group: int, pattern: str, possible: Column) -> Column:
    """Matches of one kind: lengths of the gaps before and behind them, whole matches, values."""
    text = F.col("text")
    quoted = F.lit(pattern)
    none = F.array().cast("array<string>")
    when = lambda x: F.when(possible, x).otherwise(none)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"),
                    F.transform(when(F.split(text, pattern, -1)), F.length).alias("gaps"),
                    F.transform(when(F.regexp_extract_all(text, quoted, F.lit(0))), F.length).alias("lengths"),
                    when(F.regexp_extract_all(text, quoted, F.lit(group))).alias("values"))


def _matches(docs: DataFrame, id_col: str, text_col: str, token_length: int) -> DataFrame:
    """Per document and kind with matches: ``row, id, kind, gaps, lengths, values``; kind 0 always."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, text = F.lower("text"), F.col("text")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    found = F.array(_kind("assign", 2, ASSIGN, named), _kind("access", 0, ACCESS, text.contains("AKIA")),
                    _kind("hex", 0, HEX, text.rlike(HEX)),
                    _kind("random", 0, TOKEN % token_length, text.rlike(TOKEN % token_length)))
    return texts.select("row", "id", F.explode(found).alias("m")).select("row", "id", "m.*").where(
        "kind = 0 or size(values) > 0")


def _spans(matches: DataFrame) -> DataFrame:
    """``row, kind, start, stop, value``; positions in code points, stop exclusive."""
    each = matches.select("row", "kind", F.posexplode(F.arrays_zip("gaps", "lengths", "values")).alias("k", "m")).where(
        "m.lengths is not null").select("row", "kind", "k", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("stop", F.sum(F.col("gaps") + F.col("lengths")).over(order)).select(
        "row", "kind", (F.col("stop") - F.col("lengths")).alias("start"), "stop", F.col("values").alias("value"))


def _symbols(value: str | Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(values: DataFrame) -> DataFrame:
    """Counts ``step, n`` of the transitions of the strings in ``value``, with a boundary at both ends.

    All words lie between boundaries, so the transitions of each different word
    are counted once, times the number of the word; what remains of a string's
    transitions lies between two boundaries.
    """
    words = F.filter(F.split("value", "[^A-Za-z0-9]+"), lambda w: w != "")
    s = values.select((F.length("value") + 1).cast("long").alias("all"), words.alias("words"))
    rest = F.col("all") - F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 1)
    one = lambda w, n: F.struct(w.alias("word"), n.alias("n"))
    # the empty word between two boundaries is their one transition
    each = s.select(F.inline(F.concat(F.transform("words", lambda w: one(w, F.lit(1).cast("long"))), F.array(one(F.lit(""), rest)))))
    each = each.groupBy("word").agg(F.sum("n").alias("n"))
    each = each.select("n", _symbols(F.concat(F.lit(" "), "word", F.lit(" "))).alias("s"))
    steps = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: a * _SYMBOLS + b)
    return each.select(F.explode(steps).alias("step"), "n").where("step is not null and n > 0").groupBy("step").agg(F.sum("n").alias("n"))


def _counts(samples: DataFrame) -> np.ndarray:
    n = np.zeros(_SYMBOLS * _SYMBOLS)
    for r in _steps(samples).collect():
        n[r["step"]] = r["n"]
    return n.reshape(_SYMBOLS, _SYMBOLS)


def log_ratios(random: DataFrame, ordinary: DataFrame, discount: float = 2.0, uniform: float = 0.5, unseen: float = 0.3,
               switch: float = 0.2) -> list[float]:
    """Log-likelihood ratio of every transition; inputs hold the samples in ``value``.

    Ordinary strings are written in capitals, too: each of their transitions
    counts again with its letters in upper case.  A share ``unseen`` of them are
    of words that the samples do not show (names, other languages, code): these
    change between boundary, capital, small letter and digit as the samples do,
    or with a share of ``switch`` at will, and take the symbol by its frequency
    and evenly, half and half.  Each count of the others gives up ``discount`` to
    that fallback, so what a few random strings among the samples show does not
    become ordinary.  Random transitions are mixed with a share of ``uniform``
    equal chances, since samples of few kinds (such as hexadecimal digits) do not
    show all random strings.  The driver gets at most one count per transition
    and class.
    """
    r, o = _counts(random), _counts(ordinary)
    capital = np.array([0] + [ALPHABET.index(c.upper()) + 1 for c in ALPHABET])
    capitals = np.zeros_like(o)
    np.add.at(capitals, (capital[:, None], capital[None, :]), o)
    o = o + capitals
    seen = (1 - unseen) * np.maximum(o - discount, 0) / np.maximum(o.sum(axis=1, keepdims=True), 1)
    kind = np.array([0] + [1 if c.isupper() else 2 if c.islower() else 3 for c in ALPHABET])
    kinds = np.zeros((4, 4))
    np.add.at(kinds, (kind[:, None], kind[None, :]), o)
    kinds = (1 - switch) * (kinds + 0.25) / (kinds.sum(axis=1, keepdims=True) + 1) + switch / 4
    within = np.array([[0.5 * (o.sum(axis=0)[b] + 1) / (o.sum(axis=0)[kind == kind[b]] + 1).sum() + 0.5 / (kind == kind[b]).sum()
                        for b in range(_SYMBOLS)]])
    p_o = seen + (1 - seen.sum(axis=1, keepdims=True)) * kinds[kind][:, kind] * within
    p_r = (1 - uniform) * (r + 0.5) / (r.sum(axis=1, keepdims=True) + 0.5 * _SYMBOLS) + uniform / _SYMBOLS
    return np.log(p_r / p_o).ravel().tolist()


def best_stretch(value: str, ratios: list[float]) -> Column:
    """The greatest sum of ratios over consecutive transitions of a token, 0 at least; the first leaves a boundary."""
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in ratios) + ")")
    zero = F.lit(0.0)
    first = F.struct(F.lit(0).alias("at"), zero.alias("sum"), zero.alias("best"))
    step = lambda a, x: F.struct(x.alias("at"), F.greatest(
        zero, a["sum"] + F.get(table, a["at"] * _SYMBOLS + x)).alias("sum"), F.greatest(a["best"], a["sum"]).alias("best"))
    return F.aggregate(_symbols(value), first, step, lambda a: F.greatest(a["best"], a["sum"]))


#: Cells per unit of the logarithm, in which the scores beyond the threshold's bound are counted.
CELLS = 10_000


def threshold(tokens: DataFrame, rate: float, measured: float = 0.9, least: int = 100) -> float:
    """What a token's score must have beyond the logarithm of its length, from ordinary tokens with ``score``.

    By chance alone a stretch of a token of n characters reaches a log ratio x
    with a chance of at most n / e^x.  The ``measured`` quantile of score - ln n
    corrects this for the fitted model; from there the tail is taken to fall
    like e^-x down to ``rate``, so some random strings among the tokens move it
    little.  With fewer than ``least`` tokens the bound itself holds.

    The quantile is that of all tokens, whatever their number: they are counted
    in cells of a ten-thousandth of their value, of which the driver gets those
    above the bound, some ten thousands at most.
    """
    bound = -float(np.log(1 - measured))
    beyond = F.col("score") - F.log(F.length("value"))
    cell = F.when(beyond > bound, F.ceil(F.log(beyond) * CELLS))  # null up to the bound
    cells = sorted(((-1 << 62 if r["cell"] is None else r["cell"]), r["n"])
                   for r in tokens.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, above = sum(n for _, n in cells), bound
    if total >= least:
        below = 0
        for c, n in cells:
            below += n
            if below >= measured * total:
                above = bound if c == -1 << 62 else float(np.exp(c / CELLS))
                break
    return float(max(bound, above) + np.log((1 - measured) / rate))


def _plain(text_col: str) -> Column:
    """The text with a blank in the place of every pattern match; patterns are looked for where they may be."""
    text = F.col(text_col)
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    for pattern, possible in ((ASSIGN, named), (ACCESS, text.contains("AKIA")), (HEX, text.rlike(HEX))):
        text = F.when(possible, F.regexp_replace(text, pattern, " ")).otherwise(text)
    return text


def fit(docs: DataFrame, base: DataFrame, tokens: DataFrame, text_col: str, false_rate: float) -> tuple[list[float], float]:
    """Ratios and threshold, from the values of all pattern spans, all texts and all ``tokens`` that overlap none."""
    ratios = log_ratios(base, docs.select(_plain(text_col).alias("value")).where("value is not null"))
    return ratios, threshold(tokens.withColumn("score", best_stretch("value", ratios)), false_rate)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, token_length: int = 12,
                 false_rate: float = 1e-5) -> DataFrame:
    """One row per row of ``docs``: id, spans (array of start, kind, stop, in that order).

    Pattern spans are those of the leftmost matches that do not overlap within
    a kind and are long enough; ``random`` spans are whole runs of at least
    ``token_length`` characters ``[A-Za-z0-9+/_=-]`` that overlap no pattern
    span and whose best stretch reaches the threshold for their length, set for
    ``false_rate`` marked runs per ordinary one.  The ordinary class is learnt
    from the whole texts of all documents without their pattern matches, and the
    threshold from all runs that overlap no pattern span.  Null
    texts are empty; repeated rows and null ids are scanned like any other;
    texts and runs may be of any length; other columns are ignored; an empty
    table gives no rows.
    """
    found = written(_matches(docs, id_col, text_col, token_length), "matches")
    spans = written(_spans(found), "spans")
    enough = F.lit(False)
    for kind, least in LEAST.items():
        enough |= (F.col("kind") == KINDS.index(kind)) & (F.length("value") >= least)
    base = spans.where(enough)
    random = F.col("kind") == KINDS.index("random")
    everything = base.withColumn("base", F.lit(True)).unionByName(
        spans.where(random).withColumn("base", F.lit(False)))
    inside = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(inside.rowsBetween(0, Window.unboundedFollowing))
    free = written(everything.withColumns({"before": before, "after": after}).where(
        "base or (coalesce(before, 0) <= start and coalesce(after, stop) >= stop)").drop("before", "after"), "free")
    tokens = free.where("not base")
    ratios, beyond = fit(docs, base, tokens, text_col, false_rate)
    marked = tokens.where(best_stretch("value", ratios) >= F.log(F.length("value")) + beyond)
    kept = free.where("base").unionByName(marked)
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), "kind", F.col("stop").cast("long").alias("stop")))).alias("spans"))
    return (found.where("kind = 0").select("row", "id").join(lists, "row", "left")
            .select(F.col("id").alias(id_col), F.coalesce(
                "spans", F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)")).alias("spans")))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by ``mask``.

    The text is cut at each span's place behind what is already replaced.
    """
    step = lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).alias("out"),
        s["stop"].alias("at")))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, first, step, lambda a: F.concat(
        a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
