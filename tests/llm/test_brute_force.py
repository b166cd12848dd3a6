"""Operators without SQL whose models are fitted: every number again in plain Python, over whole small tables."""
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from lotline.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, id string, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "clash", "clash") for d, t, lang in rows], DOCS)


def _held(spark, ids, seed, folds=(0,)):
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    return {r.id: r.h for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", (part % 5).isin(*folds).alias("h")).collect()}


def _isotonic(bins):
    """Knots and levels from ``bin: (rows, positive)`` by the min-max formula."""
    at = sorted(bins)
    mean = lambda i, j: sum(bins[k][1] for k in at[i:j + 1]) / sum(bins[k][0] for k in at[i:j + 1])
    value = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    knots, levels = [], []
    k = 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and abs(value[j + 1] - value[k]) < 1e-12:
            j += 1
        n, p = (sum(bins[x][d] for x in at[k:j + 1]) for d in (0, 1))
        knots.append(sum(bins[x][0] * x for x in at[k:j + 1]) / n)
        levels.append((p + 0.5) / (n + 1))
        k = j + 1
    return knots, np.maximum.accumulate(levels)


def _statistics(text):
    raw = (text or "").encode()
    n, hist = max(len(raw), 1), Counter(raw)
    classes = [sum(hist[ord(c)] for c in s) for s in quality._CLASSES]
    classes += [sum(v for k, v in hist.items() if 0x80 <= k < 0xC0), sum(v for k, v in hist.items() if k >= 0xC0)]
    classes.append(len(raw) - sum(classes))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    m = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / m
    spread = math.sqrt(max(sum(x * x for x in sizes) / m - mean ** 2, 0))
    threes = list(zip(words, words[1:], words[2:]))
    entropy = -sum(v / n * math.log2(v / n) for v in hist.values())
    tail = [w[-1] for w in words]
    return [x / n for x in classes] + [
        math.log1p(len(raw)), entropy, math.log1p(len(words)), math.log1p(mean), math.log1p(spread), math.log1p(max(sizes, default=0)),
        len(set(words)) / m, len(set(threes)) / max(len(threes), 1), sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(65 <= w[0] <= 90 for w in words) / m, sum(x == 46 for x in tail) / m, sum(x < 48 and x not in (44, 46) for x in tail) / m,
        math.log1p(len(words) / (hist[10] + 1))]


def test_quality_against_one_system(spark, monkeypatch):
    """Statistics text by text, the ridge system over all rows at once, the isotonic curve by its formula."""
    rnd = random.Random(31)
    words = [f"w{k}" for k in range(300)] + ["Ünder", "Stop.", "(a)", "1987"]
    texts = [" ".join(rnd.choices(words if k % 2 else words[:20], k=rnd.randint(3, 60))) + ".!\n"[k % 3] for k in range(240)]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(900, None, None), (901, "", None), (None, texts[0], None), (902, "x" * 70_000, None)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0 or k % 7 == 0)) for k in range(240)], "doc_id long, quality int")
    kept, fit = {}, quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **o: kept.setdefault("m", fit(*a, **o)))
    got = quality.score_quality(_docs(spark, rows), labels, F.lit(True)).collect()
    model, held = kept["m"], _held(spark, range(240), 3)
    y = {k: int(k % 2 == 0 or k % 7 == 0) for k in range(240)}
    x = {k: np.float32(_statistics(texts[k])).astype(float) for k in range(240)}
    fold = np.array([x[k] for k in range(240) if not held[k]])
    assert np.allclose(model.mean, fold.mean(axis=0), atol=1e-4) and np.allclose(model.scale, fold.std(axis=0) + 1e-3, atol=1e-4)
    features = lambda v: np.append(np.cos(np.clip((v - model.mean) / model.scale, -8, 8) @ model.directions + model.phases)
                                   * math.sqrt(2 / len(model.phases)), 1.0)
    z, t = np.array([features(v) for v in fold]), np.array([y[k] for k in range(240) if not held[k]])
    penalty = np.diag([1e-4 * len(z)] * (z.shape[1] - 1) + [0.0])
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + penalty, z.T @ t), atol=1e-3)
    bins = {}
    for k in (k for k in range(240) if held[k]):
        at = min(max(int((features(x[k]) @ model.weights + 1) / 3 * 3072), 0), 3071)
        n, p = bins.get(-1 + (at + 0.5) * 3 / 3072, (0, 0))
        bins[-1 + (at + 0.5) * 3 / 3072] = (n + 1, p + y[k])
    knots, levels = _isotonic(bins)
    assert len(got) == len(rows)
    for r in got:
        text = texts[0] if r.doc_id is None else dict((k, v) for k, v, _ in rows)[r.doc_id]
        want = np.interp(features(np.float32(_statistics(text)).astype(float)) @ model.weights, knots, levels)
        assert abs(r.score - want) < 0.02 and r.predicted == (r.score >= 0.5)


def _grams(text):
    letters = ["" if c is None else c for c in (text or "")]
    letters = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in letters]
    s = " " + "".join(letters) + " "
    return [s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i:i + n].strip(" ")]


def _bucket(gram, buckets):
    h, word = len(gram), (1 << 64) - 1
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & word
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & word
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & word
    return (h ^ (h >> 31)) % buckets


def test_languages_against_counters(spark):
    """The posterior of every text from counters of its n-grams."""
    rnd = random.Random(32)
    letters = {"aa": "abcdeé ", "bb": "abcxyz ", "cc": "абвгд ", "dd": "中文字典 "}
    rows = [(k, "".join(rnd.choices(letters[x], k=rnd.randint(1, 12))), x) for k, x in enumerate(rnd.choices(sorted(letters), k=200))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "aa"), (None, "abc", None), (903, "ab " * 40_000, None), (5, "xyz", "bb")]
    buckets, learn = 512, lambda k: k is not None and k % 4 != 2
    got = langid.identify(_docs(spark, rows), F.col("doc_id") % 4 != 2, buckets=buckets).collect()
    names = sorted({x for k, _, x in rows if learn(k) and x})
    counts, docs = {x: Counter() for x in names}, Counter()
    for k, text, x in rows:
        if learn(k) and x:
            docs[x] += 1
            counts[x].update(_bucket(g, buckets) for g in _grams(text))
    total = {x: sum(counts[x].values()) + 0.5 * buckets for x in names}
    want = Counter()
    for _, text, _ in rows:
        grams = [_bucket(g, buckets) for g in _grams(text)]
        logs = [math.log((docs[x] + 1) / (sum(docs.values()) + len(names))) + sum(math.log((counts[x][b] + 0.5) / total[x]) for b in grams)
                for x in names]
        best = max(range(len(names)), key=lambda i: logs[i])
        score = 1 / sum(math.exp(v - logs[best]) for v in logs)
        want[(text, names[best] if grams else "und", round(score if grams else 0.0, 2))] += 1
    texts = {k: t for k, t, _ in rows if k != 5}
    for r in got:
        near = [(t, x, s) for t, x, s in want if (r.doc_id == 5 or t == texts[r.doc_id]) and x == r.lang_pred and abs(s - r.score) < 0.02]
        assert near, r
    assert len(got) == len(rows)


def _windows(text):
    """For each word its short parts, and the byte windows of the longer ones."""
    for w in set((text or "").lower().split()):
        w = w.strip(toxicity.TRIMMED).encode()
        parts = [w] if len(w) < 24 else re.split(rb"[!-/:-@\[-`{-~]+", w)
        cut = [p[i:i + 24] for p in parts if len(p) >= 24 for i in [*range(0, len(p) - 24, 6), len(p) - 24]]
        yield [p for p in parts if 0 < len(p) < 24], cut


def test_toxicity_against_single_windows(spark, monkeypatch):
    """Cells, ratios and scores window by window; toxic words inside runs are seen, signs learnt in runs and words learnt between blanks."""
    rnd = random.Random(33)
    signs = [chr(0x4E00 + 7 * k) for k in range(400)]
    run = lambda: "".join(rnd.choices(signs, k=60))
    word = lambda: "".join(rnd.choices("aeioutnrsl", k=6))
    texts = []
    for k in range(600):
        a, b, joint = run(), run(), " " if k < 300 else "_"
        if k % 2:  # toxic: in a run of signs, or joined to other words
            texts.append(a + "毒恶坏死" + b if k % 4 == 1 else joint.join([word(), word(), word(), "zzgrumpf", word(), word()]) + " " + word())
        else:
            texts.append(a + b if k % 4 == 0 else joint.join(word() for _ in range(6)) + " " + word())
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(900, None, None), (901, "", None), (None, texts[1], None), (902, "y" * 70_000, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    kept, fit = {}, toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **o: kept.setdefault("m", fit(*a, **o)))
    got = toxicity.score_toxicity(_docs(spark, rows), labels, F.lit(True)).collect()
    model, held, taught = kept["m"], _held(spark, range(400), 9), _held(spark, range(400), 9, (1, 2))
    press = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                      write_dict_id=False, write_checksum=False) for d in (model.toxic, model.ordinary)]

    def cells(text):
        out = set()
        for short, cut in _windows(text):
            found = {w: [len(c.compress(b" " + w + b" " + toxicity.FILLER)) for c in press] for w in short + cut}
            assert max((max(x) for x in found.values()), default=0) < 64
            out |= {((len(w) + 2) * 64 + found[w][0]) * 64 + found[w][1] for w in short}
            out |= {26 * 64 * 64 + max(0, *(found[w][1] - found[w][0] for w in cut))} if cut else set()
        return out

    cells(bytes(rnd.choices(range(33, 127), k=2400)).decode())  # no window reaches the longest length
    a, b, n = Counter(), Counter(), Counter()
    for k in range(400):
        if not held[k]:
            n[k % 2] += 1
            (a if k % 2 else b).update(c for c in cells(texts[k]) if c < 26 * 64 * 64 or not taught[k])
    ratio = {c: math.log((a[c] + 0.2) / (n[1] + 1)) - math.log((b[c] + 0.2) / (n[0] + 1)) for c in a | b}
    assert all(abs(model.ratios[c] - v) < 1e-9 for c, v in ratio.items()) and (model.ratios != 0).sum() <= len(ratio)

    def raw(text):
        top = sorted((ratio.get(c, 0.0) for c in cells(text)), reverse=True)[:2]
        return top[0] + 0.1 * max(top[1], 0) if len(top) > 1 else top[0] if top else -10.0

    bins = {}
    for k in (k for k in range(400) if held[k]):
        at = min(max(int((raw(texts[k]) + 10) / 30 * 3000), 0), 2999)
        m, p = bins.get(-10 + (at + 0.5) * 30 / 3000, (0, 0))
        bins[-10 + (at + 0.5) * 30 / 3000] = (m + 1, p + k % 2)
    knots, levels = _isotonic(bins)
    for r in got:
        text = texts[1] if r.doc_id is None else {k: t for k, t, _ in rows}[r.doc_id]
        assert abs(r.score - np.interp(raw(text), knots, levels)) < 1e-6
    by_id = {r.doc_id: r.predicted for r in got}
    right = {part: sum(by_id[k] == k % 2 for k in range(400, 600) if k % 4 in part) for part in ((0, 1), (2, 3))}
    assert right[2, 3] >= 90 and right[0, 1] >= 80, right
