"""Models that must be fitted on all rows."""
import itertools
import random
from collections import Counter

from lotline.llm import secrets


def test_transitions_are_those_of_every_character(spark):
    texts = ["", "a", " ab  Ab9", "é", "x--", "ab ab", "aé\n\nb", "0" * 50 + "."]
    symbol = {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}
    want = Counter()
    for t in texts:
        s = [0, *[symbol.get(c, 0) for c in t], 0]
        want.update(a * (len(symbol) + 1) + b for a, b in itertools.pairwise(s))
    got = secrets._steps(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r.step: r.n for r in got.collect()} == dict(want)


def test_secrets_are_learnt_from_every_text(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k, f"word{k} some-compound-name-{k} password={'Q7' * 5}") for k in range(150)] + [(1000, None), (None, "a-long-token-again")]
    seen = {}
    ratios, threshold = secrets.log_ratios, secrets.threshold
    monkeypatch.setattr(secrets, "log_ratios", lambda r, o, *a: (seen.update(texts=o.count(), base=r.count()), ratios(r, o, *a))[1])
    monkeypatch.setattr(secrets, "threshold", lambda t, *a: (seen.update(tokens=t.count()), threshold(t, *a))[1])
    rnd.shuffle(rows)
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert got == 152 and seen == {"texts": 151, "base": 150, "tokens": 151}


def test_threshold_is_the_quantile_of_all_tokens(spark):
    scores = [0.5 * k for k in range(400)]
    tokens = spark.createDataFrame([("e", x) for x in scores], "value string, score double")
    got = secrets.threshold(tokens, 1e-5) - 9.210340371976184  # ln (0.1 / 1e-5)
    assert abs(got - scores[359]) < 0.001 * got
