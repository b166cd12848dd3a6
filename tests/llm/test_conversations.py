"""Repair of conversations against a plain dynamic programme over whole audits."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from lotline.llm import conversations as c
from lotline.llm import queries

SOLID = re.compile(r"[^\x20\x09-\x0D]")
INITIALS = {"u": "user", "a": "assistant"}
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def _damaged(rows):
    """Rows ``(conv, turn, role, text)`` with the contract's damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def _plain(turns):
    """Report of one conversation, by comparing whole audits."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in turns:
        solid = SOLID.findall(text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(turns)

    @lru_cache(None)
    def best(i, state, inserted=0):
        found = [(0, "", ())] if i == n and state in (0, 3) else []
        if i < n:
            role, fault = turns[i][1], faults[i]
            cost, audit, out = best(i + 1, state)
            found.append((cost + 4, "D" + audit, out))
            if fault not in ("b", "d"):
                extra = 3 if fault == "t" else 0
                for initial, letter, paid, name in [(role[:1], "K", 0, role), ("u", "R", 3, "user"), ("a", "R", 3, "assistant")]:
                    if (state, initial) in MOVES:
                        cost, audit, out = best(i + 1, MOVES[state, initial])
                        found.append((cost + extra + paid, letter + audit, ((name, turns[i][2]), *out)))
        if inserted < 3:
            for initial in "ua":
                if (state, initial) in MOVES:
                    cost, audit, out = best(i, MOVES[state, initial], inserted + 1)
                    found.append((cost + 3, "I" + audit, ((INITIALS[initial], ""), *out)))
        return min(found, default=(10 ** 9, "", ()))

    cost, audit, out = best(0, 0)
    numbers = [t for t, _, _ in turns if t is not None]
    return {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def _table(seed, conversations=150, longest=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant"] * 6 + ["system", "tool", "User", "", None, "syslog", "agent"]
    texts = ["Good.", "Why?", "no stop", " \t\n", "", None, "Yes! \r\n", "é.", "a\nb.", "字", "."]
    rows = []
    for conv in range(conversations):
        for k in range(rnd.randint(0, longest)):
            turn = rnd.choice([k, k, k, k, 2 * k, None, 3])
            rows.append((conv, turn, rnd.choice(roles), rnd.choice(texts) if rnd.random() < .7 else f"text {k}."))
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (10 ** 12, 0, "user", "long " * 60_000 + ".")]
    rows += rows[5:25]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, seg long, split string, id int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed, segment_bytes", [(1, c.SEGMENT_BYTES), (2, 600), (3, 1)])
def test_reports_match_brute_force(spark, seed, segment_bytes, monkeypatch):
    monkeypatch.setattr(c, "FAN", 2)
    rows = _table(seed, 60 if segment_bytes == 1 else 150)
    want = {k: _plain(t) for k, t in _damaged(rows).items() if t}
    repaired = c.repair_conversations(c.damage(_frame(spark, rows)), segment_bytes=segment_bytes)
    got = {r["conv_id"]: {k: r[k] for k in r.__fields__ if k != "conv_id"} for r in c.report(repaired).collect()}
    assert got == want
    assert {r["split"] for r in repaired.select("split").distinct().collect()} == ({False} if segment_bytes > 1000 else {False, True})


def test_least_audit_of_equal_costs():
    def audit(*turns):
        done = c.derive(turns, [0, None, None, 0], True)
        return done[0, 0][1], c.path(turns, done, 0)[0]

    assert audit(("u", 0), ("a", 0)) == (0, "KK")
    assert audit(("u", 0)) == (3, "KI")
    assert audit(("a", 0)) == (3, "IK")
    assert audit(("s", 0)) == (4, "D")
    assert audit(("u", 0), ("u", 0), ("a", 0)) == (3, "KIKK")
    assert audit(("u", 1), ("u", 0), ("a", 3)) == (7, "DKK")
    assert audit() == (0, "")


def test_long_conversation_in_many_segments(spark):
    rnd = random.Random(7)
    rows = [(1, k, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "no", f"t{k}.", f"{k}"])) for k in range(3000)]
    rows += [(2, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(400)]
    one = {r["conv_id"]: r for r in c.report(c.repair_conversations(_frame(spark, rows))).collect()}
    many = c.repair_conversations(_frame(spark, rows), segment_bytes=5000)
    assert many.where("conv_id = 1").count() > 100
    assert {r["conv_id"]: r for r in c.report(many).collect()} == one
    assert one[2]["cost"] == 0 and one[2]["audit"] == "K" * 400


def test_empty_table(spark):
    assert c.report(c.repair_conversations(_frame(spark, []))).collect() == []


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    empty = _plain([])
    want = {k: _plain(t) if t else empty for k, t in _damaged(rows).items()}
    got = {r["conv_id"]: {k: r[k] for k in empty} for r in queries.op13_conversation_agenda(spark, sf_dir).collect()}
    assert got == want
    assert any("I" in w["audit"] for w in want.values()) and any("D" in w["audit"] for w in want.values())
