"""Repair of conversations by Knuth's lightest derivations.

The turns of a conversation are edited until the initials of their roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant by turns.  The
edits are deductions over items ``(place, state)``, "the turns from this place
on can be repaired when the ones before left this state".  A turn joins an item
behind it by Keep, Rerole or Delete; Insert stands by itself.  Items are popped
from an agenda by weight; a weight is (cost, turns used, letter of the edit),
which every deduction raises, so an item is final when it is first popped and
popping stops at the goal.  Of equally cheap repairs the one whose letters
(Delete, Insert, Keep, Rerole) come first in ASCII wins: from one item a letter
leads to one other item only, so comparing first letters compares the whole.

Turns are numbered without a task per conversation, and a conversation is cut
into segments of bounded size.  One that has a single segment is repaired in one
go.  A longer one meets three passes over its segments: the costs from every
state to every state; the cheapest way on from the end of each segment, by a
tree of bounded groups over those 4 x 4 costs; the state at the end of each
segment for every state at its start, put together by a tree, too.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.frames import running_by_group, written

SEGMENT_BYTES, TURN_BYTES = 1 << 20, 256
#: Members of a group in the trees over segments.
FAN = 512
#: Conversations of several segments are broadcast up to this number, else joined by a shuffle.
BROADCAST_SPLIT = 1_000_000
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3
LETTERS = "DIKR"
#: States: nothing yet, system, user, assistant; where a role leads, and from where it comes.
START, FINAL = 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
BACK = {0: (), 1: ((0, "s"),), 2: ((0, "u"), (1, "u"), (3, "u")), 3: ((2, "a"),)}
NEXT = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
ROLES = {"u": "user", "a": "assistant"}
#: Cost of what has to be inserted behind the last turn.
TAIL = [0, 2 * INSERT_COST, INSERT_COST, 0]
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: Cost of what cannot be.
NEVER = 1 << 50
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
          "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}

Turns = Sequence[tuple[str, int]]


def derive(turns: Turns, ends: Sequence[int | None], last: bool, goals: Iterable[int] = (START,)) -> dict:
    """Letter of the first edit and cost of every item that is final when all ``goals`` are.

    ``turns`` are role initials and faults.  ``ends`` is the cost of going on
    from each state behind the last turn (None: impossible); ``last`` allows
    insertions there.  Items are ``(place, state)``; an axiom has no letter.
    """
    n = len(turns)
    wide = n + 1
    # a weight in one number: cost, turns used, letter (0 for an axiom), state
    agenda = [(cost * wide * 5) * 4 + state for state, cost in enumerate(ends) if cost is not None]
    agenda.sort()
    done, wanted = {}, {(0, g) for g in goals}
    while agenda and wanted:
        rest, state = divmod(heappop(agenda), 4)
        rest, letter = divmod(rest, 5)
        cost, used = divmod(rest, wide)
        place = n - used
        if (place, state) in done:
            continue
        done[place, state] = (letter, cost)
        wanted.discard((place, state))
        if place < n or last:
            for before, role in BACK[state]:
                if role != "s":
                    heappush(agenda, (((cost + INSERT_COST) * wide + used) * 5 + 2) * 4 + before)
        if place:
            initial, fault = turns[place - 1]
            heappush(agenda, (((cost + DELETE_COST) * wide + used + 1) * 5 + 1) * 4 + state)
            if fault in (NONE, TRUNCATED):
                paid = cost + TRUNCATED_COST * (fault == TRUNCATED)
                for before, role in BACK[state]:
                    if role == initial:
                        heappush(agenda, ((paid * wide + used + 1) * 5 + 3) * 4 + before)
                    if role != "s":
                        heappush(agenda, (((paid + REROLE_COST) * wide + used + 1) * 5 + 4) * 4 + before)
    return done


def path(turns: Turns, done: dict, state: int) -> tuple[str, list[int], int]:
    """Audit of the lightest derivation from ``(0, state)``, the state behind each edit, and the last one."""
    place, audit, states = 0, [], []
    while letter := done[place, state][0]:
        if letter == 1:
            place += 1
        elif letter == 3:
            state, place = STEP[state, turns[place][0]], place + 1
        else:
            state, place = NEXT[state][0], place + (letter == 4)
        audit.append(LETTERS[letter - 1])
        states.append(state)
    return "".join(audit), states, state


def apply(audit: str, states: Sequence[int], roles: Sequence[str], texts: Sequence[str]) -> list[tuple[str, str]]:
    """Roles and texts of the repaired turns."""
    out, place = [], 0
    for letter, state in zip(audit, states):
        if letter == "I":
            out.append((ROLES["ua"[state - 2]], ""))
            continue
        if letter != "D":
            out.append((roles[place] if letter == "K" else ROLES["ua"[state - 2]], texts[place]))
        place += 1
    return out


def damage(rows: DataFrame) -> DataFrame:
    """Seeded damage by ``crc32('conv_id:turn') % 20``: 0 drops, 1 empties, 2 takes stops, 3 repeats, 4 turns into user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                    (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("_k")).where("_k <> 0")
    x = x.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
                 .otherwise(F.col("text")).alias("text"),
                 F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"))
    return x.select("*", F.explode("_copies")).select("conv_id", "turn", "role", "text")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _segments(rows: DataFrame, segment_bytes: int) -> DataFrame:
    """A row per segment: conv_id, seg, split, and the lists turns, roles, texts, faults in order."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                    text.alias("text"), F.sha2(text, 256).alias("_digest"), F.rtrim(text, F.lit(WHITE)).alias("_cut"))
    x = x.select("conv_id", "turn", "role", "text", "_digest", (F.col("_cut") == "").alias("_blank"),
                 (~F.col("_cut").rlike(r"[.!?]\z")).alias("_open"), (F.octet_length("text") + TURN_BYTES).cast("long").alias("_size"),
                 F.monotonically_increasing_id().alias("_row"))
    # the last order column cuts a run of equal turns into slices, too
    x = running_by_group(x, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "_digest", "_row"],
                         {"_pos": ("count", None), "_upto": ("sum", "_size")})
    key = ["conv_id", "role", "_digest"]
    first = x.where("not _blank").groupBy(*key).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    x = x.alias("x").join(first.alias("f"), _same("x", "f", key), "left")
    fault = (F.when(F.col("_blank"), BLANK).when(F.col("_pos") > F.col("_first"), DUPLICATE)
             .when(F.col("_open"), TRUNCATED).otherwise(NONE))
    seg = F.floor((F.col("_upto") - F.col("_size")) / segment_bytes).cast("long")
    item = F.struct("_pos", "turn", F.col("x.role").alias("role"), "text", fault.alias("fault"))
    x = x.groupBy(F.col("x.conv_id").alias("conv_id"), seg.alias("seg")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    part = lambda name, c: F.transform("_items", lambda s: s[c]).alias(name)
    x = written(x.select("conv_id", "seg", part("turns", "turn"), part("roles", "role"), part("texts", "text"),
                         part("faults", "fault")), "segments")
    split = written(x.where("seg > 0").select("conv_id").distinct(), "split")
    if split.count() <= BROADCAST_SPLIT:
        split = F.broadcast(split)
    return x.alias("x").join(split.withColumn("split", F.lit(True)).alias("s"), _same("x", "s", ["conv_id"]), "left").select(
        "x.*", F.coalesce("split", F.lit(False)).alias("split"))


def _per_row(df: DataFrame, inputs: Sequence[str], fields: Mapping[str, str], run: Callable) -> DataFrame:
    """``conv_id`` and the fields that ``run`` makes of the input columns of each row; few rows are held at a time."""
    kind, types = df.schema["conv_id"].dataType, [_ARROW[t] for t in fields.values()]

    def each(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [run(*row) for row in zip(*(part.column(n).to_pylist() for n in inputs))]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *map(pa.array, zip(*made), types)],
                                                 names=["conv_id", *fields])

    return df.select("conv_id", *inputs).mapInArrow(
        each, f"conv_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def _tree(leaves: DataFrame, combine: Callable[[list], list], down: Callable[[list, list], list], root: list[int]) -> DataFrame:
    """``context`` of every leaf (conv_id, seg, value): what ``down`` makes of its parent's context and its siblings' values.

    Values of up to ``FAN`` neighbours are combined into their parent's until a
    conversation has one; then contexts go down the same groups.
    """
    kind = leaves.schema["conv_id"].dataType.simpleString()
    parent = F.floor(F.col("seg") / FAN).cast("long")

    def up(found: pa.Table) -> pa.Table:
        found = found.sort_by("seg")
        return pa.table({"conv_id": found.column("conv_id")[:1], "seg": found.column("up")[:1],
                         "value": pa.array([combine(found.column("value").to_pylist())], pa.list_(pa.int64()))})

    def below(found: pa.Table) -> pa.Table:
        found = found.sort_by("seg")
        contexts = down(found.column("context")[0].as_py(), found.column("value").to_pylist())
        return pa.table({"conv_id": found.column("conv_id"), "seg": found.column("seg"),
                         "context": pa.array(contexts, pa.list_(pa.int64()))})

    levels = [leaves]
    while levels[-1].agg(F.max("seg")).first()[0] > 0:
        grouped = levels[-1].withColumn("up", parent).groupBy("conv_id", "up")
        levels.append(written(grouped.applyInArrow(up, f"conv_id {kind}, seg long, value array<bigint>"), "tree"))
    found = levels.pop().select("conv_id", "seg", F.array(*[F.lit(x).cast("long") for x in root]).alias("context"))
    while levels:
        child = levels.pop().withColumn("up", parent)
        both = child.alias("c").join(found.withColumnRenamed("seg", "up").alias("p"), _same("c", "p", ["conv_id", "up"])).select("c.*", "context")
        found = written(both.groupBy("conv_id", "up").applyInArrow(below, f"conv_id {kind}, seg long, context array<bigint>"), "tree")
    return found


def _costs_combined(values: list[list[int]]) -> list[int]:
    """The costs from state to state over several neighbours, as 16 numbers."""
    return reduce(lambda a, b: [min(NEVER, *(a[4 * i + k] + b[4 * k + j] for k in range(4)))
                                for i in range(4) for j in range(4)], values)


def _costs_down(context: list[int], values: list[list[int]]) -> list[list[int]]:
    """Cost of going on behind each neighbour, given that behind the last."""
    out = []
    for value in reversed(values):
        out.append(context)
        context = [min(NEVER, *(value[4 * i + k] + context[k] for k in range(4))) for i in range(4)]
    return out[::-1]


def _exits_down(context: list[int], values: list[list[int]]) -> list[list[int]]:
    """State before each neighbour, given that before the first."""
    out = []
    for value in values:
        out.append(context)
        context = [value[context[0]]]
    return out


def _plan(many: DataFrame) -> DataFrame:
    """For the segments (conv_id, seg, initials, faults, last) of long conversations: ``ends`` and the state ``entry``."""
    def matrix(seg, initials, faults):
        turns, out = list(zip(initials, faults)), [[NEVER] * 4 for _ in range(4)]
        for end in range(4):
            done = derive(turns, [0 if e == end else None for e in range(4)], False, range(4))
            for state in range(4):
                if (0, state) in done:
                    out[state][end] = done[0, state][1]
        return seg, [x for row in out for x in row]

    def exits(seg, initials, faults, last, ends):
        turns = list(zip(initials, faults))
        done = derive(turns, _ends(ends, last), last, range(4))
        return seg, [path(turns, done, q)[2] if (0, q) in done else 0 for q in range(4)]

    fields = {"seg": "long", "value": "array<bigint>"}
    costs = written(_per_row(many, ["seg", "initials", "faults"], fields, matrix), "costs")
    ends = _tree(costs, _costs_combined, _costs_down, TAIL).withColumnRenamed("context", "ends")
    many = written(many.alias("m").join(ends.alias("e"), _same("m", "e", ["conv_id", "seg"])).select("m.*", "ends"), "ends")
    states = written(_per_row(many, ["seg", "initials", "faults", "last", "ends"], fields, exits), "exits")
    entry = _tree(states, lambda values: reduce(lambda a, b: [b[x] for x in a], values), _exits_down, [START])
    return many.alias("m").join(entry.alias("e"), _same("m", "e", ["conv_id", "seg"])).select(
        "m.conv_id", "m.seg", "last", "ends", F.col("context")[0].alias("entry"))


def _ends(ends: list[int], last: bool) -> list[int | None]:
    return [0 if q in FINAL else None for q in range(4)] if last else [x if x < NEVER else None for x in ends]


def _solve(seg, split, turns, roles, texts, faults, last, ends, entry):
    found = [(r[:1], f) for r, f in zip(roles, faults)]
    ends = _ends(ends, last)
    done = derive(found, ends, last, [entry])
    audit, states, state = path(found, done, entry)
    numbers = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return (seg, split, min(numbers, default=None), max(numbers, default=None), len(set(numbers)),
            numbers[0] if numbers else None, numbers[-1] if numbers else None,
            faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1],
            done[0, entry][1] - (0 if last else ends[state]), audit,
            [{"role": r, "text": t} for r, t in apply(audit, states, roles, texts)])


FIELDS = {"seg": "long", "split": "boolean", "turn_min": "long", "turn_max": "long", "turn_distinct": "long",
          "turn_first": "long", "turn_last": "long", "blank": "long", "duplicate": "long", "truncated": "long",
          "illegal": "long", "first_initial": "string", "last_initial": "string", "cost": "long", "audit": "string",
          "repaired": "array<struct<role:string,text:string>>"}


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The repaired conversations, a row per segment (see ``FIELDS``), as a written table.

    ``repaired`` holds the turns that remain, and ``audit`` the initials of the
    edits; the segments of a conversation, by ``seg``, follow one another.  Turns
    are taken by turn, nulls first, and within a turn by role and a hash of the
    text.  A null role or text is one space, a null id an id like any other; the
    role of an empty string has no initial and must be changed.  Rows that are
    equal are duplicates of the first.  Texts may be of any length and a
    conversation of any number of turns; other columns are ignored; an empty
    table gives no rows.  Turns are integers.
    """
    x = _segments(rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                              F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")), segment_bytes)
    tail = F.array(*[F.lit(c).cast("long") for c in TAIL])
    whole = x.where("not split").select("*", F.lit(True).alias("last"), tail.alias("ends"), F.lit(START).cast("long").alias("entry"))
    many = x.where("split").select("conv_id", "seg", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults")
    final = many.groupBy("conv_id").agg(F.max("seg").alias("_last"))
    many = written(many.alias("m").join(final.alias("f"), _same("m", "f", ["conv_id"])).select(
        "m.*", (F.col("seg") == F.col("_last")).alias("last")), "many")
    if many.head(1):
        plan = _plan(many)
        rest = x.where("split").alias("x").join(plan.alias("p"), _same("x", "p", ["conv_id", "seg"])).select("x.*", "last", "ends", "entry")
        whole = whole.unionByName(rest)
    return written(_per_row(whole, ["seg", "split", "turns", "roles", "texts", "faults", "last", "ends", "entry"], FIELDS, _solve), "repaired")


def report(repaired: DataFrame) -> DataFrame:
    """One row per repaired conversation: its faults, cost and audit, and the SHA-256 of its ``role:text`` lines.

    A conversation of one segment is digested where it is.  A digest goes over
    its lines in order, so those of a longer one pass through one task, a
    segment at a time.
    """
    line = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    x = repaired.select("*", line.alias("lines"), F.size("repaired").alias("n_lines"))
    one = x.where("not split").select(
        "conv_id", F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("turn_distinct"), F.lit(0)).cast("long").alias("gaps"),
        *counts, "audit", F.sha2("lines", 256).alias("repaired_sha256"))

    def fold(batches):
        rows, types, state = [], None, None

        def close():
            low, high, distinct = state["turn_min"], state["turn_max"], state["turn_distinct"]
            return (state["conv_id"], 0 if low is None else high - low + 1 - distinct, *(state[c] for c in counts),
                    "".join(state["audit"]), state["digest"].hexdigest())

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if state is None or state["conv_id"] != row["conv_id"]:
                    if state is not None:
                        rows.append(close())
                    state = row | {"audit": [], "digest": hashlib.sha256(), "gap": b""}
                else:
                    for c in counts:
                        state[c] += row[c]
                    state["illegal"] += state["last_initial"] + row["first_initial"] not in LEGAL
                    if row["turn_first"] is not None:
                        state["turn_distinct"] += row["turn_distinct"] - (state["turn_last"] == row["turn_first"])
                        state["turn_min"] = row["turn_min"] if state["turn_min"] is None else state["turn_min"]
                        state["turn_max"] = state["turn_last"] = row["turn_max"]
                    state["last_initial"] = row["last_initial"]
                state["audit"].append(row["audit"])
                if row["n_lines"]:
                    state["digest"].update(state["gap"] + row["lines"].encode())
                    state["gap"] = b"\n"
        if state is not None:
            rows.append(close())
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), names=one_names)

    one_names, one_schema = one.columns, one.schema
    long = x.where("split").drop("repaired", "split").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return one.unionByName(long.mapInArrow(fold, one_schema))
