"""Capacity allocation on a graph (inventory E1-E7).

Requests arrive one by one and each takes one slot at the first node of its
ranked candidate list that still has room.  With one common priority (the
request number) that sequential outcome is the unique stable matching, so it
is computed with deferred acceptance (Gale & Shapley 1962) in rounds of
joins: unplaced requests propose to their next candidate, every node keeps
its ``free`` smallest request numbers, the rest move on.  Three exact prunings
keep rounds, lists and pools small:

* requests of one start have one list, so the k-th of them begins at the rank
  of the list's k-th slot; a start with most of all requests offers a node no
  more of them at first than it has room, and drops those beyond its list;
* a node that is full with holders all smaller than ``r`` can never take
  ``r``, so ``r`` skips it at once;
* a request whose list covers its whole connected component (BFS form) is
  served iff it is among the first ``C`` requests of the component (``C`` =
  free slots of the component); its list is expanded as far as it is needed.

A round reads one block of candidates per unplaced request.  Only loop counters
reach the driver; each round is checkpointed.

BFS forms (E4, E6) need rounds only for components too large for a task: the
others are gathered whole and searched where they are (``traversal``).
"""
from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lotline import frames, graph
from lotline.operators import traversal

R_UNKNOWN_START = "unknown start"
#: Candidates that an unplaced request looks at in a round; parts of the lists that are kept apart.
BLOCK, LISTS = 16, 8
#: Rows (nodes, edges, and requests) of a component that is searched in one task; rows of a group of such components,
#: and visits from a component's starts in one group.
FITS, GROUP_ROWS, WORK = 250_000, 50_000, 2_000_000
#: BFS levels that one job expands.
LEVELS = 8
_LOG = logging.getLogger("lotline.allocate")


def _log(msg: str) -> None:
    _LOG.debug(msg)


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node upsert (last wins by SEQ), undirected edges both ways, unknown endpoints get CAP 0.

    Returns ``(nodes[NODE_ID, CAP], adj[NODE_ID, NBR, EDGE_SEQ])``.
    """
    n = nodes.groupBy("NODE_ID").agg(F.max(F.struct("SEQ", "CAP")).alias("_l")).select(
        "NODE_ID", F.col("_l.CAP").alias("CAP"))
    ends = edges.select(F.col("SRC").alias("NODE_ID")).union(edges.select(F.col("DST").alias("NODE_ID"))).distinct()
    missing = ends.join(n, "NODE_ID", "left_anti").withColumn("CAP", F.lit(0).cast(n.schema["CAP"].dataType))
    all_nodes = n.unionByName(missing)
    adj = edges.select(F.col("SRC").alias("NODE_ID"), F.col("DST").alias("NBR"), "EDGE_SEQ").unionByName(
        edges.select(F.col("DST").alias("NODE_ID"), F.col("SRC").alias("NBR"), "EDGE_SEQ"))
    # a repeated neighbour keeps its first position in the list
    adj = adj.groupBy("NODE_ID", "NBR").agg(F.min("EDGE_SEQ").alias("EDGE_SEQ"))
    return all_nodes, adj


def free_capacity(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """FREE = clamp(CAP - USED, 0, CAP); usage of unknown ids is ignored."""
    j = nodes.join(used, "NODE_ID", "left")
    u = F.coalesce(F.col("USED"), F.lit(0))
    return j.select("NODE_ID", "CAP", u.alias("USED"),
                    F.greatest(F.lit(0), F.least(F.col("CAP"), F.col("CAP") - u)).alias("FREE"))


def components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """E5: connected components, each labelled by its smallest node id (see ``graph.components``)."""
    found = graph.components(adj, "NODE_ID", "NBR").select(F.col("id").alias("NODE_ID"), F.col("component").alias("_c"))
    return frames.checkpoint(nodes.join(found, "NODE_ID", "left").select(
        "NODE_ID", F.coalesce("_c", "NODE_ID").alias("COMP")))


class Frontier:
    """BFS from many starts at once, some levels at a time and only for the starts that ask.

    ``adj`` has every edge both ways (E1), so a neighbour of a node of level L
    lies in level L-1, L or L+1: new nodes are told from the last two levels of
    a start alone.  Unseen nodes keep their first discovery ``(parent rank, edge
    order)``, and ranks continue after the nodes seen so far.  ``levels`` are the
    written parts of the visiting order: START_ID, NODE_ID, RANK (1 = the start),
    LEVEL, FREE, CUM_FREE (free capacity of ranks <= RANK).

    One job expands ``LEVELS`` levels: rows are shuffled by start once and stay
    there, so a graph of long paths costs its visits, not a round of jobs a level.
    What a task sorts of one start is a few levels, at most the nodes of the graph
    (rows that a window spills, not lists).
    """

    def __init__(self, starts: DataFrame, free: DataFrame, adj: DataFrame):
        free = free.select("NODE_ID", "FREE")
        known = adj.join(free.withColumnRenamed("NODE_ID", "NBR"), "NBR")
        self.near = frames.checkpoint(frames.chunked_lists(known, ["NODE_ID"], ["EDGE_SEQ", "NBR"], F.struct("NBR", "EDGE_SEQ", "FREE")).select(
            F.col("NODE_ID").alias("_p"), F.col("ITEMS").alias("_near")))
        near = {f.name: f.dataType.simpleString() for f in self.near.schema["_near"].dataType.elementType}
        self.types = {"NODE_ID": dict(starts.dtypes)["START_ID"], "FREE": near["FREE"], "EDGE_SEQ": near["EDGE_SEQ"]}
        first = starts.select("START_ID", F.col("START_ID").alias("NODE_ID")).join(free, "NODE_ID")
        first = frames.checkpoint(first.select(
            "START_ID", "NODE_ID", F.lit(1).cast("long").alias("RANK"), F.lit(0).alias("LEVEL"), "FREE", F.col("FREE").cast("long").alias("CUM_FREE")))
        # the last two levels of the starts that may go on, and the number of the last one
        self.tail = first.withColumn("_cur", F.lit(0))
        self.levels = [first]

    def _level(self, seen: DataFrame, step: int) -> DataFrame:
        """``seen`` with the neighbours of each start's level ``_cur + step``."""
        row = "struct<NODE_ID:{NODE_ID},RANK:bigint,LEVEL:int,FREE:{FREE},CUM_FREE:bigint,_prank:bigint,EDGE_SEQ:{EDGE_SEQ}>".format(**self.types)
        x = seen.withColumn("_at", F.expr(f"if(LEVEL = _cur + {step}, NODE_ID, null)")).join(self.near, F.expr("_at = _p"), "left")
        x = x.selectExpr("START_ID", "_cur", f"""inline(concat(
            cast(array(struct(NODE_ID, RANK, LEVEL, FREE, CUM_FREE, null, null)) as array<{row}>),
            coalesce(cast(transform(_near, n -> struct(n.NBR, null, null, n.FREE, null, RANK, n.EDGE_SEQ)) as array<{row}>), array())))""")
        x = x.groupBy("START_ID", "NODE_ID").agg(
            *[F.max(c).alias(c) for c in ("_cur", "RANK", "LEVEL", "FREE", "CUM_FREE")], F.min(F.struct("_prank", "EDGE_SEQ")).alias("_d"))
        # ranks have no gaps within a start, so the first one of its rows says where to go on
        w = Window.partitionBy("START_ID").orderBy(F.col("RANK").asc_nulls_last(), "_d", "NODE_ID").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return x.select(
            "START_ID", "NODE_ID", (F.first("RANK").over(w) + F.count(F.lit(1)).over(w) - 1).alias("RANK"),
            F.coalesce("LEVEL", F.col("_cur") + step + 1).alias("LEVEL"), "FREE",
            (F.first("CUM_FREE").over(w) - F.first("FREE").over(w) + F.sum("FREE").over(w)).alias("CUM_FREE"), "_cur")

    def expand(self, active: DataFrame | None = None) -> DataFrame | None:
        """The next levels of the ``active`` starts (START_ID; default all); None if no start has one."""
        seen = self.tail if active is None else self.tail.join(active, "START_ID", "left_semi")
        # the rows before the first step are few, but they grow in place
        seen = seen.repartition(frames.tasks_for(seen.count() * LEVELS, 50_000, 8), "START_ID")
        for step in range(LEVELS):
            seen = self._level(seen, step)
        seen = frames.checkpoint(seen)
        new = seen.where(F.col("LEVEL") > F.col("_cur")).drop("_cur")
        # a start without a level behind these has come to its end
        tail = seen.withColumn("_cur", F.col("_cur") + LEVELS).where(F.col("LEVEL") >= F.col("_cur") - 1)
        self.tail = tail if active is None else frames.checkpoint(tail.unionByName(self.tail.join(active, "START_ID", "left_anti")))
        if new.isEmpty():
            return None
        self.levels.append(new)
        return new


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_component(free: DataFrame, adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component of every node (NODE_ID, COMP), and per component its nodes, its rows (nodes and edges) and its free capacity ``_C``."""
    comp = components(free.select("NODE_ID"), adj)
    nodes = free.join(comp, "NODE_ID").groupBy("COMP").agg(F.count(F.lit(1)).alias("_nodes"), F.sum("FREE").alias("_C"))
    edges = adj.join(comp, "NODE_ID").groupBy("COMP").agg(F.count(F.lit(1)).alias("_edges"))
    sizes = nodes.join(edges, "COMP", "left").select("COMP", "_nodes", (F.col("_nodes") + F.coalesce("_edges", F.lit(0))).alias("_rows"), "_C")
    return comp, frames.checkpoint(sizes)


def _grouped(sizes: DataFrame, comp: DataFrame, free: DataFrame, adj: DataFrame, asks: DataFrame, key: str, work: Column):
    """Rows of the components in ``sizes`` in groups of bounded work, whole components in each (see :mod:`traversal`).

    A component of much ``work`` (a column of ``sizes``) is dealt to several
    shards, which share the questions ``asks`` (NODE_ID, ``key``) and all have its graph.
    """
    sizes = sizes.select("COMP", "_rows", F.greatest(F.ceil(work / WORK), F.lit(1)).cast("int").alias("_shards"))
    load = sizes.agg(F.sum(F.col("_rows") * F.col("_shards")), F.sum("_shards")).first()
    groups = frames.tasks_for(max((load[0] or 0) // GROUP_ROWS, min(load[1] or 0, 1 << 16)), 1, 1)
    least = int(free.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    comp = comp.join(sizes.drop("_rows"), "COMP")
    every = F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("_shards")).cast("int")
    nodes = free.select("NODE_ID", "FREE").join(comp, "NODE_ID").select(
        "COMP", every.alias("_shard"), F.lit(traversal.NODE).alias("_kind"), "NODE_ID", "FREE")
    edges = adj.select("NODE_ID", "NBR", "EDGE_SEQ").join(comp, "NODE_ID").select(
        "COMP", every.alias("_shard"), F.lit(traversal.EDGE).alias("_kind"), "NODE_ID", "NBR", "EDGE_SEQ")
    asks = asks.join(comp, "NODE_ID").select("COMP", own("NODE_ID").alias("_shard"), F.lit(traversal.ASK).alias("_kind"),
                                             *dict.fromkeys(["NODE_ID", key]))
    rows = nodes.unionByName(edges, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("COMP", "_shard"), F.lit(max(groups, least))))
    return rows.repartition(max(-(-groups // 8), least), "_group").groupBy("_group")


def _applied(grouped, run, schema: str) -> DataFrame:
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return grouped.applyInArrow(lambda table: run(table, kinds), schema)


def bfs_ranks(starts: DataFrame, free: DataFrame, adj: DataFrame) -> DataFrame:
    """BFS visiting order from every known start, whole.

    Components that fit a task are searched in groups (see :mod:`traversal`),
    from some of their starts in each; larger ones by :class:`Frontier`.
    """
    free = free.select("NODE_ID", "FREE").where(F.col("NODE_ID").isNotNull())
    comp, sizes = _by_component(free, adj)
    starts = starts.select("START_ID").distinct()
    asked = comp.join(starts.withColumnRenamed("START_ID", "NODE_ID"), "NODE_ID").groupBy("COMP").agg(F.count(F.lit(1)).alias("_asks"))
    sizes = frames.checkpoint(sizes.join(asked, "COMP"))
    fits = F.col("_rows") <= FITS
    grouped = _grouped(sizes.where(fits), comp, free, adj, starts.withColumnRenamed("START_ID", "NODE_ID"), "NODE_ID",
                       F.col("_asks") * F.col("_nodes"))
    kind = dict(free.dtypes)
    out = _applied(grouped, traversal.ranked, f"START_ID {kind['NODE_ID']}, NODE_ID {kind['NODE_ID']}, RANK bigint, LEVEL int, "
                                              f"FREE {kind['FREE']}, CUM_FREE bigint")
    large = sizes.where(~fits)
    if large.isEmpty():
        return out
    front = Frontier(starts.join(comp.join(large, "COMP", "left_semi").select(F.col("NODE_ID").alias("START_ID")), "START_ID", "left_semi"), free, adj)
    while front.expand() is not None:
        _log(f"bfs: level {LEVELS * (len(front.levels) - 1)}")
    return out.unionByName(_union(front.levels))


def one_hop_candidates(starts: DataFrame, free: DataFrame, adj: DataFrame) -> DataFrame:
    """E3 lists: the start itself, then its direct neighbours in edge order; RANK, FREE and CUM_FREE as in E4."""
    fr = free.select("NODE_ID", "FREE")
    own = starts.select("START_ID", F.col("START_ID").alias("NODE_ID"), F.lit(-1).cast("long").alias("_o"))
    nb = starts.select("START_ID").join(adj.withColumnRenamed("NODE_ID", "START_ID"), "START_ID").select(
        "START_ID", F.col("NBR").alias("NODE_ID"), F.col("EDGE_SEQ").cast("long").alias("_o"))
    known = fr.select(F.col("NODE_ID").alias("START_ID"))
    c = own.unionByName(nb).join(known, "START_ID", "left_semi").join(fr, "NODE_ID")
    return frames.running_by_group(c, ["START_ID"], ["_o", "NODE_ID"], {"RANK": ("count", None), "CUM_FREE": ("sum", "FREE")}).drop("_o")


def _placed(asked: DataFrame, cand: DataFrame, free: DataFrame, grow=None) -> DataFrame:
    """Every request in the place of a sequential run (REQ_NO, NODE_ID); those that end without one are missing.

    ``asked``: REQ_NO, START_ID, PTR.  Each round, an unplaced request looks at
    one block of its start's list from PTR on and proposes to the first node
    that may take it; a node keeps its ``FREE`` smallest requests.  A request at
    the end of the known list calls for ``grow(starts)``, the next candidates of
    these starts or None.
    """
    fr = free.select("NODE_ID", "FREE").where(F.col("FREE") > 0)
    block = lambda c: F.floor(F.col(c) / BLOCK)
    usable = lambda c: c.where(F.col("FREE") > 0).select("START_ID", "RANK", "NODE_ID", "FREE", block("RANK").alias("_b"))
    lists = [frames.checkpoint(usable(cand))]
    ends = cand.groupBy("START_ID").agg(F.max("RANK").alias("_end"))
    kind = free.schema["NODE_ID"].dataType
    state = frames.checkpoint(asked.select("REQ_NO", "START_ID", "PTR", F.lit(None).cast(kind).alias("HELD"), F.lit(False).alias("DONE")))
    rounds = 0
    while True:
        rounds += 1
        held = state.where(F.col("HELD").isNotNull())
        full = held.groupBy(F.col("HELD").alias("NODE_ID")).agg(F.count(F.lit(1)).alias("_n"), F.max("REQ_NO").alias("_worst"))
        free_now = state.where(F.col("HELD").isNull() & ~F.col("DONE"))
        seen = free_now.select("REQ_NO", "START_ID", "PTR", block("PTR").alias("_b")).join(_union(lists), ["START_ID", "_b"], "left")
        seen = seen.join(full, "NODE_ID", "left")
        shut = F.coalesce((F.col("_n") >= F.col("FREE")) & (F.col("_worst") < F.col("REQ_NO")), F.lit(False))
        fits = (F.col("RANK") >= F.col("PTR")) & ~shut
        # one row per unplaced request: its proposal, or the next block
        look = frames.checkpoint(seen.groupBy("REQ_NO", "START_ID").agg(
            F.min(F.when(fits, F.struct("RANK", "NODE_ID"))).alias("_p"), ((F.max("_b") + 1) * BLOCK).alias("_next")).join(
            ends, "START_ID", "left").select("REQ_NO", "START_ID", F.col("_p.RANK").alias("RANK"), F.col("_p.NODE_ID").alias("NODE_ID"),
                                             "_next", "_end"))
        if look.isEmpty():
            break
        _log(f"allocation: round {rounds}")
        prop = look.where(F.col("NODE_ID").isNotNull())
        pool = held.select("REQ_NO", "START_ID", F.col("HELD").alias("NODE_ID"), F.col("PTR").alias("RANK")).unionByName(
            prop.select("REQ_NO", "START_ID", "NODE_ID", "RANK")).join(fr, "NODE_ID")
        # a start offers a node no more requests than it has room, so a pool is bounded by the room around the node
        ranked = pool.withColumn("_pos", F.row_number().over(Window.partitionBy("NODE_ID").orderBy("REQ_NO")))
        stays = F.col("_pos") <= F.col("FREE")
        kept = ranked.select("REQ_NO", "START_ID", F.when(stays, F.col("RANK")).otherwise(F.col("RANK") + 1).alias("PTR"),
                             F.when(stays, F.col("NODE_ID")).alias("HELD"), F.lit(False).alias("DONE"))
        idle = look.where(F.col("NODE_ID").isNull())
        hungry = frames.checkpoint(idle.where(F.col("_next") > F.col("_end")).select("START_ID").distinct())
        more = None
        if grow is not None and not hungry.isEmpty():
            more = grow(hungry)
        over = F.col("_next") > F.col("_end")
        if more is None:
            moved = idle.select("REQ_NO", "START_ID", F.col("_next").alias("PTR"), F.lit(None).cast(kind).alias("HELD"), over.alias("DONE"))
        else:  # behind the known end at most, where the list goes on; starts that have no more end here
            going = more.select("START_ID").distinct().withColumn("_going", F.lit(True))
            moved = idle.join(going, "START_ID", "left").select(
                "REQ_NO", "START_ID", F.least("_next", F.col("_end") + 1).alias("PTR"), F.lit(None).cast(kind).alias("HELD"),
                (over & F.col("_going").isNull()).alias("DONE"))
            lists.append(frames.checkpoint(usable(more)))
            if len(lists) > LISTS:
                lists = [frames.checkpoint(_union(lists))]
            ends = frames.checkpoint(ends.unionByName(more.groupBy("START_ID").agg(F.max("RANK").alias("_end"))).groupBy("START_ID").agg(
                F.max("_end").alias("_end")))
        state = frames.checkpoint(kept.unionByName(moved).unionByName(state.where("DONE")))
    return state.where(F.col("HELD").isNotNull()).select("REQ_NO", F.col("HELD").alias("NODE_ID"))


def _first_places(numbered: DataFrame, cand: DataFrame, need: DataFrame) -> DataFrame:
    """Where each request begins: the k-th of its start at the rank that holds the start's k-th free slot.

    The slots before go to earlier requests of the same start at the latest,
    for these have the same list.  Requests beyond the last slot are missing.
    """
    slots = cand.where(F.col("FREE") > 0).join(need, "START_ID").where(F.col("CUM_FREE") - F.col("FREE") < F.col("NEED")).select(
        "START_ID", F.explode(F.sequence(F.col("CUM_FREE") - F.col("FREE") + 1, F.least("CUM_FREE", "NEED"))).alias("_k"),
        F.col("RANK").alias("PTR"))
    return numbered.join(slots, ["START_ID", "_k"]).select("REQ_NO", "START_ID", "PTR")


def allocate_bfs(requests: DataFrame, free: DataFrame, adj: DataFrame) -> DataFrame:
    """Each request (REQ_NO, START_ID) in order takes a slot at its first BFS-ranked node with room.

    Unknown starts and requests beyond their component's free capacity get NULL.
    Components that fit a task with the requests they serve are run one request
    after the other (see :mod:`traversal`), many components side by side; larger
    ones in rounds.
    """
    free = free.select("NODE_ID", "FREE").where(F.col("NODE_ID").isNotNull())
    comp, sizes = _by_component(free, adj)
    r = requests.join(comp.withColumnRenamed("NODE_ID", "START_ID"), "START_ID")
    r = frames.row_number_by(r, ["COMP"], ["REQ_NO"], "_pos").join(sizes.select("COMP", "_C"), "COMP").where(F.col("_pos") <= F.col("_C"))
    r = frames.checkpoint(r.select("REQ_NO", "START_ID", "COMP"))
    sizes = frames.checkpoint(sizes.join(r.groupBy("COMP").agg(F.count(F.lit(1)).alias("_asks")), "COMP"))
    fits = F.col("_rows") + F.col("_asks") <= FITS
    asks = r.join(sizes.where(fits), "COMP", "left_semi").select("REQ_NO", F.col("START_ID").alias("NODE_ID"))
    # one request follows the other, so a component is not dealt to shards
    grouped = _grouped(sizes.where(fits), comp, free, adj, asks, "REQ_NO", F.lit(0))
    kind = dict(free.dtypes)["NODE_ID"]
    got = _applied(grouped, traversal.placed, f"REQ_NO {dict(r.dtypes)['REQ_NO']}, NODE_ID {kind}")
    large = sizes.where(~fits)
    if not large.isEmpty():
        got = got.unionByName(_allocate_in_rounds(r.join(large, "COMP", "left_semi").select("REQ_NO", "START_ID"), free, adj))
    return requests.select("REQ_NO", "START_ID").join(got, "REQ_NO", "left")


def _allocate_in_rounds(requests: DataFrame, free: DataFrame, adj: DataFrame) -> DataFrame:
    """Places (REQ_NO, NODE_ID) of requests that their components serve, by deferred acceptance.

    A start's list is expanded until it has room for its own requests, and
    further, level by level, only while one of them is without a place.
    """
    served = frames.checkpoint(frames.row_number_by(requests, ["START_ID"], ["REQ_NO"], "_k"))
    need = frames.checkpoint(served.groupBy("START_ID").agg(F.max("_k").alias("NEED")))
    front = Frontier(need, free, adj)
    while True:
        got = front.tail.groupBy("START_ID").agg(F.max("CUM_FREE").alias("GOT"))
        short = frames.checkpoint(got.join(need, "START_ID").where(F.col("GOT") < F.col("NEED")).select("START_ID"))
        if short.isEmpty() or front.expand(short) is None:
            break
    cand = _union(front.levels)
    return _placed(_first_places(served, cand, need), cand, free, front.expand)


def allocate_one_hop(requests: DataFrame, free: DataFrame, adj: DataFrame) -> DataFrame:
    """Own node first, else the first direct neighbour with room, else none; unknown start is an error."""
    numbered = frames.checkpoint(frames.row_number_by(requests.select("REQ_NO", "START_ID"), ["START_ID"], ["REQ_NO"], "_k"))
    need = numbered.groupBy("START_ID").agg(F.max("_k").alias("NEED"))
    cand = frames.checkpoint(one_hop_candidates(need, free, adj))
    got = _placed(_first_places(numbered, cand, need), cand, free)
    known = free.select(F.col("NODE_ID").alias("START_ID"), F.lit(True).alias("_known"))
    out = requests.select("REQ_NO", "START_ID").join(got, "REQ_NO", "left").join(known, "START_ID", "left")
    return out.select("REQ_NO", "START_ID", "NODE_ID",
                      F.when(F.col("_known").isNull(), F.lit(R_UNKNOWN_START)).alias("REASON"))


def remaining(free: DataFrame, assigned: DataFrame) -> DataFrame:
    """Free slots left per node after an allocation."""
    used = assigned.where(F.col("NODE_ID").isNotNull()).groupBy("NODE_ID").agg(F.count(F.lit(1)).alias("_used"))
    j = free.join(used, "NODE_ID", "left")
    return j.select("NODE_ID", "CAP", "FREE", (F.col("FREE") - F.coalesce("_used", F.lit(0))).alias("REMAINING"))
