"""Breadth-first search inside a task, for groups of whole components.

A component that fits a task needs no exchange a level: its nodes, its edges and
what is asked of it are brought together once, and the search runs over arrays.
Many small components share a group; nothing here knows of Spark.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NODE, EDGE, ASK = 0, 1, 2
#: Places of the table of visited nodes, for as many starts at once as fit; visited nodes that waiting searches may hold.
PLACES, HELD = 1 << 22, 1 << 22


def _codes(values: list) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers for equal values across several columns, and the values by number."""
    chunks = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
    coded = pa.concat_arrays(chunks).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    return np.split(numbers, np.cumsum([len(c) for c in chunks])[:-1]), coded.dictionary


class Graph:
    """Nodes and ordered edges of a group's components; ``rows`` has a row per node, edge and question (``_kind``).

    Nodes are numbered component by component; ``asks`` are the rows of the
    questions whose node is known, ``asked`` its number.
    """

    def __init__(self, rows: pa.Table, asks_by: str):
        part = lambda kind: rows.filter(pc.equal(rows["_kind"], kind))
        nodes, edges, asks = part(NODE), part(EDGE), part(ASK)
        edges = edges.take(pc.sort_indices(edges, [("EDGE_SEQ", "ascending"), ("NBR", "ascending")], null_placement="at_start"))
        asks = asks.take(pc.sort_indices(asks, [(asks_by, "ascending")], null_placement="at_start"))
        (of_node, of_edge, of_ask), _ = _codes([t["COMP"] for t in (nodes, edges, asks)])
        shard = lambda t: t["_shard"].to_numpy()
        shards = int(shard(rows).max(initial=0)) + 1
        (node, source, target, asked), self.values = _codes([nodes["NODE_ID"], edges["NODE_ID"], edges["NBR"], asks["NODE_ID"]])
        place = lambda comp, t, n: (comp.astype(np.int64) * shards + shard(t)) * len(self.values) + n
        keys = place(of_node, nodes, node)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        self.code, self.free = node[order], nodes["FREE"].to_numpy(zero_copy_only=False)[order]
        self.room = np.nan_to_num(self.free.astype(np.float64)).astype(np.int64) if self.free.dtype.kind == "f" else self.free.astype(np.int64)
        comp = keys // max(1, len(self.values))
        self.begin = np.searchsorted(comp, comp)  # of each node: the first node of its component, and the nodes of it
        self.size = np.searchsorted(comp, comp, "right") - self.begin

        def known(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

        (a, fine_a), (b, fine_b) = known(place(of_edge, edges, source)), known(place(of_edge, edges, target))
        a, b = a[fine_a & fine_b], b[fine_a & fine_b]
        by_source = np.argsort(a, kind="stable")
        self.near = b[by_source]
        self.first = np.searchsorted(a[by_source], np.arange(len(keys) + 1))
        at, fine = known(place(of_ask, asks, asked))
        self.asks, self.asked = asks.filter(pa.array(fine)), at[fine]

    def ranks(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The visiting order from every asked node, a level at a time: start, node, rank, level, free room up to the node."""
        low = 0
        while low < len(self.asked):
            sizes = np.cumsum(self.size[self.asked[low:]])
            high = low + max(1, int(np.searchsorted(sizes, PLACES, "right")))
            starts, low = self.asked[low:high], high
            base = np.concatenate([[0], sizes[:len(starts)]])
            offset = base[:-1] - self.begin[starts]
            seen = np.full(base[-1], -1, np.int32)
            owner, node = np.arange(len(starts)), starts
            seen[offset + node] = 0
            count, room, level = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
            while len(node):
                # rows stand by start and rank
                new = np.bincount(owner, minlength=len(starts))
                before = (np.cumsum(new) - new)[owner]
                total = np.cumsum(self.room[node])
                within = total - (total - self.room[node])[before] + room[owner]
                yield starts[owner], node, count[owner] + np.arange(len(node)) - before + 1, np.full(len(node), level, np.int32), within
                count += new
                room += np.bincount(owner, weights=self.room[node], minlength=len(starts)).astype(np.int64)
                # neighbours in the order of their discovery; the first discovery counts
                degree = self.first[node + 1] - self.first[node]
                edge = np.repeat(self.first[node] - (np.cumsum(degree) - degree), degree) + np.arange(degree.sum())
                owner, node, level = np.repeat(owner, degree), self.near[edge], level + 1
                at = offset[owner] + node
                fresh = seen[at] < 0
                owner, node, at = owner[fresh], node[fresh], at[fresh]
                turn = np.arange(len(at), dtype=np.int32)
                seen[at[::-1]] = turn[::-1]
                first = seen[at] == turn
                owner, node = owner[first], node[first]

    def allocate(self) -> np.ndarray:
        """Each question in its order takes a slot of the first node with room, by the visiting order of its own; -1 without one.

        Full nodes stay full, so the searches of a start go on where the last one
        stopped; if they hold too much, they begin anew.
        """
        room, near, first = self.room.tolist(), self.near.tolist(), self.first.tolist()
        searches, held, out = {}, 0, np.full(len(self.asked), -1, np.int64)
        for k, start in enumerate(self.asked.tolist()):
            if held > HELD:
                searches, held = {}, 0
            queue, seen, at = searches.get(start) or ([start], {start}, 0)
            before = len(queue) if start in searches else 0
            while at < len(queue) and room[queue[at]] <= 0:
                node = queue[at]
                for other in near[first[node]:first[node + 1]]:
                    if other not in seen:
                        seen.add(other)
                        queue.append(other)
                at += 1
            if at < len(queue):
                out[k] = queue[at]
                room[queue[at]] -= 1
            searches[start] = queue, seen, at
            held += len(queue) - before
        return out


def ranked(rows: pa.Table, kinds: pa.Schema) -> pa.Table:
    """START_ID, NODE_ID, RANK, LEVEL, FREE and CUM_FREE of a group's starts."""
    graph = Graph(rows, "NODE_ID")
    parts = [*zip(*graph.ranks())]
    if not parts:
        return kinds.empty_table()
    start, node, rank, level, within = map(np.concatenate, parts)
    value = lambda at: graph.values.take(pa.array(graph.code[at]))
    free = pa.array(graph.free, from_pandas=True).cast(kinds.field("FREE").type).take(pa.array(node))
    return pa.Table.from_arrays([value(start), value(node), pa.array(rank), pa.array(level), free, pa.array(within)], schema=kinds)


def placed(rows: pa.Table, kinds: pa.Schema) -> pa.Table:
    """REQ_NO and NODE_ID of a group's requests that got a slot."""
    graph = Graph(rows, "REQ_NO")
    got = graph.allocate()
    fine = got >= 0
    return pa.Table.from_arrays([graph.asks["REQ_NO"].filter(pa.array(fine)).combine_chunks(), graph.values.take(pa.array(graph.code[got[fine]]))], schema=kinds)
