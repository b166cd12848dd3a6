"""Driver queries for graph capacity allocation (E*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import allocate as A
from lotline.plans.oracle_views import with_views
from lotline.plans.registry import register
from lotline.sources import views as V
from lotline.sources.tables import table


def graph(spark: SparkSession, d: str):
    return A.build_graph(V.graph_nodes(spark, d), V.graph_edges(spark, d))


def cap_as_free(nodes: DataFrame) -> DataFrame:
    return nodes.select("NODE_ID", "CAP", F.col("CAP").alias("FREE"))


@register("e1_build_graph", with_views("""
WITH ends AS (SELECT SRC AS NODE_ID FROM graph_edges UNION SELECT DST FROM graph_edges),
n AS (SELECT NODE_ID, arg_max(CAP, SEQ) AS CAP FROM graph_nodes GROUP BY ALL
      UNION ALL SELECT NODE_ID, 0 FROM ends WHERE NODE_ID NOT IN (SELECT NODE_ID FROM graph_nodes)),
adj AS (SELECT SRC AS a, DST AS b FROM graph_edges UNION SELECT DST, SRC FROM graph_edges)
SELECT n.NODE_ID, n.CAP, count(adj.b) AS DEGREE FROM n LEFT JOIN adj ON adj.a = n.NODE_ID GROUP BY ALL""",
                                       "graph_nodes", "graph_edges"))
def e1(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    deg = adj.groupBy("NODE_ID").agg(F.count(F.lit(1)).alias("DEGREE"))
    return nodes.join(deg, "NODE_ID", "left").select("NODE_ID", "CAP", F.coalesce("DEGREE", F.lit(0)).alias("DEGREE"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Slots already in use: customers with a negative balance, by c_custkey % (n + 5)."""
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    c = table(spark, d, "customer").where(F.col("c_acctbal") < 0).select("c_custkey").crossJoin(F.broadcast(n))
    return c.groupBy((F.col("c_custkey") % (F.col("_n") + 5)).alias("NODE_ID")).agg(F.count(F.lit(1)).alias("USED"))


@register("e2_free_capacity", with_views("""
WITH u AS (SELECT c_custkey % ((SELECT count(*) FROM supplier) + 5) AS NODE_ID, count(*) AS USED
           FROM customer WHERE c_acctbal < 0 GROUP BY ALL)
SELECT g.NODE_ID, g.CAP, coalesce(u.USED, 0) AS USED, greatest(0, least(g.CAP, g.CAP - coalesce(u.USED, 0))) AS FREE
FROM graph_nodes g LEFT JOIN u USING (NODE_ID)""", "graph_nodes"))
def e2(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph(spark, d)
    return A.free_capacity(nodes, usage(spark, d))


# nodes with their neighbours in edge order; a BFS queue per start, one step per popped node
_GRAPH_SQL = """
ends AS (SELECT SRC AS NODE_ID FROM graph_edges UNION SELECT DST FROM graph_edges),
n AS (SELECT NODE_ID, arg_max(CAP, SEQ) AS CAP FROM graph_nodes GROUP BY ALL
      UNION ALL SELECT NODE_ID, 0 FROM ends WHERE NODE_ID NOT IN (SELECT NODE_ID FROM graph_nodes)),
adj AS (SELECT a, b, min(EDGE_SEQ) AS s FROM (
          SELECT SRC AS a, DST AS b, EDGE_SEQ FROM graph_edges UNION ALL SELECT DST, SRC, EDGE_SEQ FROM graph_edges) AS e
        GROUP BY a, b),
nb AS (SELECT n.NODE_ID, coalesce(list(b ORDER BY s, b) FILTER (WHERE b IS NOT NULL), []) AS ns
       FROM n LEFT JOIN adj ON adj.a = n.NODE_ID GROUP BY n.NODE_ID)"""
_BFS_SQL = """
bfs AS (SELECT NODE_ID AS START_ID, [NODE_ID] AS q, [0] AS lv, 1 AS p FROM n
        UNION ALL
        SELECT START_ID, list_concat(q, more), list_concat(lv, list_transform(more, lambda x: lv[p] + 1)), p + 1
        FROM (SELECT bfs.*, list_filter(nb.ns, lambda x: NOT list_contains(q, x)) AS more
              FROM bfs JOIN nb ON nb.NODE_ID = bfs.q[bfs.p]) AS step),
queue AS (SELECT START_ID, q, lv FROM bfs WHERE p = len(q) + 1)"""


def _fold_sql(candidates: str) -> str:
    """One request after the other takes a slot of its first candidate with room; ``candidates(START_ID, cs)``."""
    return f"""
place AS (SELECT NODE_ID, row_number() OVER (ORDER BY NODE_ID) AS i, CAP FROM n),
cand AS ({candidates}),
spot AS (SELECT START_ID, list(i ORDER BY pos) AS cs
         FROM (SELECT START_ID, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS pos FROM cand) AS u
         JOIN place ON place.NODE_ID = u.c GROUP BY START_ID),
req AS (SELECT REQ_NO, g.START_ID, coalesce(cs, []) AS cs, row_number() OVER (ORDER BY REQ_NO) AS k
        FROM graph_requests g LEFT JOIN spot ON spot.START_ID = g.START_ID),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS got, (SELECT list(CAP ORDER BY i) FROM place) AS free
         UNION ALL
         SELECT k + 1, got, list_transform(free, lambda x, j: CASE WHEN j = got THEN x - 1 ELSE x END)
         FROM (SELECT fold.k, free, list_filter(req.cs, lambda c: free[c] > 0)[1] AS got
               FROM fold JOIN req ON req.k = fold.k + 1) AS step),
served AS (SELECT req.REQ_NO, req.START_ID, place.NODE_ID FROM req JOIN fold USING (k) LEFT JOIN place ON place.i = fold.got)"""


_ONE_HOP = "SELECT NODE_ID AS START_ID, list_concat([NODE_ID], list_filter(ns, lambda x: x <> NODE_ID)) AS cs FROM nb"
_QUEUES = "SELECT START_ID, q AS cs FROM queue"
_VIEWS = ("graph_nodes", "graph_edges", "graph_requests")


@register("e3_one_hop_allocation", with_views(f"""
WITH RECURSIVE {_GRAPH_SQL.strip()},
{_fold_sql(_ONE_HOP).strip()}
SELECT REQ_NO, START_ID, NODE_ID, CASE WHEN START_ID NOT IN (SELECT NODE_ID FROM n) THEN 'unknown start' END AS REASON
FROM served""", *_VIEWS))
def e3(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    return A.allocate_one_hop(V.graph_requests(spark, d), cap_as_free(nodes), adj)


@register("e4_bfs_order", with_views(f"""
WITH RECURSIVE {_GRAPH_SQL.strip()},
{_BFS_SQL.strip()}
SELECT START_ID, unnest(q) AS NODE_ID, unnest(range(1, len(q) + 1)) AS RANK, unnest(lv) AS LEVEL FROM queue""",
                                     "graph_nodes", "graph_edges"))
def e4(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    starts = nodes.select(F.col("NODE_ID").alias("START_ID"))
    return A.bfs_ranks(starts, cap_as_free(nodes), adj).select("START_ID", "NODE_ID", "RANK", "LEVEL")


@register("e5_components", with_views("""
WITH RECURSIVE adj AS (SELECT SRC AS a, DST AS b FROM graph_edges UNION SELECT DST, SRC FROM graph_edges),
r AS (SELECT NODE_ID AS s, NODE_ID AS v FROM graph_nodes
      UNION SELECT r.s, adj.b FROM r JOIN adj ON adj.a = r.v)
SELECT v AS NODE_ID, min(s) AS COMP FROM r GROUP BY ALL""", "graph_nodes", "graph_edges"))
def e5(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    return A.components(nodes.select("NODE_ID"), adj)


_SERVED_SQL = f"WITH RECURSIVE {_GRAPH_SQL.strip()},\n{_BFS_SQL.strip()},\n{_fold_sql(_QUEUES).strip()}"


@register("e6_allocate_requests", with_views(_SERVED_SQL + "\nSELECT REQ_NO, START_ID, NODE_ID FROM served", *_VIEWS))
def e6(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    return A.allocate_bfs(V.graph_requests(spark, d), cap_as_free(nodes), adj)


@register("e7_remaining_capacity", with_views(_SERVED_SQL + """
SELECT n.NODE_ID, n.CAP, n.CAP AS FREE, n.CAP - count(served.REQ_NO) AS REMAINING
FROM n LEFT JOIN served ON served.NODE_ID = n.NODE_ID GROUP BY n.NODE_ID, n.CAP""", *_VIEWS))
def e7(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = graph(spark, d)
    free = cap_as_free(nodes)
    got = A.allocate_bfs(V.graph_requests(spark, d), free, adj)
    return A.remaining(free, got)
