"""DuckDB text of the fixture views, inlined as CTEs into each oracle query.

These mirror ``lotline.sources.views`` row for row; they are the independent
side of the correctness check and never run on Spark.
"""
from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S'"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "msg_orders": (f"""
SELECT o_orderdate AS arr_ts, 0 AS arr_src, o_orderkey AS arr_k1, 0::BIGINT AS arr_k2, 0::BIGINT AS arr_k3,
       0::BIGINT AS arr_k4,
       to_json({{'Table': 'APP.ORDERS',
                'Key': CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END,
                'Payload': {{'ORDER_ID': o_orderkey, 'CUST_ID': o_custkey,
                            'ORDER_DT': strftime(o_orderdate, {ISO}), 'TOTAL': o_totalprice}},
                'Ts': strftime(o_orderdate, {ISO})}})::VARCHAR AS body
FROM orders""", ()),
    "msg_lines": (f"""
SELECT l_shipdate AS arr_ts, 1 AS arr_src, l_partkey AS arr_k1, l_suppkey AS arr_k2, l_orderkey AS arr_k3,
       l_linenumber::BIGINT AS arr_k4,
       to_json({{'Table': 'app.order_lines',
                'Key': CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR),
                'Payload': {{'order_id': l_orderkey, 'Line_No': l_linenumber, 'SKU': l_partkey,
                            'QTY': l_quantity, 'EXTRA': l_returnflag}},
                'Ts': strftime(l_shipdate, {ISO})}})::VARCHAR AS body
FROM lineitem""", ()),
    "messages": ("SELECT * FROM msg_orders UNION ALL SELECT * FROM msg_lines", ("msg_orders", "msg_lines")),
    "state_events": ("""
SELECT user_id AS EQP_ID, ts AS TS, event_id AS EVENT_ID,
       CASE event_type WHEN 'signup' THEN 'SETUP' WHEN 'purchase' THEN 'BUSY' WHEN 'view' THEN 'IDLE_RUN'
            WHEN 'click' THEN 'IDLE'
            WHEN 'error' THEN CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 50 THEN 'PM' ELSE 'DOWN' END
       END AS STATE
FROM events""", ()),
    "state_log": ("""
SELECT EQP_ID, TS, EVENT_ID, STATE,
       coalesce(lead(TS) OVER (PARTITION BY EQP_ID ORDER BY TS, EVENT_ID), (SELECT max(TS) FROM state_events))
         AS END_TS
FROM state_events""", ("state_events",)),
    "lots": ("""
SELECT o_orderkey AS LOT_ID, o_custkey % 20 AS EQP_ID, o_orderpriority AS STEP_ID, o_custkey AS GROUP_ID,
       o_orderdate AS ARRIVAL, o_orderdate + INTERVAL 30 DAY AS DUE, 1 + o_orderkey % 25 AS QTY,
       o_orderpriority = '1-URGENT' AS HOT
FROM orders""", ()),
    "moves": ("""
SELECT l_partkey AS PART_ID, l_linenumber AS STEP_SEQ, l_suppkey AS EQP_ID, l_orderkey AS LOT_ID,
       l_shipdate + to_hours(l_linenumber) AS START_TS, l_discount * 24 AS RUN_HOUR,
       l_shipdate + to_hours(l_linenumber) + to_seconds(CAST(round(l_discount * 86400) AS BIGINT)) AS END_TS,
       l_tax * 24 AS WAIT_HOUR, l_quantity AS QTY, l_returnflag = 'R' AS HOT, l_linestatus AS SETUP,
       l_shipdate AS arr_ts, l_partkey AS arr_k1, l_suppkey AS arr_k2, l_orderkey AS arr_k3,
       l_linenumber::BIGINT AS arr_k4
FROM lineitem""", ()),
    "factor_lots": ("""
SELECT *, (51 - STEP_SEQ) * 2.0 AS REMAIN_HOURS, 24.0 * (30 + LOT_ID % 60) AS Q_LIMIT_HOURS FROM (
  SELECT LOT_ID, EQP_ID, STEP_ID, GROUP_ID, ARRIVAL, ARRIVAL - to_days(CAST(LOT_ID % 100 AS INTEGER)) AS CREATED, DUE, QTY,
         LOT_ID % 7 AS PART_ID, 'L' || LOT_ID % 4 AS LAYER_ID, 'R' || LOT_ID % 5 AS RECIPE_ID, (LOT_ID // 7) % 3 AS STACK_ID,
         1 + LOT_ID % 50 AS STEP_SEQ, 50 AS N_STEPS FROM lots)""", ("lots",)),
    "last_runs": ("""
SELECT EQP_ID, PART_ID % 7 AS LAST_PART, 'R' || PART_ID % 5 AS LAST_RECIPE, LOT_ID % 3 AS LAST_STACK FROM moves
QUALIFY row_number() OVER (PARTITION BY EQP_ID ORDER BY START_TS DESC, arr_ts DESC, arr_k1 DESC, arr_k2 DESC, arr_k3 DESC, arr_k4 DESC) = 1""",
                  ("moves",)),
    "down": ("""
SELECT EQP_ID, TS AS START_TS, END_TS, STATE, EVENT_ID FROM state_log WHERE STATE IN ('PM', 'DOWN')""",
             ("state_log",)),
    "arrange": ("""
SELECT PART_ID, STEP_SEQ, (PART_ID + STEP_SEQ) % 100 AS EQP_ID, RECIPE_ID,
       CASE WHEN PART_ID % 2 = 0 THEN TIMESTAMP '1995-01-01' END AS START_TIME,
       CASE WHEN PART_ID % 2 = 0 THEN TIMESTAMP '1999-12-31' END AS END_TIME
FROM (SELECT p_partkey AS PART_ID, p_type AS RECIPE_ID, CAST(unnest(generate_series(1, 7)) AS INTEGER) AS STEP_SEQ FROM part)""",
                ()),
    "arrange_log": ("""
SELECT user_id AS KEY1, event_type AS KEY2,
       CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'add' ELSE 'remove' END AS ACTION,
       ts AS TS, event_id AS EVENT_ID
FROM events""", ()),
    "route": ("""
SELECT p_type AS ROUTE_ID, p_partkey AS STEP_ID, p_size AS CT_HOUR, 1 - p_size / 1000.0 AS YIELD,
       row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS STEP_SEQ
FROM part""", ()),
    "bom": ("""
SELECT p_partkey AS CHILD, p_partkey // 2 AS PARENT, 1.0 / p_size AS RATIO FROM part WHERE p_partkey >= 1""", ()),
    "graph_nodes": ("SELECT s_suppkey AS NODE_ID, s_suppkey % 4 AS CAP, s_suppkey AS SEQ FROM supplier", ()),
    "graph_edges": ("""
SELECT * FROM (SELECT s_suppkey AS SRC, (7 * s_suppkey + 1) % (SELECT count(*) FROM supplier) AS DST,
                      s_suppkey AS EDGE_SEQ FROM supplier) WHERE SRC <> DST""", ()),
    "graph_requests": ("""
SELECT row_number() OVER (ORDER BY o_orderkey) AS REQ_NO,
       o_custkey % ((SELECT count(*) FROM supplier) + 5) AS START_ID, o_orderkey AS ORDER_KEY
FROM orders""", ()),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` and their dependencies."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in VIEWS[n][1]:
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in ordered)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
