"""lotline: Spark-native loading, dispatch and shop-floor analytics.

Every operator takes and returns DataFrames; the heavy lifting is Catalyst
(joins, aggregates, windows, exchanges).  Sub-packages:

* ``sources``   – driver tables, fixture views, envelopes, catalog
* ``functions`` – Column-expression helpers (coercion, keys, calendar)
* ``operators`` – DataFrame -> DataFrame operators (dedup, batching,
  dispatch, allocation, statistics)
* ``plans``     – composed query plans and the query/oracle registry
* ``streaming`` – Structured Streaming forms (foreachBatch load, TTL dedup)
"""

__version__ = "0.1.0"
