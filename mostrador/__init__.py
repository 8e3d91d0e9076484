"""Commerce analytics as plain DataFrame functions on Spark.

Sub-packages: ``functions`` (column expressions, skew-safe grouping), ``sources``
(schemas, readers, writers, payload flattening), ``operators`` (joins, marts, KPIs,
upserts, signals), ``streaming`` (incremental ingest) and ``plans`` (the registered
queries with their SQL counterparts).
"""
