"""Registered joins and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import upsert as U
from gapline.registry import query

HASHED = "hs AS (SELECT chunk_id, source, created_at, sha256(text_content) AS content_hash FROM chunks)"


def hashed(t):
    return t.chunks.select("chunk_id", "source", "created_at", F.sha2("text_content", 256).alias("content_hash"))


# The target holds every third chunk.
NEW = f"""
  {HASHED}, tg AS (SELECT * FROM hs WHERE CAST(chunk_id AS BIGINT) % 3 = 0), nw AS (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY content_hash ORDER BY chunk_id) AS n FROM hs) WHERE n = 1 AND content_hash NOT IN (SELECT content_hash FROM tg))
"""


@query("insert_new_chunks", f"WITH {NEW} SELECT chunk_id, source, created_at, content_hash FROM nw", "chunks")
def _(t):
    rows = hashed(t)
    return U.insert_new_chunks(rows, rows.filter(F.col("chunk_id").cast("long") % 3 == 0))


@query("merge_chunks", f"WITH {NEW} SELECT * FROM tg UNION ALL SELECT chunk_id, source, created_at, content_hash FROM nw", "chunks")
def _(t):
    rows = hashed(t)
    return U.merge_chunks(rows, rows.filter(F.col("chunk_id").cast("long") % 3 == 0))


@query("merge_metrics", """
WITH u AS (SELECT gap_id, rule_id, event_id AS version, status, severity, 0 AS nw FROM gap_history WHERE event_id % 2 = 0 UNION ALL SELECT gap_id,
  rule_id, event_id, status, severity, 1 FROM gap_history WHERE event_id % 3 = 0)
SELECT gap_id, rule_id, version, status, severity FROM (SELECT *, row_number() OVER (PARTITION BY gap_id, rule_id ORDER BY version DESC, nw DESC) AS n
  FROM u) WHERE n = 1
""", "gap_history")  # fmt: skip
def _(t):
    rows = t.gap_history.select("gap_id", "rule_id", F.col("event_id").alias("version"), "status", "severity")
    return U.merge_metrics(rows.filter("version % 3 = 0"), rows.filter("version % 2 = 0"), ["gap_id", "rule_id"], "version")


@query("pending_chunks", """
  SELECT chunk_id, source, created_at FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM vectors v
    WHERE v.chunk_id = c.chunk_id AND v.model = 'm1' AND v.label < 5) ORDER BY created_at, chunk_id LIMIT 100
""", "chunks", "vectors")
def _(t):
    return U.pending_chunks(t.chunks.select("chunk_id", "source", "created_at"), t.vectors.filter("label < 5"), "m1", 100)


@query("chunk_with_embedding", "SELECT c.chunk_id, c.source, v.model, v.label, len(v.embedding) AS dims FROM chunks c JOIN vectors v ON c.chunk_id = v.chunk_id", "chunks", "vectors")
def _(t):
    return U.chunk_with_embedding(t.chunks.select("chunk_id", "source"), t.vectors).select("chunk_id", "source", "model", "label", F.size("embedding").cast("long").alias("dims"))


@query("lookup_chunks", "SELECT chunk_id, source FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM vectors WHERE label = 3)", "chunks", "vectors")
def _(t):
    return U.lookup_chunks(t.chunks.select("chunk_id", "source"), t.vectors.filter("label = 3"))


@query("cross_latest", "SELECT rule_name, count(*) AS n FROM gap_metrics WHERE analysis_id = (SELECT max(analysis_id) FROM gap_metrics) GROUP BY rule_name", "gap_metrics")
def _(t):
    return U.cross_latest(t.gap_metrics).groupBy("rule_name").agg(F.count("*").alias("n"))


@query("orphans", "SELECT chunk_id, label FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE CAST(chunk_id AS BIGINT) % 4 <> 1)", "chunks", "vectors")
def _(t):
    return U.orphans(t.vectors.select("chunk_id", "label"), t.chunks.filter(F.col("chunk_id").cast("long") % 4 != 1))


@query("not_in_cleanup", "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT DISTINCT chunk_id FROM vectors)", "chunks", "vectors")
def _(t):
    return U.not_in_cleanup(t.chunks.select("chunk_id"), t.vectors.select("chunk_id"))


@query("changed_since", "SELECT event_id, status_at FROM gap_history WHERE status_at > (SELECT max(started_at) FROM ingestion_log WHERE started_at < TIMESTAMP '2024-01-15')", "gap_history", "ingestion_log")
def _(t):
    return U.changed_since(t.gap_history.select("event_id", "status_at"), t.ingestion_log.filter("started_at < TIMESTAMP '2024-01-15'"), "status_at", "started_at")


@query("rule_coverage", """
WITH ck AS (SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, o_orderpriority AS artifact_type FROM orders), m AS (SELECT chunk_id, count(*) AS r
  FROM gap_metrics GROUP BY chunk_id)
SELECT artifact_type, count(*) AS chunks, count(r) AS covered, count(*) FILTER (r IS NULL) AS uncovered, CAST(coalesce(sum(r),
  0) AS BIGINT) AS results FROM ck LEFT JOIN m USING (chunk_id) GROUP BY artifact_type
""", "gap_metrics")  # fmt: skip
def _(t):
    return U.rule_coverage(t.orders.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("artifact_type")), t.gap_metrics)


@query("embedding_cache_join", f"""
WITH {HASHED}, ca AS (SELECT content_hash FROM hs WHERE CAST(chunk_id AS BIGINT) % 2 = 0 GROUP BY content_hash)
SELECT count(*) FILTER (content_hash IN (SELECT content_hash FROM ca)) AS hits, count(*) FILTER (content_hash NOT IN (SELECT content_hash
  FROM ca)) AS misses, count(DISTINCT content_hash) FILTER (content_hash NOT IN (SELECT content_hash FROM ca)) AS calls FROM hs
""", "chunks")  # fmt: skip
def _(t):
    rows = hashed(t)
    cache = rows.filter(F.col("chunk_id").cast("long") % 2 == 0).select("content_hash").distinct().withColumn("embedding", F.array(F.lit(1.0)))
    return U.cache_counts(rows.select("chunk_id", "content_hash"), cache)


@query("embedding_metadata", """
  SELECT c.chunk_id, c.source, c.artifact_type, c.created_at, sha256(c.text_content) AS content_hash, v.model, CAST(len(v.embedding) AS INT) AS dims,
    len(v.embedding) = 64 AS valid FROM chunks c JOIN vectors v ON c.chunk_id = v.chunk_id
""", "chunks", "vectors")
def _(t):
    return U.embedding_metadata(t.chunks, t.vectors, 64)


@query("delete_by_key", "SELECT chunk_id, label FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE source = 'src1')", "chunks", "vectors")
def _(t):
    return U.delete_by_key(t.vectors.select("chunk_id", "label"), t.chunks.filter("source = 'src1'"))


@query("expire_partitions", "SELECT run_id, started_at FROM ingestion_log WHERE started_at >= DATE '2024-01-30' - 10", "ingestion_log")
def _(t):
    return U.expire_partitions(t.ingestion_log.select("run_id", "started_at"), "started_at", "2024-01-30", 10)


ERRORS = "(status_code >= 400)"


@query("quarantine_errors", f"SELECT request_id, endpoint, substr(sha256(endpoint || ':' || 'http' || ':' || client), 1, 16) AS error_id FROM requests WHERE {ERRORS}", "requests")
def _(t):
    from gapline.sources.tables import quarantine_errors

    rows = t.requests.withColumns({"uri": F.col("endpoint"), "error_class": F.when(F.expr(ERRORS), "http"), "error_message": F.col("client")})
    _, bad = quarantine_errors(rows)
    return bad.select("request_id", "endpoint", "error_id")
