"""Registered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import reports as R
from gapline.registry import query

DAY = "2024-01-20"
RULES = [f"rule_{k}" for k in range(1, 8)]
CHUNKS = "chunk_types AS (SELECT DISTINCT chunk_id, artifact_type FROM gap_metrics)"
LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY status_at DESC, event_id DESC) AS rn FROM gap_history WHERE CAST(status_at AS DATE) <= DATE '{DAY}') WHERE rn = 1"


@query("gap_summary", f"""
WITH {CHUNKS}, j AS (SELECT m.analysis_id, c.artifact_type, m.rule_name, m.metric_value, m.chunk_id FROM gap_metrics m
  JOIN chunk_types c ON m.chunk_id = c.chunk_id),
s AS (SELECT analysis_id, artifact_type, rule_name, string_agg(chunk_id, ',' ORDER BY chunk_id) AS sample_chunks FROM (
  SELECT *, row_number() OVER (PARTITION BY analysis_id, artifact_type, rule_name ORDER BY chunk_id) AS n FROM (SELECT DISTINCT analysis_id,
    artifact_type, rule_name, chunk_id FROM j)) WHERE n <= 3 GROUP BY ALL)
SELECT j.analysis_id, j.artifact_type, j.rule_name, count(*) FILTER (metric_value >= 0.5) AS count_passed,
  count(*) FILTER (metric_value < 0.5) AS count_failed, count(*) AS total_chunks,
  round(round(avg(metric_value), 10), 6) AS avg_confidence, min(metric_value) AS min_confidence, max(metric_value) AS max_confidence,
    round(stddev_samp(metric_value), 6) AS confidence_stddev, any_value(s.sample_chunks) AS sample_chunks,
  round(count(*) FILTER (metric_value >= 0.5) * 100.0::DOUBLE / count(*), 6) AS pass_rate_percent
FROM j JOIN s USING (analysis_id, artifact_type, rule_name) GROUP BY j.analysis_id, j.artifact_type, j.rule_name
""", "gap_metrics")  # fmt: skip
def _(t):
    return R.gap_summary(t.gap_metrics, t.gap_metrics.select("chunk_id", "artifact_type").distinct())


@query("gap_summary_latest", """
WITH j AS (SELECT * FROM gap_metrics WHERE analysis_id = (SELECT max(analysis_id) FROM gap_metrics)),
s AS (SELECT artifact_type, rule_name, string_agg(chunk_id, ',' ORDER BY chunk_id) AS sample_chunks FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_type, rule_name ORDER BY chunk_id) AS n FROM (SELECT DISTINCT artifact_type, rule_name, chunk_id
    FROM j)) WHERE n <= 5 GROUP BY ALL)
SELECT j.artifact_type, j.rule_name, count(*) FILTER (passed) AS count_passed, count(*) FILTER (NOT passed) AS count_failed, count(*) AS total_chunks,
  round(round(avg(metric_value), 10), 3) AS avg_confidence,
  round(min(metric_value), 3) AS min_confidence, round(max(metric_value), 3) AS max_confidence, round(round(stddev_samp(metric_value), 10),
    3) AS confidence_stddev, any_value(s.sample_chunks) AS sample_chunks,
  round(round(count(*) FILTER (passed)::DOUBLE / count(*) * 100, 10), 1) AS pass_rate_percent
FROM j JOIN s USING (artifact_type, rule_name) GROUP BY j.artifact_type, j.rule_name
""", "gap_metrics")  # fmt: skip
def _(t):
    m = t.gap_metrics
    return R.gap_summary_latest(m.select("analysis_id", "rule_name", "chunk_id", "metric_value", F.to_json(F.struct("artifact_type", "passed")).alias("metadata")))


@query("latest_gap_state", f"SELECT gap_id, status, severity, rule_id, status_at, closed_at FROM ({LATEST})", "gap_history")
def _(t):
    return R.latest_gap_state(t.gap_history, DAY).select("gap_id", "status", "severity", "rule_id", "status_at", "closed_at")


@query("severity_distribution", f"""
  SELECT severity, count(*) AS gaps_detected, count(*) FILTER (status = 'OPEN') AS gaps_open, count(*) FILTER (status = 'CLOSED') AS gaps_closed
    FROM ({LATEST}) GROUP BY severity
""", "gap_history")
def _(t):
    return R.severity_distribution(t.gap_history, DAY)


CLOSURES = f"""
  SELECT rule_id, min(rule_name) AS rule_name, count(*) FILTER (status = 'CLOSED' AND CAST(closed_at AS DATE) = DATE '{DAY}') AS gaps_closed
    FROM gap_history WHERE CAST(closed_at AS DATE) BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' GROUP BY rule_id
"""


@query("rule_closures", f"SELECT * FROM ({CLOSURES}) WHERE gaps_closed > 0", "gap_history")
def _(t):
    return R.rule_closures(t.gap_history, DAY)


@query("progress_snapshot", f"""
WITH c AS (SELECT count(*) AS n, coalesce(sum(documented::INT), 0) AS d, avg(confidence_score) AS m FROM chunk_metrics WHERE
  CAST(processed_at AS DATE) <= DATE '{DAY}'),
s AS (SELECT severity, count(*) AS a, count(*) FILTER (status = 'OPEN') AS o, count(*) FILTER (status = 'CLOSED') AS x FROM ({LATEST}) GROUP BY severity),
k AS ({CLOSURES})
SELECT '{DAY}' AS snapshot_date, 'run_1' AS run_id, 'v1' AS metrics_version, c.n AS total_chunks_processed,
  CAST(c.d AS BIGINT) AS total_chunks_documented, round(coalesce(c.d::DOUBLE / nullif(c.n, 0) * 100, 0), 6) AS coverage_percentage,
  (SELECT CAST(sum(a) AS BIGINT) FROM s) AS total_gaps_detected, (SELECT CAST(sum(o) AS BIGINT) FROM s) AS total_gaps_open, (SELECT
    CAST(sum(x) AS BIGINT) FROM s) AS total_gaps_closed, round(coalesce(c.m, 0), 6) AS mean_confidence_score,
  (SELECT string_agg(severity || ':' || a || ':' || o || ':' || x, ',' ORDER BY severity) FROM s) AS severity_distribution,
  (SELECT coalesce(string_agg(rule_id || ':' || rule_name || ':' || gaps_closed, ',' ORDER BY gaps_closed DESC, rule_id), '') FROM k
    WHERE gaps_closed > 0) AS gaps_closed_by_rule,
  '{{"snapshot_date":"{DAY}","run_id":"run_1","metrics_version":"v1"}}' AS metadata
FROM c
""", "gap_history", "chunk_metrics")  # fmt: skip
def _(t):
    s = R.progress_snapshot(t.gap_history, t.chunk_metrics, DAY, "run_1")
    text = F.array_join(F.transform("severity_distribution", lambda x: F.concat_ws(":", x["severity"], x["gaps_detected"], x["gaps_open"], x["gaps_closed"])), ",")
    rules = F.array_join(F.transform("gaps_closed_by_rule", lambda x: F.concat_ws(":", x["rule_id"], x["rule_name"], x["gaps_closed"])), ",")
    return s.withColumn("severity_distribution", text).withColumn("gaps_closed_by_rule", rules).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("progress_timeseries", "SELECT * FROM snapshots WHERE snapshot_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25'", "snapshots")
def _(t):
    return R.progress_timeseries(t.snapshots, "2024-01-10", "2024-01-25")


@query("severity_heatmap", "SELECT CAST(status_at AS DATE) AS day, severity, count(*) AS gaps, count(*) FILTER (status = 'OPEN') AS gaps_open FROM gap_history GROUP BY ALL", "gap_history")
def _(t):
    return R.severity_heatmap(t.gap_history)


@query("latest_severity", """
  SELECT severity, count(*) AS gaps, count(*) FILTER (status = 'OPEN') AS gaps_open FROM gap_history WHERE CAST(status_at AS DATE) = (SELECT
    max(CAST(status_at AS DATE)) FROM gap_history) GROUP BY severity
""", "gap_history")
def _(t):
    days = R.daily_severity(t.gap_history)
    newest = days.agg(F.max("day").alias("newest"))
    return days.join(F.broadcast(newest), F.col("day") == F.col("newest")).select("severity", "gaps", "gaps_open")


@query("latest_rule_closures", """
  SELECT rule_id, count(*) AS gaps_closed FROM gap_history WHERE CAST(closed_at AS DATE) = (SELECT max(CAST(closed_at AS DATE)) FROM gap_history)
    GROUP BY rule_id
""", "gap_history")
def _(t):
    closed = t.gap_history.filter("closed_at is not null").groupBy(F.to_date("closed_at").alias("day"), "rule_id").agg(F.count("*").alias("gaps_closed"))
    newest = closed.agg(F.max("day").alias("newest"))
    return closed.join(F.broadcast(newest), F.col("day") == F.col("newest")).select("rule_id", "gaps_closed")


@query("snapshot_deltas", """
  SELECT snapshot_date, coverage_pct, open_gaps, round(coverage_pct - lag(coverage_pct) OVER (ORDER BY snapshot_date), 6) AS coverage_change,
    open_gaps - lag(open_gaps) OVER (ORDER BY snapshot_date) AS open_change FROM snapshots
""", "snapshots")
def _(t):
    return R.snapshot_deltas(t.snapshots)


@query("progress_highlights", """
  SELECT round(arg_max(coverage_pct, snapshot_date) - arg_min(coverage_pct, snapshot_date), 6) AS coverage_gain,
    CAST(sum(closed_gaps) AS BIGINT) AS closed_total, arg_max(open_gaps, snapshot_date) AS open_latest, arg_max(mean_confidence,
    snapshot_date) AS confidence_latest FROM snapshots
""", "snapshots")
def _(t):
    return R.progress_highlights(t.snapshots)


TOKENS = "greatest(1, length(text_content) // 4)"


@query("source_counts", f"""
  SELECT source, count(*) AS chunk_rows, count(DISTINCT artifact_type) AS artifact_types, count(DISTINCT kind) AS kinds, round(avg({TOKENS}),
    6) AS avg_tokens, min(created_at) AS first_at, max(created_at) AS last_at FROM chunks GROUP BY source
""", "chunks")
def _(t):
    return R.source_counts(t.chunks)


@query("error_stats", "SELECT source_type, status, count(*) AS error_count, max(started_at) AS last_at FROM ingestion_log WHERE status = 'failed' GROUP BY ALL", "ingestion_log")
def _(t):
    return R.error_stats(t.ingestion_log)


@query("error_samples", """
  SELECT endpoint, string_agg(message, '; ' ORDER BY message) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY endpoint
    ORDER BY message) AS n FROM (SELECT DISTINCT endpoint, 'client ' || client AS message FROM requests WHERE status_code >= 400)) WHERE n <= 3
    GROUP BY endpoint
""", "requests")
def _(t):
    return R.error_samples(t.requests)


@query("ingestion_stats", """
  SELECT count(*) AS runs, count(DISTINCT CAST(started_at AS DATE)) AS days, CAST(sum(files_processed) AS BIGINT) AS files,
    CAST(sum(rows_written) AS BIGINT) AS rows_written, CAST(sum(errors_count) AS BIGINT) AS errors, round(avg(processing_duration_ms), 6) AS avg_ms,
    min(started_at) AS first_at, max(started_at) AS last_at, round(count(*) FILTER (status = 'completed')::DOUBLE / count(*), 6) AS success_rate
    FROM ingestion_log
""", "ingestion_log")
def _(t):
    return R.ingestion_stats(t.ingestion_log)


@query("data_quality_score", """
WITH p AS (SELECT source, count(*) AS n, count(DISTINCT chunk_id) AS k, max(created_at) AS l FROM chunks GROUP BY source),
s AS (SELECT count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3', 'missing') AND n >= 10) / 5.0::DOUBLE AS e,
  count(*) FILTER (k / n::DOUBLE > 0.1) / greatest(1, count(*))::DOUBLE AS d, max(l) AS l FROM p),
  q AS (SELECT count(*) FILTER (status = 'completed')::DOUBLE / count(*) AS u FROM ingestion_log),
z AS (SELECT round(40 * e + 30 * d + CASE WHEN u >= 0.95 THEN 20 ELSE 0 END + CASE
  WHEN l > TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOURS THEN 10 ELSE 0 END, 2) AS score FROM s, q)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM z
""", "chunks", "ingestion_log")  # fmt: skip
def _(t):
    return R.data_quality_score(t.chunks, t.ingestion_log, ["src0", "src1", "src2", "src3", "missing"], "2024-01-02 00:00:00")


@query("gap_pivot", "SELECT artifact_type, " + ", ".join(f"count(*) FILTER (rule_name = '{k}' AND NOT passed) AS {k}" for k in RULES) + " FROM gap_metrics GROUP BY artifact_type", "gap_metrics")
def _(t):
    return R.gap_pivot(t.gap_metrics, RULES)


@query("gap_totals", """
  SELECT artifact_type, count(*) AS total, count(*) FILTER (NOT passed) AS failed, round(round(avg(metric_value), 10), 6) AS mean_confidence,
    round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 6) AS pass_rate FROM gap_metrics GROUP BY ROLLUP (artifact_type)
""", "gap_metrics")
def _(t):
    return R.gap_totals(t.gap_metrics)


@query("monthly_trend", """
  SELECT strftime(created_at, '%Y-%m') AS month, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count,
    round(round(avg(metric_value), 10), 6) AS avg_confidence FROM gap_metrics GROUP BY 1
""", "gap_metrics")
def _(t):
    return R.monthly_trend(t.gap_metrics)


@query("severity_share", """
  SELECT artifact_type, severity, count(*) AS n, round(round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY artifact_type), 10),
    1) AS percentage FROM gap_metrics GROUP BY artifact_type, severity
""", "gap_metrics")
def _(t):
    return R.severity_share(t.gap_metrics)


@query("escalation_audit", """
  SELECT rule_name, round(avg(severity), 6) AS avg_severity, round(round(avg(metric_value), 10), 6) AS avg_confidence FROM gap_metrics
    WHERE metric_value < 0.2 GROUP BY rule_name HAVING round(avg(severity), 6) < 4.0
""", "gap_metrics")
def _(t):
    return R.escalation_audit(t.gap_metrics)


@query("severity_consistency", """
  SELECT rule_name, severity, count(*) AS n, round(round(avg(metric_value), 10), 6) AS avg_confidence FROM gap_metrics
    WHERE severity >= 4 AND metric_value > 0.8 GROUP BY ALL
""", "gap_metrics")
def _(t):
    return R.severity_consistency(t.gap_metrics)


@query("execution_stats", """
  SELECT analysis_id, count(*) AS total, count(DISTINCT chunk_id) AS chunks, count(DISTINCT rule_name) AS rules,
    round(round(count(*) FILTER (NOT passed) * 100.0::DOUBLE / count(*), 10), 2) AS failed_pct,
    round(round(count(*) FILTER (metric_value < 0.3) * 100.0::DOUBLE / count(*), 10), 2) AS low_confidence_pct FROM gap_metrics GROUP BY analysis_id
""", "gap_metrics")
def _(t):
    return R.execution_stats(t.gap_metrics)


for _name, _key in (("rule_performance", "rule_name"), ("analysis_performance", "analysis_id")):

    @query(_name, f"SELECT {_key}, round(round(avg(metric_value), 10), 6) AS avg_confidence, count(*) AS n FROM gap_metrics WHERE created_at >= TIMESTAMP '2000-01-01' GROUP BY {_key}", "gap_metrics")
    def _(t, key=_key):
        return R.performance_by(t.gap_metrics, key, "2000-01-01")


@query("duplicate_keys", "SELECT chunk_id, rule_name, ruleset_version, count(*) AS n FROM gap_metrics GROUP BY ALL HAVING count(*) > 1", "gap_metrics")
def _(t):
    return R.duplicate_keys(t.gap_metrics)


@query("stale_versions", "SELECT ruleset_version, count(*) AS n FROM gap_metrics WHERE ruleset_version <> 'v1.0.1' GROUP BY ruleset_version", "gap_metrics")
def _(t):
    return R.stale_versions(t.gap_metrics, "v1.0.1")


@query("stale_runs", "SELECT analysis_id, max(created_at) AS newest, count(*) AS n FROM gap_metrics GROUP BY analysis_id HAVING CAST(max(created_at) AS DATE) < DATE '2024-01-01' - 365", "gap_metrics")
def _(t):
    return R.stale_runs(t.gap_metrics, "2024-01-01", 365)


@query("top_chunks", f"SELECT chunk_id, {TOKENS} AS tokens FROM chunks ORDER BY tokens DESC, chunk_id LIMIT 10", "chunks")
def _(t):
    return R.top_chunks(t.chunks)


@query("ingestion_by_day", "SELECT CAST(started_at AS DATE) AS day, source_type, count(*) AS runs, CAST(sum(rows_written) AS BIGINT) AS rows_written FROM ingestion_log GROUP BY ALL", "ingestion_log")
def _(t):
    return R.ingestion_by_day(t.ingestion_log)


@query("token_stats", f"""
  SELECT source, round(avg({TOKENS}), 6) AS avg_tokens, min({TOKENS}) AS min_tokens, max({TOKENS}) AS max_tokens, round(stddev_samp({TOKENS}),
    6) AS sd_tokens FROM chunks GROUP BY source
""", "chunks")
def _(t):
    return R.token_stats(t.chunks)


@query("missing_fields", """
  SELECT source, count(*) FILTER (text_content IS NULL OR length(text_content) < 20) AS short_content,
    count(*) FILTER (chunk_id IS NULL OR chunk_id = '') AS missing_id, count(*) FILTER (NOT regexp_matches(sha256(text_content),
    '^[0-9a-f]{64}$')) AS bad_hash, count(*) AS n FROM chunks GROUP BY source
""", "chunks")
def _(t):
    return R.missing_fields(t.chunks)


@query("recent_runs", """
  SELECT run_id, source_type, status, started_at, round(processing_duration_ms / 1000, 6) AS seconds FROM ingestion_log ORDER BY started_at DESC,
    run_id DESC LIMIT 20
""", "ingestion_log")
def _(t):
    return R.recent_runs(t.ingestion_log)


@query("table_quality", """
  SELECT *, round(greatest(0, 1 - (null_ids + duplicate_ids + short_texts)::DOUBLE / n), 6) AS quality FROM (SELECT count(*) AS n,
    count(*) FILTER (chunk_id IS NULL) AS null_ids, count(*) - count(DISTINCT chunk_id) AS duplicate_ids,
    count(*) FILTER (length(text_content) < 10) AS short_texts FROM chunks)
""", "chunks")
def _(t):
    return R.table_quality(t.chunks)


@query("acceptance_rollup", """
  SELECT analysis_id, count(*) AS results, count(DISTINCT artifact_type) AS types, count(DISTINCT rule_name) AS rules, round(round(avg(metric_value),
    10), 6) AS avg_confidence, count(DISTINCT severity) AS severities FROM gap_metrics GROUP BY analysis_id
""", "gap_metrics")
def _(t):
    return R.acceptance_rollup(t.gap_metrics)


@query("embedding_by_source", """
  SELECT artifact_type, count(*) AS vectors, round(avg(len(embedding)), 6) AS avg_dims, count(DISTINCT chunk_id) AS chunk_ids FROM vectors
    GROUP BY artifact_type
""", "vectors")
def _(t):
    return t.vectors.groupBy("artifact_type").agg(F.count("*").alias("vectors"), F.round(F.avg(F.size("embedding")), 6).alias("avg_dims"), F.count_distinct("chunk_id").alias("chunk_ids"))
