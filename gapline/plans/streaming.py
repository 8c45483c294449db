"""Registered streaming queries: the driver's tables are read as streams, run to their end, and the result is read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.fixtures import Tables
from gapline.operators import rules, scoring
from gapline.registry import query
from gapline.sources import tables as S
from gapline.sources.shared import new_folder
from gapline.streaming import jobs as J
from gapline.streaming import requests as R


def folder(t: Tables, name: str = "stream") -> str:
    """A new folder that driver and executors share."""
    return new_folder(t.spark, name)


def request_stream(t: Tables) -> DataFrame:
    """``requests`` as a stream over the events file."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    return raw.select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("GET:/"), "event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.concat(F.lit("agent_"), (F.col("user_id") % 7).cast("string")).alias("user_agent"), F.col("user_id").cast("string").alias("client"),
    )


def through_stream(t: Tables, make, keys: list[str]) -> DataFrame:
    base = folder(t)
    J.stream_updates(make(request_stream(t)), f"{base}/out", f"{base}/checkpoint")
    return J.latest_metrics(t.spark.read.parquet(f"{base}/out").drop("batch"), keys).drop("version")


for _name, _every, _unit in (("request_counts_hourly", "1 hour", "hour"), ("request_counts_daily", "1 day", "day")):

    @query(_name, f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS window_start, count(*) AS requests FROM requests GROUP BY 1", "requests")
    def _(t, every=_every):
        return through_stream(t, lambda s: R.request_counts(s, every), ["window_start"])


@query("performance_alerts", """
  SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
    round(count(*) FILTER (status_code >= 400)::DOUBLE / count(*), 6) AS error_rate FROM requests GROUP BY 1) WHERE error_rate > 0.25
""", "requests")
def _(t):
    return through_stream(t, lambda s: R.window_errors(s), ["window_start"]).filter("error_rate > 0.25")


@query("error_rate", """
  SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
    round(count(*) FILTER (status_code >= 400)::DOUBLE / count(*), 6) AS error_rate FROM requests GROUP BY endpoint
""", "requests")
def _(t):
    return through_stream(t, R.error_rate, ["endpoint"])


@query("requests_by_status", "SELECT status_code, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors FROM requests GROUP BY status_code", "requests")
def _(t):
    return through_stream(t, R.requests_by_status, ["status_code"])


@query("endpoint_latency", """
  SELECT endpoint, count(*) AS requests, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    round(quantile_cont(duration_ms, 0.5), 6) AS median_ms FROM requests GROUP BY endpoint
""", "requests")
def _(t):
    return R.endpoint_latency(t.requests)


@query("latency_percentiles", "SELECT count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM requests", "requests")
def _(t):
    return R.latency_percentiles(t.requests)


# Durations as seconds times a hundred, so that requests overlap and pass the hour.
PEAK = """
WITH r AS (SELECT ts, ts + to_microseconds(CAST(round(duration_ms * 100000) * 1000 AS BIGINT)) AS e FROM requests),
s AS (SELECT ts, e, unnest(generate_series(date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', e)::TIMESTAMP, INTERVAL 1 HOUR)) AS bucket FROM r),
x AS (SELECT bucket, greatest(ts, bucket) AS tt, 1 AS d FROM s UNION ALL SELECT bucket, e, -1 FROM s WHERE date_trunc('hour', e)::TIMESTAMP = bucket)
SELECT bucket, CAST(max(r) AS BIGINT) AS peak FROM (SELECT bucket, sum(d) OVER (PARTITION BY bucket ORDER BY tt, d DESC ROWS UNBOUNDED PRECEDING) AS r
  FROM x) GROUP BY bucket
"""


@query("peak_concurrency", PEAK, "requests")
def _(t):
    return R.peak_concurrency(t.requests.withColumn("ts", F.col("ts").cast("timestamp")), per_unit_ms=100_000.0)


for _name, _column, _n in (("top_endpoints", "endpoint", 10), ("top_clients", "client", 5)):

    @query(_name, f"SELECT {_column}, count(*) AS requests FROM requests GROUP BY 1 ORDER BY requests DESC, {_column} LIMIT {_n}", "requests")
    def _(t, column=_column, n=_n):
        return R.top_values(t.requests, column, n)


@query("unique_clients", "SELECT count(DISTINCT client) AS clients, count(DISTINCT user_agent) AS agents FROM requests", "requests")
def _(t):
    return R.unique_clients(t.requests)


@query("auth_outcomes", """
  SELECT user_agent, count(*) AS attempts, count(*) FILTER (status_code < 400) AS successes,
    round(count(*) FILTER (status_code < 400)::DOUBLE / count(*), 6) AS success_rate FROM requests GROUP BY user_agent
""", "requests")
def _(t):
    return R.auth_outcomes(t.requests)


REASON = "CASE WHEN CAST(client AS BIGINT) % 3 > 0 THEN concat('reason ', CAST(client AS BIGINT) % 3) END"


@query("auth_failures", f"SELECT reason, count(*) AS failures FROM (SELECT status_code, {REASON} AS reason FROM requests) WHERE status_code >= 400 AND reason IS NOT NULL GROUP BY reason", "requests")
def _(t):
    return R.auth_failures(t.requests.withColumn("reason", F.expr(REASON)))


@query("recent_errors", "SELECT request_id, endpoint, ts FROM requests WHERE status_code >= 400 ORDER BY ts DESC, request_id DESC LIMIT 50", "requests")
def _(t):
    return R.recent_errors(t.requests, 50)


#: Of each endpoint: requests, and whether the sketched percentiles' ranks are within the error of the wanted ones.
SKETCHED = """
SELECT endpoint, count(duration_ms) AS requests, true AS within FROM requests WHERE duration_ms IS NOT NULL GROUP BY endpoint
"""


@query("latency_percentiles_stream", SKETCHED, "requests")
def _(t):
    ps, error = [0.5, 0.95, 0.99], 0.005
    base = folder(t)
    J.stream_updates(R.latency_sketches(request_stream(t), error=error), f"{base}/out", f"{base}/checkpoint")
    sketches = J.latest_metrics(t.spark.read.parquet(f"{base}/out").drop("batch"), ["window_start", "endpoint"])
    merged = R.merged_percentiles(sketches, ["endpoint"], ps).withColumnRenamed("requests", "n")
    # Ranks of an estimate: how many values are below it, and how many are not above it.
    rows = t.requests.filter("duration_ms is not null").select(F.col("endpoint").alias("of"), "duration_ms").join(merged, F.col("of") == F.col("endpoint"))
    counts = [F.count_if(F.col("duration_ms") < F.col("percentiles")[i]).alias(f"below{i}") for i in range(len(ps))]
    counts += [F.count_if(F.col("duration_ms") <= F.col("percentiles")[i]).alias(f"upto{i}") for i in range(len(ps))]
    met = rows.groupBy("endpoint").agg(F.count("*").alias("requests"), F.first("n").alias("n"), *counts)
    within = F.col("n") == F.col("requests")
    for i, p in enumerate(ps):
        within &= (F.col(f"below{i}") <= (p + error) * F.col("n") + 1) & (F.col(f"upto{i}") >= (p - error) * F.col("n") - 1)
    return met.select("endpoint", "requests", within.alias("within"))


@query("recent_errors_stream", "SELECT request_id, endpoint, ts FROM requests WHERE status_code >= 400 ORDER BY ts DESC, request_id DESC LIMIT 50", "requests")
def _(t):
    base = folder(t)
    with J.stateful(t.spark):
        J.stream_updates(R.recent_error_lists(request_stream(t), 50, timedelta(days=36_500)), f"{base}/out", f"{base}/checkpoint")
    lists = J.latest_metrics(t.spark.read.parquet(f"{base}/out").drop("batch"), ["endpoint"])
    return R.merged_errors(lists, 50)


@query("stream_ingest", "SELECT endpoint, client, min(request_id) AS chunk_id FROM requests GROUP BY endpoint, client", "requests")
def _(t):
    base = folder(t)
    rows = request_stream(t).select(F.sha2(F.concat_ws(":", "endpoint", "client"), 256).alias("content_hash"), F.col("request_id").alias("chunk_id"), "endpoint", "client", "ts")
    for _ in range(2):  # the second run finds nothing new
        J.stream_ingest(rows, f"{base}/out", f"{base}/checkpoint", "ts", buckets=8)
    return t.spark.read.parquet(f"{base}/out").select("endpoint", "client", "chunk_id")


@query("stream_gap_metrics", "SELECT artifact_type, rule_name, count(*) AS n, count(*) FILTER (passed) AS passed_count FROM (" + " UNION ALL ".join(f"({rules.oracle_sql(r)})" for r in rules.RULES) + ") GROUP BY ALL", "source_text")
def _(t):
    base = folder(t)
    t.source_text.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(t.source_text.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    none = t.spark.createDataFrame([], "rule_name string, chunk_id string, similarity double")
    J.stream_gap_metrics(stream, lambda b: scoring.gap_metrics(b, none, "stream"), f"{base}/out", f"{base}/checkpoint")
    newest = J.latest_metrics(t.spark.read.parquet(f"{base}/out").drop("batch"), ["chunk_id", "rule_name", "ruleset_version"])
    return newest.groupBy("artifact_type", "rule_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_count"))


# Sinks: write, read back.


@query("write_partitioned", "SELECT CAST(created_at AS DATE) AS partition_date, count(*) AS n, count(DISTINCT chunk_id) AS chunk_ids FROM chunks GROUP BY 1", "chunks")
def _(t):
    path = folder(t)
    S.write_partitioned(t.chunks.withColumn("partition_date", F.to_date("created_at")), path, "partition_date", ["artifact_type", "source", "chunk_id"], files=2)
    return t.spark.read.parquet(path).groupBy("partition_date").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunk_ids"))


@query("overwrite_partitions", "SELECT ruleset_version, artifact_type, count(*) AS n FROM gap_metrics GROUP BY ALL", "gap_metrics")
def _(t):
    path, rows = folder(t), t.gap_metrics
    S.overwrite_partitions(rows, path, ["ruleset_version", "artifact_type"])
    S.overwrite_partitions(rows.filter("artifact_type = 'irs'"), path, ["ruleset_version", "artifact_type"])  # a repeated slice changes nothing
    return t.spark.read.parquet(path).groupBy("ruleset_version", "artifact_type").agg(F.count("*").alias("n"))


@query("overwrite_table", "SELECT rule_name, count(*) AS n FROM gap_metrics WHERE passed GROUP BY rule_name", "gap_metrics")
def _(t):
    path = folder(t)
    S.overwrite_table(t.gap_metrics, path)
    S.overwrite_table(t.gap_metrics.filter("passed"), path)
    return t.spark.read.parquet(path).groupBy("rule_name").agg(F.count("*").alias("n"))


@query("export_sorted_parquet", "SELECT analysis_id, chunk_id, rule_name, metric_value FROM gap_metrics", "gap_metrics")
def _(t):
    path = folder(t)
    S.export_sorted_parquet(t.gap_metrics.select("analysis_id", "chunk_id", "rule_name", "metric_value"), path, ["analysis_id", "chunk_id"])
    return t.spark.read.parquet(path)


@query("export_report_csv", "SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, open_gaps, closed_gaps FROM snapshots", "snapshots")
def _(t):
    path = folder(t)
    S.export_report_csv(t.snapshots.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "open_gaps", "closed_gaps"), path, "snapshot_date")
    return t.spark.read.option("header", True).schema("snapshot_date string, open_gaps bigint, closed_gaps bigint").csv(path)


@query("load_ndjson", "SELECT event_id, event_type, props IS NULL AS no_props FROM events")
def _(t):
    path = folder(t)
    t.events.select("event_id", "event_type", "props").write.json(path)
    return S.load_ndjson(t.spark, path, "event_id bigint, event_type string, props string").select("event_id", "event_type", F.col("props").isNull().alias("no_props"))


@query("insert_rows", "SELECT label, 2 * count(*) AS n FROM embeddings GROUP BY label")
def _(t):
    path, rows = folder(t), t.embeddings.select("vec_id", "label")
    S.insert_rows(rows, path)
    S.insert_rows(rows, path)
    return t.spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("log_run", "SELECT 'completed' AS status, count(*) AS rows_written, CAST(sum(strlen(text_content)) AS BIGINT) AS bytes FROM chunks", "chunks")
def _(t):
    base = folder(t)
    S.run_logged(t.chunks, f"{base}/out", f"{base}/log", "run_1", "documents")
    return t.spark.read.schema(S.RUNS).parquet(f"{base}/log").select("status", "rows_written", "bytes")


@query("table_stats", """
  SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS row_count, 6 AS column_count UNION ALL SELECT 'part', (SELECT count(*) FROM part), 6
    UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11
""")
def _(t):
    return S.table_stats({"orders": t.orders, "part": t.part, "lineitem": t.lineitem})


#: Where pages go by their number: two folders that a scan reads, three that it leaves out (excluded, hidden, excluded below another), and binary files.
FOLDERS = ("src", "docs/deep", "node_modules", ".cache", "src/build", "data")
SCANNED = """
SELECT CASE page_id % 6 WHEN 0 THEN 'src' ELSE 'docs/deep' END AS folder, CAST(sum(length(replace(coalesce(html, ''), chr(10), ' ')) + 1) AS BIGINT) AS n_chars,
       count(*) AS n_lines, 'utf-8' AS encodings, 0 AS errors
FROM pages WHERE page_id % 6 < 2 GROUP BY 1
"""


@query("scan_corpus", SCANNED)
def _(t):
    """Pages as lines of text files in a tree of folders, by Spark's own writer; scanned, read and added up by folder."""
    from gapline.sources import files as P

    base = folder(t)
    line = F.regexp_replace(F.coalesce("html", F.lit("")), "\n", " ")
    for k, name in enumerate(FOLDERS):
        rows = t.pages.filter(F.col("page_id") % len(FOLDERS) == k)
        rows.select(F.concat(F.lit("\0" if name == "data" else ""), line).alias("value")).write.text(f"{base}/site/{name}")
    texts = P.read_text_with_fallback(P.scan_corpus(t.spark, f"{base}/site", (".txt",), most_bytes=1 << 30))
    texts = texts.filter("text <> '' or error is not null").withColumn("folder", F.regexp_extract("path", "/site/(.*)/[^/]*$", 1))
    n = F.length("text")
    lines = F.sum(n - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    return texts.groupBy("folder").agg(F.sum(n).alias("n_chars"), lines.alias("n_lines"), F.array_join(F.array_sort(F.collect_set("encoding")), ",").alias("encodings"), F.count("error").cast("int").alias("errors"))


@query("read_text_with_fallback")
def _(t):
    from gapline.sources import files as P

    raw = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("E9E8"))).otherwise(F.encode("text", "utf-8")).alias("content"))
    return P.read_text_with_fallback(raw).select("path", "encoding", F.length("text").alias("n_chars"))
