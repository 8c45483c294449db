"""Summaries, progress snapshots and data-quality reports over gap metrics, change logs and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECIMALS = 6


def r(x: Column, digits: int = DECIMALS) -> Column:
    """Rounded by way of ten digits, so that a tie does not hang on the order of a sum."""
    return F.round(F.round(x, 10), digits)


def count_if(c: Column) -> Column:
    return F.count_if(c)


def first_ids(column: str, n: int) -> Column:
    """The n smallest distinct ids, joined. ``collect_set`` sees ids that were made distinct map-side."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, n), ",")


def with_samples(rows: DataFrame, keys: list[str], column: str, n: int, aggregates: list[Column]) -> DataFrame:
    """Group by ``keys``; ``sample_chunks`` holds the n smallest distinct ids, found by a ranking that keeps n rows of each task."""
    distinct = rows.select(*keys, column).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(column))
    some = distinct.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias("sample_chunks"))
    return rows.groupBy(*keys).agg(*aggregates).join(some, keys)


def gap_summary(metrics: DataFrame, chunks: DataFrame, samples: int = 3) -> DataFrame:
    """Per analysis, type and rule: verdicts by threshold 0.5, confidence statistics, pass rate, sample ids."""
    rows = metrics.select("analysis_id", "chunk_id", "rule_name", "metric_value").join(chunks.select("chunk_id", "artifact_type"), "chunk_id")
    v = F.col("metric_value")
    out = with_samples(
        rows, ["analysis_id", "artifact_type", "rule_name"], "chunk_id", samples,
        [count_if(v >= 0.5).alias("count_passed"), count_if(v < 0.5).alias("count_failed"), F.count("*").alias("total_chunks"), r(F.avg(v)).alias("avg_confidence"), F.min(v).alias("min_confidence"), F.max(v).alias("max_confidence"), r(F.stddev_samp(v)).alias("confidence_stddev")],
    )
    return out.withColumn("pass_rate_percent", r(F.col("count_passed") * 100.0 / F.col("total_chunks")))


def gap_summary_latest(packed: DataFrame, samples: int = 5) -> DataFrame:
    """The same for the newest analysis, with type and verdict read from a JSON column; rounded for display."""
    newest = packed.agg(F.max("analysis_id").alias("newest"))
    rows = packed.join(F.broadcast(newest), F.col("analysis_id") == F.col("newest"))
    rows = rows.select(F.get_json_object("metadata", "$.artifact_type").alias("artifact_type"), "rule_name", "chunk_id", "metric_value", (F.get_json_object("metadata", "$.passed") == "true").alias("ok")).filter("artifact_type is not null")
    v = F.col("metric_value")
    out = with_samples(
        rows, ["artifact_type", "rule_name"], "chunk_id", samples,
        [count_if(F.col("ok")).alias("count_passed"), count_if(~F.col("ok")).alias("count_failed"), F.count("*").alias("total_chunks"), r(F.avg(v), 3).alias("avg_confidence"), r(F.min(v), 3).alias("min_confidence"), r(F.max(v), 3).alias("max_confidence"), r(F.stddev_samp(v), 3).alias("confidence_stddev")],
    )
    return out.withColumn("pass_rate_percent", r(F.try_divide(F.col("count_passed"), F.col("count_passed") + F.col("count_failed")) * 100, 1))


def latest_gap_state(history: DataFrame, as_of: str) -> DataFrame:
    """Newest row of each gap up to a day; ties by event_id. ``max_by`` combines map-side, so a busy gap is no hot task."""
    rows = history.filter(F.to_date("status_at") <= F.lit(as_of).cast("date"))
    fields = [c for c in history.columns if c != "gap_id"]
    newest = rows.groupBy("gap_id").agg(F.max_by(F.struct(*fields), F.struct("status_at", "event_id")).alias("s"))
    return newest.select("gap_id", "s.*")


def severity_distribution(history: DataFrame, as_of: str) -> DataFrame:
    state = latest_gap_state(history, as_of)
    return state.groupBy("severity").agg(F.count("*").alias("gaps_detected"), count_if(F.col("status") == "OPEN").alias("gaps_open"), count_if(F.col("status") == "CLOSED").alias("gaps_closed"))


def rule_closures(history: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Gaps closed on the day by rule, among rules with closures in the days before."""
    day = F.lit(as_of).cast("date")
    rows = history.filter(F.to_date("closed_at").between(F.date_sub(day, days), day))
    out = rows.groupBy("rule_id").agg(F.min("rule_name").alias("rule_name"), count_if((F.col("status") == "CLOSED") & (F.to_date("closed_at") == day)).alias("gaps_closed"))
    return out.filter("gaps_closed > 0")


def progress_snapshot(history: DataFrame, chunk_metrics: DataFrame, as_of: str, run_id: str, version: str = "v1") -> DataFrame:
    """One row: documentation coverage, open and closed gaps, severities and closures as ordered arrays, run metadata as JSON."""
    day = F.lit(as_of).cast("date")
    chunks = chunk_metrics.filter(F.to_date("processed_at") <= day).agg(F.count("*").alias("total_chunks_processed"), F.coalesce(F.sum(F.col("documented").cast("int")), F.lit(0)).alias("total_chunks_documented"), F.avg("confidence_score").alias("mean"))
    state = severity_distribution(history, as_of)
    gaps = state.agg(
        F.coalesce(F.sum("gaps_detected"), F.lit(0)).alias("total_gaps_detected"), F.coalesce(F.sum("gaps_open"), F.lit(0)).alias("total_gaps_open"), F.coalesce(F.sum("gaps_closed"), F.lit(0)).alias("total_gaps_closed"),
        F.array_sort(F.collect_list(F.struct("severity", "gaps_detected", "gaps_open", "gaps_closed"))).alias("severity_distribution"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("gaps_closed")).alias("o"), "rule_id", "rule_name", "gaps_closed")))
    closures = rule_closures(history, as_of).agg(F.transform(ordered, lambda x: F.struct(x["rule_id"].alias("rule_id"), x["rule_name"].alias("rule_name"), x["gaps_closed"].alias("gaps_closed"))).alias("gaps_closed_by_rule"))
    coverage = F.coalesce(F.try_divide(F.col("total_chunks_documented"), F.col("total_chunks_processed")) * 100, F.lit(0.0))
    out = chunks.join(F.broadcast(gaps)).join(F.broadcast(closures))  # one row each
    return out.select(
        day.alias("snapshot_date"), F.lit(run_id).alias("run_id"), F.lit(version).alias("metrics_version"), "total_chunks_processed", "total_chunks_documented", r(coverage).alias("coverage_percentage"), "total_gaps_detected", "total_gaps_open", "total_gaps_closed",
        r(F.coalesce("mean", F.lit(0.0))).alias("mean_confidence_score"), "severity_distribution", "gaps_closed_by_rule",
        F.to_json(F.struct(F.lit(as_of).alias("snapshot_date"), F.lit(run_id).alias("run_id"), F.lit(version).alias("metrics_version"))).alias("metadata"),
    )


def progress_timeseries(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    return snapshots.filter(F.col("snapshot_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("snapshot_date")


def daily_severity(history: DataFrame) -> DataFrame:
    """(day, severity, gaps): the heat map of changes by day and severity."""
    return history.groupBy(F.to_date("status_at").alias("day"), "severity").agg(F.count("*").alias("gaps"), count_if(F.col("status") == "OPEN").alias("gaps_open"))


def severity_heatmap(history: DataFrame) -> DataFrame:
    """Snapshots hold severities as an array; the heat map unnests it again."""
    packed = daily_severity(history).groupBy("day").agg(F.collect_list(F.struct("severity", "gaps", "gaps_open")).alias("severities"))
    return packed.select("day", F.explode("severities").alias("s")).select("day", "s.*")


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """Change of coverage and open gaps against the previous snapshot (a few rows a day: one ordered partition)."""
    w = W.orderBy("snapshot_date")
    return snapshots.select("snapshot_date", "coverage_pct", "open_gaps", r(F.col("coverage_pct") - F.lag("coverage_pct").over(w)).alias("coverage_change"), (F.col("open_gaps") - F.lag("open_gaps").over(w)).alias("open_change"))


def progress_highlights(snapshots: DataFrame) -> DataFrame:
    by = F.col("snapshot_date")
    return snapshots.agg(r(F.max_by("coverage_pct", by) - F.min_by("coverage_pct", by)).alias("coverage_gain"), F.sum("closed_gaps").alias("closed_total"), F.max_by("open_gaps", by).alias("open_latest"), F.max_by("mean_confidence", by).alias("confidence_latest"))


def source_counts(chunks: DataFrame) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.floor(F.length("text_content") / 4))
    return chunks.groupBy("source").agg(F.count("*").alias("chunk_rows"), F.count_distinct("artifact_type").alias("artifact_types"), F.count_distinct("kind").alias("kinds"), r(F.avg(tokens)).alias("avg_tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def error_stats(log: DataFrame) -> DataFrame:
    return log.filter("status = 'failed'").groupBy("source_type", "status").agg(F.count("*").alias("error_count"), F.max("started_at").alias("last_at"))


def error_samples(requests: DataFrame, n: int = 3) -> DataFrame:
    """At most n distinct messages of each endpoint."""
    rows = requests.filter("status_code >= 400").select("endpoint", F.concat(F.lit("client "), "client").alias("message")).distinct()
    rank = F.row_number().over(W.partitionBy("endpoint").orderBy("message"))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy("endpoint").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("samples"))


def ingestion_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("runs"), F.count_distinct(F.to_date("started_at")).alias("days"), F.sum("files_processed").alias("files"), F.sum("rows_written").alias("rows_written"), F.sum("errors_count").cast("long").alias("errors"),
        r(F.avg("processing_duration_ms")).alias("avg_ms"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), r(count_if(F.col("status") == "completed") / F.count("*")).alias("success_rate"),
    )


def data_quality_score(chunks: DataFrame, log: DataFrame, expected: list[str], as_of: str, least_rows: int = 10, hours: int = 24) -> DataFrame:
    """40 for the share of expected sources with enough rows, 30 for the share of sources with more than a tenth distinct artifacts,
    20 if at least 95 % of runs succeeded, 10 if any source is fresh; grade A to F.
    """
    per = chunks.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("artifacts"), F.max("created_at").alias("last_at"))
    enough = F.count_if(F.col("source").isin(*expected) & (F.col("n") >= least_rows)) / F.lit(len(expected))
    diverse = F.count_if(F.col("artifacts") / F.col("n") > 0.1) / F.greatest(F.lit(1), F.count("*"))
    sources = per.agg(enough.alias("enough"), diverse.alias("diverse"), F.max("last_at").alias("last_at"))
    runs = log.agg((count_if(F.col("status") == "completed") / F.count("*")).alias("success"))
    fresh = F.col("last_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    score = 40 * F.col("enough") + 30 * F.col("diverse") + F.when(F.col("success") >= 0.95, 20).otherwise(0) + F.when(fresh, 10).otherwise(0)
    out = sources.join(F.broadcast(runs)).select(r(score, 2).alias("score"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return out.withColumn("grade", grade)


def gap_pivot(metrics: DataFrame, rules: list[str]) -> DataFrame:
    """Types by rules: failed chunks, 0 where there are none. The columns are given, so no extra job finds them."""
    return metrics.groupBy("artifact_type").pivot("rule_name", rules).agg(count_if(~F.col("passed"))).na.fill(0)


def gap_totals(metrics: DataFrame) -> DataFrame:
    """Per type and overall (null type) in one pass."""
    return metrics.rollup("artifact_type").agg(F.count("*").alias("total"), count_if(~F.col("passed")).alias("failed"), r(F.avg("metric_value")).alias("mean_confidence"), r(count_if(F.col("passed")) * 100.0 / F.count("*")).alias("pass_rate"))


def monthly_trend(metrics: DataFrame, month: str | None = None) -> DataFrame:
    rows = metrics.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    rows = rows if month is None else rows.filter(F.col("month") == month)
    return rows.groupBy("month").agg(count_if(F.col("passed")).alias("passed_count"), count_if(~F.col("passed")).alias("failed_count"), r(F.avg("metric_value")).alias("avg_confidence"))


def severity_share(metrics: DataFrame) -> DataFrame:
    """Share of each severity inside its type: a window over the aggregate, not over the rows."""
    counts = metrics.groupBy("artifact_type", "severity").agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", r(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("artifact_type")), 1))


def escalation_audit(metrics: DataFrame, low: float = 0.2, least: float = 4.0) -> DataFrame:
    """Rules whose low-confidence results are not severe on average: escalation does not work for them."""
    rows = metrics.filter(F.col("metric_value") < low).groupBy("rule_name").agg(r(F.avg("severity")).alias("avg_severity"), r(F.avg("metric_value")).alias("avg_confidence"))
    return rows.filter(F.col("avg_severity") < least)


def severity_consistency(metrics: DataFrame) -> DataFrame:
    """High severity with high confidence: such rows contradict each other."""
    return metrics.filter("severity >= 4 AND metric_value > 0.8").groupBy("rule_name", "severity").agg(F.count("*").alias("n"), r(F.avg("metric_value")).alias("avg_confidence"))


def execution_stats(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("analysis_id").agg(F.count("*").alias("total"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("rule_name").alias("rules"), r(count_if(~F.col("passed")) * 100.0 / F.count("*"), 2).alias("failed_pct"), r(count_if(F.col("metric_value") < 0.3) * 100.0 / F.count("*"), 2).alias("low_confidence_pct"))


def performance_by(metrics: DataFrame, key: str, since: str) -> DataFrame:
    """Mean confidence and rows by rule or analysis since a day (a partition filter on created_at)."""
    return metrics.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).groupBy(key).agg(r(F.avg("metric_value")).alias("avg_confidence"), F.count("*").alias("n"))


def duplicate_keys(metrics: DataFrame, keys: tuple[str, ...] = ("chunk_id", "rule_name", "ruleset_version")) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def stale_versions(metrics: DataFrame, current: str) -> DataFrame:
    return metrics.filter(F.col("ruleset_version") != current).groupBy("ruleset_version").agg(F.count("*").alias("n"))


def stale_runs(metrics: DataFrame, as_of: str, days: int) -> DataFrame:
    newest = metrics.groupBy("analysis_id").agg(F.max("created_at").alias("newest"), F.count("*").alias("n"))
    return newest.filter(F.to_date("newest") < F.date_sub(F.lit(as_of).cast("date"), days))


def top_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The n chunks with most tokens; a top-k per task and one merge."""
    return chunks.select("chunk_id", F.greatest(F.lit(1), F.floor(F.length("text_content") / 4)).alias("tokens")).orderBy(F.desc("tokens"), "chunk_id").limit(n)


def ingestion_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("started_at").alias("day"), "source_type").agg(F.count("*").alias("runs"), F.sum("rows_written").alias("rows_written"))


def token_stats(chunks: DataFrame) -> DataFrame:
    t = F.greatest(F.lit(1), F.floor(F.length("text_content") / 4))
    return chunks.groupBy("source").agg(r(F.avg(t)).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), r(F.stddev_samp(t)).alias("sd_tokens"))


def missing_fields(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(count_if(F.col("text_content").isNull() | (F.length("text_content") < 20)).alias("short_content"), count_if(F.col("chunk_id").isNull() | (F.col("chunk_id") == "")).alias("missing_id"), count_if(~F.sha2("text_content", 256).rlike("^[0-9a-f]{64}$")).alias("bad_hash"), F.count("*").alias("n"))


def recent_runs(log: DataFrame, n: int = 20) -> DataFrame:
    return log.select("run_id", "source_type", "status", "started_at", r(F.col("processing_duration_ms") / 1000).alias("seconds")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def table_quality(chunks: DataFrame, short: int = 10) -> DataFrame:
    """1 - (null ids + rows beyond the distinct ids + short texts) / rows, at least 0; an empty table is perfect."""
    a = chunks.agg(F.count("*").alias("n"), count_if(F.col("chunk_id").isNull()).alias("null_ids"), (F.count("*") - F.count_distinct("chunk_id")).alias("duplicate_ids"), count_if(F.length("text_content") < short).alias("short_texts"))
    share = F.try_divide(F.col("null_ids") + F.col("duplicate_ids") + F.col("short_texts"), F.col("n"))
    return a.withColumn("quality", r(F.greatest(F.lit(0.0), 1 - F.coalesce(share, F.lit(0.0)))))


def acceptance_rollup(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("analysis_id").agg(F.count("*").alias("results"), F.count_distinct("artifact_type").alias("types"), F.count_distinct("rule_name").alias("rules"), r(F.avg("metric_value")).alias("avg_confidence"), F.count_distinct("severity").alias("severities"))
