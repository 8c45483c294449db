"""Request metrics. Each works on a stream or on a batch of ``requests(request_id, endpoint, ts, duration_ms, status_code, ...)``.

On streams, aggregates over windows keep state for ``LATE``; later rows are dropped by the watermark. Exact percentiles and distinct
counts are for batches; ``latency_sketches`` is the mergeable form for streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapline.operators.selection import exact_percentiles, sketch_k

LATE = "60 minutes"


def marked(requests: DataFrame) -> DataFrame:
    return requests.withWatermark("ts", LATE) if requests.isStreaming else requests


def request_counts(requests: DataFrame, every: str = "1 hour") -> DataFrame:
    """Requests of each tumbling window."""
    return marked(requests).groupBy(F.window("ts", every)).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("window_start"), "requests")


def endpoint_latency(requests: DataFrame) -> DataFrame:
    """Requests and durations of each endpoint, with the exact median."""
    base = requests.groupBy("endpoint").agg(F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))
    middle = exact_percentiles(requests, ["endpoint"], "duration_ms", [0.5])
    middle = middle.select(F.col("endpoint").alias("of"), F.round(F.element_at("percentiles", 1), 6).alias("median_ms"))
    return base.join(middle, F.col("endpoint").eqNullSafe(F.col("of")), "left").drop("of")


def latency_percentiles(requests: DataFrame) -> DataFrame:
    """p95 from 20 requests on, p99 from 100 on, by positions (n - 1) p."""
    both = exact_percentiles(requests, [], "duration_ms", [0.95, 0.99]).select("percentiles")
    at = requests.agg(F.count("*").alias("n")).join(both, how="left")  # one row each
    return at.select("n", F.round(F.when(F.col("n") >= 20, F.element_at("percentiles", 1)), 6).alias("p95"), F.round(F.when(F.col("n") >= 100, F.element_at("percentiles", 2)), 6).alias("p99"))


def latency_sketches(requests: DataFrame, every: str = "1 hour", error: float = 0.005) -> DataFrame:
    """A KLL sketch of the durations for each endpoint and window: window_start, endpoint, requests, sketch.

    Sketches have a bounded size, so a stream's state does not grow with its rows, and those of any windows and endpoints can be merged
    (``merged_percentiles``); ranks are off by at most ``error`` of all rows, with 99 % confidence.
    """
    sketch = F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), sketch_k(error))
    grouped = marked(requests).filter("duration_ms is not null").groupBy(F.window("ts", every), "endpoint").agg(F.count("*").alias("requests"), sketch.alias("sketch"))
    return grouped.select(F.col("window.start").alias("window_start"), "endpoint", "requests", "sketch")


def merged_percentiles(sketches: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """``by``, requests and percentiles over all windows of ``latency_sketches``."""
    both = sketches.groupBy(*by).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return both.select(*by, "requests", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ps))).alias("percentiles"))


def error_rate(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.try_divide(F.count_if(F.col("status_code") >= 400), F.count("*")), 6).alias("error_rate"))


def requests_by_status(requests: DataFrame) -> DataFrame:
    """Requests of each status code."""
    return requests.groupBy("status_code").agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"))


def peak_concurrency(requests: DataFrame, per_unit_ms: float = 1.0) -> DataFrame:
    """bucket, peak: most requests in flight at any moment of each hour in which there are any.

    Starts count +1 and ends -1, starts first at the same moment. They are added up by microsecond, and then scanned from level to
    level: moments of a second give its net change and its inner maximum, seconds those of an hour, hours of a day, days of the whole.
    What is in flight before a moment is the sum of what went before on each level, so no window holds more than the moments of a
    second, the seconds of an hour, the hours of a day, or the days, whatever the number of requests, and a long request is not
    repeated for each hour that it spans.
    """
    end = F.col("ts") + F.make_interval(secs=(F.col("duration_ms") * per_unit_ms / 1000).cast("decimal(18,6)"))
    events = requests.select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(end.alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    moments = events.select("e.*").filter("at is not null").groupBy("at").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    level = moments.select("at", (F.col("up") - F.col("down")).alias("net"), F.col("up").alias("top"))
    for unit, upper in (("second", "microsecond"), ("hour", "second")):
        level = _scanned(level.withColumn("within", F.date_trunc(unit, "at")), ["within"]).groupBy("within").agg(F.sum("net").alias("net"), F.max("top").alias("top")).withColumnRenamed("within", "at")
    hours = _scanned(level.withColumn("within", F.date_trunc("day", "at")), ["within"], keep=True)
    days = hours.groupBy("within").agg(F.sum("net").alias("net")).select(F.col("within").alias("day"), _before(F.col("net"), W.orderBy("within")).alias("earlier"))
    hours = hours.join(days, F.col("within") == F.col("day")).select("at", "day", "net", "top", (F.col("before") + F.col("earlier")).alias("carried"))
    peaks = hours.select(F.col("at").alias("bucket"), F.greatest("carried", F.col("top") + F.col("carried")).alias("peak"))
    # Hours without a start or an end in which requests go on: from each day's last hour to the next day's first, and within days.
    following = F.coalesce(F.lead("at").over(W.partitionBy("day").orderBy("at")), F.col("next"))
    nexts = hours.groupBy("day").agg(F.min("at").alias("first")).select("day", F.lead("first").over(W.orderBy("day")).alias("next"))
    gaps = hours.join(nexts, "day").select("at", (F.col("carried") + F.col("net")).alias("peak"), following.alias("following"))
    hour = F.expr("INTERVAL 1 HOUR")
    gaps = gaps.filter((F.col("peak") > 0) & (F.col("at") + hour < F.col("following")))
    return peaks.unionByName(gaps.select(F.explode(F.sequence(F.col("at") + hour, F.col("following") - hour, hour)).alias("bucket"), "peak"))


def _before(net: Column, order) -> Column:
    """The sum of all earlier rows."""
    return F.coalesce(F.sum(net).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _scanned(level: DataFrame, within: list[str], keep: bool = False) -> DataFrame:
    """``top`` of each row above the start of what it is within; with ``keep`` above its own start, and ``before`` beside it."""
    before = _before(F.col("net"), W.partitionBy(*within).orderBy("at"))
    return level.withColumn("before", before) if keep else level.withColumn("top", F.col("top") + before)


def top_values(requests: DataFrame, column: str, n: int) -> DataFrame:
    return requests.groupBy(column).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), column).limit(n)


def unique_clients(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count_distinct("client").alias("clients"), F.count_distinct("user_agent").alias("agents"))


def auth_outcomes(requests: DataFrame) -> DataFrame:
    """Attempts, successes and failures by agent."""
    return requests.groupBy("user_agent").agg(F.count("*").alias("attempts"), F.count_if(F.col("status_code") < 400).alias("successes"), F.round(F.count_if(F.col("status_code") < 400) / F.count("*"), 6).alias("success_rate"))


def auth_failures(requests: DataFrame) -> DataFrame:
    """Failures by ``reason``; those without one are not listed."""
    return requests.filter("status_code >= 400 and reason is not null").groupBy("reason").agg(F.count("*").alias("failures"))


def recent_errors(requests: DataFrame, n: int) -> DataFrame:
    return requests.filter("status_code >= 400").select("request_id", "endpoint", "ts").orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


LISTS = "endpoint string, errors array<struct<micros:bigint,request_id:bigint>>"


class LastErrors(StatefulProcessor):
    """The newest n errors of an endpoint, as state of n rows; with ``keep`` a timer empties a list that nothing was added to for so long."""

    def __init__(self, n: int, keep: timedelta | None):
        self.n, self.keep = n, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("errors", "micros bigint, request_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.rows.get()]
        for part in rows:
            held = sorted([*held, *zip(part["micros"].tolist(), part["request_id"].tolist(), strict=True)], reverse=True)[: self.n]
        self.rows.put(held)
        if self.keep is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(held[0][0] // 1000 + int(self.keep.total_seconds() * 1000))
        yield self.shown(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield self.shown(key, [])

    @staticmethod
    def shown(key, held: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"endpoint": [key[0]], "errors": [[{"micros": t, "request_id": i} for t, i in held]]})

    def close(self) -> None:
        pass


def recent_error_lists(requests: DataFrame, n: int, keep: timedelta | None = None) -> DataFrame:
    """A stream's newest n errors of each endpoint: endpoint, errors, whenever they change; the newest row of an endpoint counts.

    Errors without a time are left out. The state store must be RocksDB (``jobs.stateful``).
    """
    errors = requests.withWatermark("ts", LATE) if keep is not None else requests
    errors = errors.filter("status_code >= 400 and ts is not null").withColumn("micros", F.unix_micros("ts"))
    return errors.groupBy("endpoint").transformWithStateInPandas(statefulProcessor=LastErrors(n, keep), outputStructType=LISTS, outputMode="Update", timeMode="None" if keep is None else "EventTime")


def merged_errors(lists: DataFrame, n: int) -> DataFrame:
    """The newest n errors of all endpoints, from their newest lists: the same rows as ``recent_errors`` of the batch."""
    rows = lists.select("endpoint", F.explode("errors").alias("e")).select("e.request_id", "endpoint", F.timestamp_micros("e.micros").alias("ts"))
    return rows.orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


def performance_alerts(requests: DataFrame, every: str = "1 hour", limit: float = 0.05) -> DataFrame:
    """Windows whose error rate is above the limit. On a stream filter the latest ``window_errors``: a window may fall below it again."""
    return window_errors(requests, every).filter(F.col("error_rate") > limit)


def window_errors(requests: DataFrame, every: str = "1 hour") -> DataFrame:
    rows = marked(requests).groupBy(F.window("ts", every)).agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    return rows.select(F.col("window.start").alias("window_start"), "requests", "errors", F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"))
