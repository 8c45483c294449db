"""Exact selection, sketches, concurrency, and streams with state."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import selection as Q
from gapline.streaming import jobs as J
from gapline.streaming import requests as R

START = datetime(2024, 1, 1)


def expected(values, ps):
    out, values = [], sorted(values)
    for p in ps:
        x = (len(values) - 1) * p
        a, b = values[int(np.floor(x))], values[int(np.ceil(x))]
        out.append(a if a == b else a * (np.ceil(x) - x) + b * (x - np.floor(x)))
    return out


@pytest.mark.parametrize("leaf", [100_000, 4])
def test_percentiles(spark, monkeypatch, leaf):
    """Even, repeated, geometric and far-out values, one group with most rows."""
    monkeypatch.setattr(Q, "LEAF", leaf)
    monkeypatch.setattr(Q, "BINS", 8 if leaf == 4 else 4096)
    rng = random.Random(1)
    rows = [("even", rng.random() * 100) for _ in range(2000)] + [("same", 7.5)] * 300 + [("powers", 2.0**i) for i in range(-100, 100)] + [("one", 3.0), ("none", None)]
    rows += [("far", x) for x in (1e300, -1e300, *[rng.gauss(0, 1) for _ in range(200)])] + [("ends", x) for x in (float("-inf"), float("inf"), 1.0, 2.0, 2.0)] + [(None, 1.0), (None, 2.0)]
    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: (r["n"], list(r["percentiles"])) for r in Q.exact_percentiles(df, ["k"], "x", ps).collect()}
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k][0] == len(values) and got[k][1] == pytest.approx(expected(values, ps), rel=1e-12), k
    monkeypatch.setattr(Q, "RANGES", 0)
    assert {r["k"]: list(r["percentiles"]) for r in Q.exact_percentiles(df, ["k"], "x", ps).collect()} == {k: p for k, (_, p) in got.items()}
    nan = Q.exact_percentiles(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double"), [], "x", [0.0, 0.5, 1.0]).first()
    assert nan["percentiles"][:2] == [1.0, 2.0] and np.isnan(nan["percentiles"][2])
    assert Q.exact_percentiles(df.limit(0), ["k"], "x", ps).count() == 0


def test_no_task_orders_a_group(spark):
    df = spark.range(1000).select(F.lit("a").alias("endpoint"), F.col("id").cast("double").alias("duration_ms"))
    for out in (R.endpoint_latency(df), R.latency_percentiles(df)):
        assert "percentile" not in out.drop("percentiles")._jdf.queryExecution().optimizedPlan().toString().replace("percentiles", "")
    row = R.latency_percentiles(df).first()
    assert (row["n"], row["p95"], row["p99"]) == (1000, 949.05, 989.01)
    assert tuple(R.latency_percentiles(df.limit(30)).select("n").first()) == (30,) and R.latency_percentiles(df.limit(30)).first()["p99"] is None
    assert tuple(R.latency_percentiles(df.limit(0)).first()) == (0, None, None)


def test_sketches_merge(spark):
    rng = random.Random(2)
    values = [rng.lognormvariate(3, 1) for _ in range(60_000)]
    df = spark.createDataFrame([(START + timedelta(minutes=i % 600), "e", x) for i, x in enumerate(values)], "ts timestamp, endpoint string, duration_ms double")
    sketches = R.latency_sketches(df, error=0.005)
    assert sketches.count() == 10 and sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 60_000
    row = R.merged_percentiles(sketches, ["endpoint"], [0.05, 0.5, 0.99]).first()
    ranks = np.searchsorted(sorted(values), row["percentiles"]) / len(values)
    assert row["requests"] == 60_000 and np.abs(ranks - [0.05, 0.5, 0.99]).max() <= 0.005


def peaks(rows):
    """Hour by hour, from each request as it is."""
    out, hour = {}, timedelta(hours=1)
    for ts, ms in rows:
        if ts is None or ms is None:
            continue
        end = ts + timedelta(milliseconds=ms)
        at = ts.replace(minute=0, second=0, microsecond=0)
        while at <= end:
            out.setdefault(at, []).append((ts, end))
            at += hour
    best = {}
    for at, inside in out.items():
        moments = {at, *(s for s, _ in inside if s >= at)}
        best[at] = max(sum(s <= m and e >= m for s, e in inside) for m in moments)
    return best


def test_peaks(spark):
    """Requests of all lengths, at the same moment, over hours without events, over midnight and days, all in one hour."""
    rng = random.Random(4)
    rows = [(START + timedelta(seconds=rng.randint(0, 4 * 86400), microseconds=rng.choice([0, 0, 500])), float(rng.choice([0, 1, 1000, 3_600_000, 9_000_000]))) for _ in range(150)]
    rows += [(START + timedelta(hours=5), 2 * 86_400_000.0), (START + timedelta(hours=5), 0.0), (START + timedelta(hours=4), 3_600_000.0), (START + timedelta(days=9), 1.0), (None, 1.0)]
    rows += [(START + timedelta(days=12, minutes=7, microseconds=rng.randint(0, 2000)), float(rng.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, duration_ms double")
    got = {r["bucket"]: r["peak"] for r in R.peak_concurrency(df).collect()}
    assert got == peaks(rows)
    assert R.peak_concurrency(df.limit(0)).count() == 0


def request(i, minute, status, endpoint):
    return (i, START + timedelta(minutes=minute), status, endpoint)


SCHEMA = "request_id long, ts timestamp, status_code int, endpoint string"


def test_recent_errors_on_a_stream(spark, tmp_path):
    """Two runs with one checkpoint give the rows of the batch form; a key's state is n rows; a timer empties what is old."""
    path, n = f"file://{tmp_path}", 3
    rng = random.Random(5)
    rows = [request(i, rng.randint(0, 50), rng.choice([200, 500, 404]), rng.choice("ab")) for i in range(60)]
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(name, keep=None):
        with J.stateful(spark):
            stream = spark.readStream.schema(schema).parquet(f"{path}/in")
            J.stream_updates(R.recent_error_lists(stream, n, keep), f"{path}/{name}", f"{path}/{name}-checkpoint")
        return J.latest_metrics(spark.read.parquet(f"{path}/{name}").drop("batch"), ["endpoint"])

    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{path}/in")
        lists = run("lists")
    assert lists.agg(F.max(F.size("errors"))).first()[0] == n
    want = R.recent_errors(spark.createDataFrame(rows, SCHEMA), n).collect()
    assert R.merged_errors(lists, n).collect() == want
    run("timed", timedelta(minutes=30))
    spark.createDataFrame([request(100, 600, 500, "c")], SCHEMA).write.mode("append").parquet(f"{path}/in")
    run("timed", timedelta(minutes=30))
    spark.createDataFrame([request(101, 601, 200, "c")], SCHEMA).write.mode("append").parquet(f"{path}/in")
    timed = {r["endpoint"]: len(r["errors"]) for r in run("timed", timedelta(minutes=30)).collect()}
    assert timed == {"a": 0, "b": 0, "c": 1}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_ingest_reads_its_buckets_only(spark, tmp_path):
    """A batch opens the folders of its own buckets; a repeated batch changes nothing; null hashes are rejected."""
    path = f"file://{tmp_path}"
    schema = "content_hash string, chunk_id string, ts timestamp"
    rows = [(f"h{i % 50}", str(i), START + timedelta(minutes=i)) for i in range(100)] + [(None, "n", START)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{path}/in")
    J.stream_ingest(stream, f"{path}/out", f"{path}/checkpoint", buckets=16)
    late = spark.createDataFrame([("h1", "x", START), ("new", "y", START), ("new", "z", START)], schema).coalesce(1)
    late.write.mode("append").parquet(f"{path}/in")
    J.stream_ingest(stream, f"{path}/out", f"{path}/checkpoint", buckets=16)

    def stored():
        return sorted((r["content_hash"], r["chunk_id"]) for r in spark.read.parquet(f"{path}/out").collect())

    want = sorted([(f"h{i}", min(str(i), str(i + 50))) for i in range(50)] + [("new", "y")])
    assert stored() == want
    known = J.known_hashes(late.withColumn("bucket", J.bucket_of(F.col("content_hash"), 16)), f"{path}/out", 1, [3])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    opened = {f.rsplit("/", 3)[1] for (f,) in known.select("_metadata.file_path").distinct().collect()} if known.count() else {"bucket=3"}
    assert opened == {"bucket=3"}
    # The same batch once more, as after a failure before its commit.
    (tmp_path / "checkpoint/commits/1").unlink()
    for crc in (tmp_path / "checkpoint/commits").glob(".1.crc"):
        crc.unlink()
    J.stream_ingest(stream, f"{path}/out", f"{path}/checkpoint", buckets=16)
    assert stored() == want


def test_redelivered_rows_end_in_the_state(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "content_hash string, chunk_id string, ts timestamp"
    seen = []
    rows = [("a", "1", START), ("b", "2", START + timedelta(minutes=5))]
    for part in (rows, rows + [("c", "3", START + timedelta(minutes=6))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in").withWatermark("ts", R.LATE).dropDuplicatesWithinWatermark(["content_hash", "chunk_id"])
        J.run_available(stream, lambda b, n: seen.append(b.count()), f"{path}/checkpoint")
        J.stream_ingest(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint2", "ts", buckets=4)
    assert [n for n in seen if n] == [2, 1]
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{path}/out").collect()) == ["1", "2", "3"]
