"""Incremental jobs: a stream into files, once for each key, with a checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gapline.operators.upsert import insert_new_chunks
from gapline.sources.shared import exists
from gapline.streaming.requests import LATE

Batch = Callable[[DataFrame, int], None]
#: Buckets of an ingest target; it can't be changed for a target that exists.
BUCKETS = 64


def run_available(stream: DataFrame, handle: Batch, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on where this one ended."""
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The groups of a streaming aggregate that each batch changed, in a folder of its own; readers take the newest of each key.

    In update mode the watermark closes windows: their state goes, and rows that come later are dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, write, checkpoint, "update")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, event_time: str | None = None, buckets: int = BUCKETS) -> None:
    """Append rows whose content hash the target has not: exactly once for each hash, also when a batch is repeated.

    With ``event_time``, deliveries of a row (content_hash, chunk_id) that follow within :data:`LATE` of it end in the stream's state
    and never reach the target. The target is dealt into buckets of the hash, one folder for each bucket and batch
    (``bucket=<b>/batch=<id>``). A batch reads the buckets that its hashes fall into, and of those the hashes of earlier batches;
    a repeated batch replaces the folders that it wrote. Rows without a hash can't be told apart and are rejected.
    """
    if event_time is not None:
        stream = stream.withWatermark(event_time, LATE).dropDuplicatesWithinWatermark(["content_hash", "chunk_id"])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter("content_hash is not null").withColumn("bucket", bucket_of(F.col("content_hash"), buckets)).persist()
        try:
            hit = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets, at most
            fresh = insert_new_chunks(rows, known_hashes(rows, path, number, hit))
            fresh.withColumn("batch", F.lit(number)).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        finally:
            rows.unpersist()

    run_available(stream, write, checkpoint)


def bucket_of(content_hash: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(buckets)).cast("int")


def known_hashes(like: DataFrame, path: str, number: int, hit: list[int]) -> DataFrame:
    """content_hash, bucket of what batches before ``number`` wrote into the buckets ``hit``; no other folder is opened."""
    spark = like.sparkSession
    if number == 0 or not hit or not exists(spark, path):
        return spark.createDataFrame([], "content_hash string, bucket int")
    schema = StructType([*[f for f in like.schema.fields if f.name != "bucket"], StructField("bucket", IntegerType()), StructField("batch", IntegerType())])
    return spark.read.option("basePath", path).schema(schema).parquet(path).filter(F.col("bucket").isin(hit) & (F.col("batch") < number)).select("content_hash", "bucket")


def stream_gap_metrics(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Score arriving chunks; each batch's metrics are a folder, readers take the newest of each key (``latest_metrics``)."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, write, checkpoint)


def latest_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "version").alias("r")).select(*keys, "r.*")
