"""Joins, upserts and set logic between chunks, vectors and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_new_chunks(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of the batch, one for each content hash (smallest chunk_id), whose hash is not in the target; rows without a hash are rejected."""
    batch = batch.filter("content_hash is not null")
    # min_by combines map-side: a hash that stands in a third of the batch is one row for each task.
    fields = [c for c in batch.columns if c != "content_hash"]
    once = batch.groupBy("content_hash").agg(F.min_by(F.struct(*fields), "chunk_id").alias("r")).select("content_hash", "r.*")
    return once.join(target.select("content_hash"), "content_hash", "left_anti").select(*batch.columns)


def merge_chunks(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the new rows of the batch: MERGE ... WHEN NOT MATCHED THEN INSERT."""
    return target.unionByName(insert_new_chunks(batch, target))


def merge_metrics(batch: DataFrame, target: DataFrame, keys: list[str], version: str) -> DataFrame:
    """MERGE with update: of each key the row with the largest version; the batch wins ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    fields = [c for c in target.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(version, "_new")).alias("r"))
    return newest.select(*keys, "r.*").select(*target.columns)


def pending_chunks(chunks: DataFrame, vectors: DataFrame, model: str, limit: int, where: Column | None = None) -> DataFrame:
    """Chunks without a vector of this model, oldest first."""
    have = vectors.filter(F.col("model") == model).select("chunk_id")
    rows = chunks if where is None else chunks.filter(where)
    return rows.join(have, "chunk_id", "left_anti").orderBy("created_at", "chunk_id").limit(limit)


def chunk_with_embedding(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id", "model", "embedding", "label"), "chunk_id")


def lookup_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of many ids; Spark broadcasts the ids if they are few."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def cross_latest(metrics: DataFrame) -> DataFrame:
    """Rows of the newest analysis: a join with a one-row aggregate."""
    newest = metrics.agg(F.max("analysis_id").alias("newest"))
    return metrics.join(F.broadcast(newest), F.col("analysis_id") == F.col("newest")).drop("newest")


def orphans(rows: DataFrame, parents: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def not_in_cleanup(rows: DataFrame, used: DataFrame, key: str = "chunk_id") -> DataFrame:
    """NOT IN with its null rule: if ``used`` holds a null, nothing qualifies; a null key never does."""
    nulls = used.agg(F.count_if(F.col(key).isNull()).alias("_nulls"), F.count("*").alias("_rows"))
    free = rows.join(used.select(key).distinct(), key, "left_anti")
    return free.join(F.broadcast(nulls)).filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_nulls", "_rows")


def changed_since(rows: DataFrame, done: DataFrame, at: str, done_at: str) -> DataFrame:
    """Rows after the last watermark (all, if there is none)."""
    mark = done.agg(F.max(done_at).alias("_mark"))
    return rows.join(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")


def rule_coverage(chunks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per type: chunks with and without any rule result. Metrics are counted per chunk before the join."""
    counts = metrics.groupBy("chunk_id").agg(F.count("*").alias("results"))
    per = chunks.select("chunk_id", "artifact_type").join(counts, "chunk_id", "left")
    return per.groupBy("artifact_type").agg(F.count("*").alias("chunks"), F.count("results").alias("covered"), F.count_if(F.col("results").isNull()).alias("uncovered"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"))


def embedding_cache_join(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with the cached vector or null, distinct hashes that are missing); ``cache(content_hash, embedding)``."""
    return texts.join(cache, "content_hash", "left"), texts.select("content_hash").distinct().join(cache.select("content_hash"), "content_hash", "left_anti")


def cache_counts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses and the calls that one computation for each distinct hash needs."""
    served, missing = embedding_cache_join(texts, cache)
    return served.agg(F.count("embedding").alias("hits"), F.count_if(F.col("embedding").isNull()).alias("misses")).join(F.broadcast(missing.agg(F.count("*").alias("calls"))))


def embedding_metadata(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors beside their chunks, with dimension and validity."""
    rows = chunks.select("chunk_id", "source", "artifact_type", "created_at", F.sha2("text_content", 256).alias("content_hash")).join(vectors.select("chunk_id", "model", "embedding"), "chunk_id")
    return rows.withColumns({"dims": F.size("embedding"), "valid": (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))}).drop("embedding")


def delete_by_key(rows: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What is left of a table after the keys are deleted (to be written to a new path)."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def expire_partitions(rows: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    return rows.filter(F.col(at) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp"))


def newest_rank(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
