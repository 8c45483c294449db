"""Vector search, checks and statistics over ``vectors(chunk_id, model, embedding, artifact_type, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_K = 1000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for a zero vector, whose cosine with anything is then 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "COSINE":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "DOT_PRODUCT":
        return -dot(a, b)
    if metric == "EUCLIDEAN":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    raise ValueError(f"unknown metric {metric}")


def close_enough(metric: str, threshold: float) -> Column:
    """COSINE and DOT_PRODUCT thresholds are least similarities, EUCLIDEAN's is the largest distance."""
    d = F.col("distance")
    return {"COSINE": 1 - d >= threshold, "DOT_PRODUCT": -d >= threshold, "EUCLIDEAN": d <= threshold}[metric]


def checked(query: list[float], k: int) -> Column:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be 1 to {MOST_K}")
    if not any(query):
        raise ValueError("a query vector must not be zero")
    return F.array(*[F.lit(float(x)) for x in query])


def vector_search(vectors: DataFrame, query: list[float], k: int, types: list[str] | None = None, threshold: float | None = None, metric: str = "COSINE", sources: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """The k nearest, then filters by type, source and threshold (may leave fewer); with ``prefilter`` the types come first.

    Distances are rounded to ten digits before ordering, so ties fall to the smaller id on any engine. The top-k runs in each task,
    with one small merge.
    """
    q = checked(query, k)
    kinds = F.col("artifact_type").isin(*types) if types else F.lit(True)
    rows = vectors.filter(kinds) if prefilter else vectors
    found = rows.withColumn("distance", F.round(distance(F.col("embedding"), q, metric), 10)).drop("embedding").orderBy("distance", "chunk_id").limit(k)
    found = found.filter(kinds)
    if sources:
        found = found.filter(F.col("source").isin(*sources))
    if threshold is not None:
        found = found.filter(close_enough(metric, threshold))
    return found


def coerce_dims(vectors: DataFrame, dims: int) -> DataFrame:
    """Longer vectors are cut, shorter ones padded with zeros."""
    v = F.col("embedding")
    padded = F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dims - F.size(v))))
    return vectors.withColumn("embedding", F.slice(padded, 1, dims))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def validate_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    v = F.col("embedding")
    return vectors.select("chunk_id", (F.size(v) == dims).alias("right_size"), finite(v).alias("finite"), F.coalesce((F.size(v) == dims) & finite(v), F.lit(False)).alias("valid"))


def embedding_stats(vectors: DataFrame, dims: int) -> DataFrame:
    n = F.size("embedding")
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_distinct("chunk_id").alias("chunk_ids"), F.count_distinct("model").alias("models"), F.count_distinct("artifact_type").alias("types"),
        F.count_if(n == dims).alias("valid_dims"), F.count_if(n != dims).alias("invalid_dims"), F.round(F.avg(n), 6).alias("avg_dims"), F.round(F.sum(n) * 8 / 1048576, 6).alias("megabytes"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def dims_histogram(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


def dedup_stats(chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy(F.sha2("text_content", 256).alias("h")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("hashes"), F.count_if(F.col("n") > 1).alias("repeated_hashes"), F.sum(F.col("n") - 1).alias("calls_saved"), F.round(F.sum(F.col("n") - 1) * 100.0 / F.sum("n"), 6).alias("saved_pct"), F.round(F.avg("n"), 6).alias("avg_copies"), F.max("n").alias("max_copies"))


def duplicate_hashes(chunks: DataFrame, n: int = 10) -> DataFrame:
    per = chunks.groupBy(F.sha2("text_content", 256).alias("content_hash")).agg(F.count("*").alias("copies"))
    return per.filter("copies > 1").orderBy(F.desc("copies"), "content_hash").limit(n)


def validate_embeddings_batch(vectors: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """Totals, invalid, repeated and orphaned vectors, and health in percent, as one row."""
    base = vectors.agg(F.count("*").alias("total"), F.count_if((F.size("embedding") != dims) | ~finite(F.col("embedding"))).alias("invalid"))
    again = vectors.groupBy("chunk_id", "model").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    lost = vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").agg(F.count("*").alias("orphans"))
    out = base.join(F.broadcast(again)).join(F.broadcast(lost))
    bad = F.col("invalid") + F.col("duplicates") + F.col("orphans")
    return out.withColumn("health_pct", F.round(F.greatest(F.lit(0.0), 100 - F.try_divide(bad * 100.0, F.col("total"))), 6))


def list_embeddings(vectors: DataFrame, types: list[str], limit: int, offset: int) -> DataFrame:
    """A page of vectors, newest first, with the total and whether there are pages before and after."""
    rows = vectors.filter(F.col("artifact_type").isin(*types))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("created_at"), F.desc("chunk_id")).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumns({"has_next": F.col("total") > offset + limit, "has_previous": F.lit(offset > 0)})


def get_embedding(vectors: DataFrame, chunk_id: str) -> DataFrame:
    """The vector of one chunk; an error if there is none."""
    rows = vectors.filter(F.col("chunk_id") == chunk_id)
    if not rows.limit(1).count():
        raise KeyError(chunk_id)
    return rows


def count_embeddings(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("artifact_type").agg(F.count("*").alias("n"))


def count_classes(vectors: DataFrame) -> DataFrame:
    kind = F.col("artifact_type")
    return vectors.agg(F.count_if(kind.isin("fastapi", "cobol", "mumps")).alias("code"), F.count_if(kind.isin("irs")).alias("documentation"), F.count_if(~kind.isin("fastapi", "cobol", "mumps", "irs")).alias("other"))


def similarity_correlation(before: DataFrame, after: DataFrame, sample: int = 1000) -> DataFrame:
    """Pearson correlation of pairwise cosines before and after a reduction, over pairs of at most ``sample`` vectors, drawn by a hash of the id."""
    some = before.select("chunk_id", F.col("embedding").alias("a")).join(after.select("chunk_id", F.col("embedding").alias("b")), "chunk_id").orderBy(F.md5(F.col("chunk_id").cast("binary")), "chunk_id").limit(sample)
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, F.col("x.chunk_id") < F.col("y.chunk_id"))  # bounded: sample * sample / 2 pairs

    def cosine(c: str) -> Column:
        u, v = F.col(f"x.{c}"), F.col(f"y.{c}")
        return dot(u, v) / (norm(u) * norm(v))

    return pairs.select(cosine("a").alias("p"), cosine("b").alias("q")).agg(F.round(F.corr("p", "q"), 6).alias("correlation"), F.count("*").alias("pairs"))


def probe_index(text: Column, dims: int) -> Column:
    """Sum of the text's UTF-8 bytes modulo the dimension."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8")), F.lit(".."), F.lit(0))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long"))
    return F.pmod(total, F.lit(dims)).cast("int")


def text_probe_embedding(text: Column, dims: int = 768) -> Column:
    """A one-hot vector whose place is ``probe_index``: repeatable without any model."""
    at = probe_index(text, dims)
    return F.concat(F.array_repeat(F.lit(0.0), at), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), dims - 1 - at))


def search_text(vectors: DataFrame, text: str, k: int, dims: int) -> DataFrame:
    """Search by text: its probe vector against the stored ones."""
    if len(text) < 3:
        raise ValueError("a search text has at least three characters")
    at = sum(text.encode()) % dims
    return vector_search(vectors, [float(i == at) for i in range(dims)], k)
