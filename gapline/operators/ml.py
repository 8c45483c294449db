"""Spark ML over vectors: cells for approximate search, scaling, principal components, text embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.functions import text as T
from gapline.operators.neighbors import semantic_candidates
from gapline.operators.vectors import doubles, dot, norm

#: Rows that cells and components are fitted on; every row is indexed and transformed.
FIT_ROWS = 100_000
#: Cells, and cells that a query looks into. Vectors without clusters need most cells for a recall of 0.9 (see ``recall``).
CELLS, PROBED = 16, 13
#: Bits of a sign code, the share of all vectors whose codes are nearest that is compared in full, and the least number of them.
BITS, SHARE, LEAST = 256, 0.1, 200


def as_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(doubles(F.col("embedding"))))


def sampled(vectors: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id."""
    total = vectors.count()
    if total <= rows:
        return vectors
    return vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def fit_cells(vectors: DataFrame, cells: int, rows: int = FIT_ROWS) -> list[list[float]]:
    """Cell centres on unit vectors, fitted on a bounded sample."""
    if not 1 <= cells <= 5000:
        raise ValueError("1 to 5000 cells")
    unit = sampled(vectors, rows).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding"))))
    model = KMeans(k=cells, seed=7, maxIter=10).fit(as_vectors(unit).select("features"))
    return [c.tolist() for c in model.clusterCenters()]


def with_cells(vectors: DataFrame, centres: list[list[float]], nearest: int = 1) -> DataFrame:
    """One row for each of the ``nearest`` cells of each vector."""
    table = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    near = F.transform(table, lambda c, i: F.struct((-dot(F.col("embedding"), c)).alias("d"), i.cast("int").alias("cell")))
    return vectors.withColumn("cell", F.explode(F.transform(F.slice(F.array_sort(near), 1, nearest), lambda x: x["cell"])))


def search_cells(vectors: DataFrame, centres: list[list[float]], queries: list[tuple[str, list[float]]] | DataFrame, k: int, probed: int) -> DataFrame:
    """Approximate top-k: queries are joined to the vectors of their ``probed`` nearest cells only."""
    spark = vectors.sparkSession
    asked = queries if isinstance(queries, DataFrame) else spark.createDataFrame(queries, "rule_name string, probe array<double>")
    asked = with_cells(asked.withColumnRenamed("probe", "embedding"), centres, probed).withColumnRenamed("embedding", "probe")
    pairs = with_cells(vectors, centres).join(asked, "cell")
    similar = pairs.select("rule_name", "chunk_id", F.round(dot(F.col("embedding"), F.col("probe")) / (norm(F.col("embedding")) * norm(F.col("probe"))), 6).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("rule_name").orderBy(F.desc("similarity"), "chunk_id"))
    return similar.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def recall(vectors: DataFrame, probes: DataFrame, k: int, cells: int, probed: int) -> DataFrame:
    """Share of the exact k nearest that the approximate search finds."""
    exact = semantic_candidates(vectors, probes, k, -2.0).select("rule_name", "chunk_id")
    found = search_cells(vectors, fit_cells(vectors, cells), probes, k, probed).select("rule_name", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["rule_name", "chunk_id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"), F.count("*").alias("exact"))


def sign_codes(embedding: Column, bits: int = BITS, seed: int = 7) -> Column:
    """array<bigint>: on which side of ``bits`` random planes a vector lies; null for a null vector or one with nulls or NaN.

    The planes follow from the seed and the width alone, so every task and every later query makes the same ones.
    """

    @F.pandas_udf("array<bigint>")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        for vectors in parts:
            out = pd.Series([None] * len(vectors), dtype=object)
            width = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy(int)
            for w in np.unique(width[width >= 0]).tolist():
                if w not in planes:
                    planes[w] = np.random.default_rng(seed).standard_normal((bits, w))
                at = np.flatnonzero(width == w)
                rows = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in at])
                fine = ~np.isnan(rows).any(axis=1)
                # One matrix product for all vectors of a width.
                codes = np.packbits(rows[fine] @ planes[w].T > 0, axis=1).view(np.int64)
                for i, c in zip(at[fine].tolist(), codes, strict=True):
                    out.iat[i] = c
            yield out

    return code(embedding)


def write_index(vectors: DataFrame, path: str, bits: int = BITS) -> DataFrame:
    """The search index of ``vectors(chunk_id, embedding)``: a table, made once, that holds the code and length of each vector.

    Returns the table; later jobs read it from its path.
    """
    if bits % 64:
        raise ValueError("bits come in multiples of 64")
    rows = vectors.select("chunk_id", "embedding", sign_codes(F.col("embedding"), bits).alias("code"), norm(F.col("embedding")).alias("length"))
    rows.filter("code is not null").write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def search_index(index: DataFrame, probes: DataFrame, k: int, share: float = SHARE, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """Approximate top-k of each probe(rule_name, probe): rule_name, chunk_id, similarity, neighbor_rank.

    Codes are compared by their differing bits, in the JVM. How many vectors lie at each number of bits is counted first (a few
    hundred rows for each probe, and only the codes are read); from it follows the distance within which ``share`` of all vectors
    lie, at least ``least`` of them, and those are compared in full. ``probes`` is a stated set of queries, broadcast to the index.
    """
    asked = probes.select("rule_name", "probe", sign_codes(F.col("probe"), bits).alias("asked"), norm(F.col("probe")).alias("asked_length")).filter("asked is not null")
    apart = F.aggregate(F.zip_with("code", "asked", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    counted = index.select("code").join(F.broadcast(asked.select("rule_name", "asked"))).groupBy("rule_name", apart.alias("apart")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("rule_name").orderBy("apart"))
    counted = counted.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy("rule_name"))})
    enough = F.col("upto") >= F.least("all", F.greatest(F.lit(max(least, k)), F.col("all") * share))
    edges = counted.filter(enough).groupBy("rule_name").agg(F.min("apart").alias("edge"))
    near = index.join(F.broadcast(asked.join(edges, "rule_name")), apart <= F.col("edge"))
    similar = near.select("rule_name", "chunk_id", F.round(dot(F.col("embedding"), F.col("probe")) / (F.col("length") * F.col("asked_length")), 6).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("rule_name").orderBy(F.desc("similarity"), "chunk_id"))
    return similar.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def index_recall(vectors: DataFrame, index: DataFrame, probes: DataFrame, k: int, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Share of the exact k nearest that ``search_index`` finds."""
    exact = semantic_candidates(vectors, probes, k, -2.0).select("rule_name", "chunk_id")
    found = search_index(index, probes, k, share, least).select("rule_name", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["rule_name", "chunk_id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"), F.count("*").alias("exact"))


def scale_vectors(vectors: DataFrame) -> DataFrame:
    """Mean 0 and (sample) standard deviation 1 in each dimension."""
    rows = as_vectors(vectors)
    model = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(rows)
    return model.transform(rows).withColumn("embedding", vector_to_array("scaled")).drop("features", "scaled")


@dataclass(frozen=True)
class Reducer:
    """Means, components (one row each) and the share of variance that each explains."""

    means: list[float]
    components: list[list[float]]
    explained: list[float]


def fit_pca(vectors: DataFrame, target: int, variance: float = 0.95, rows: int = FIT_ROWS) -> Reducer:
    """Components up to the first at which ``variance`` is explained, at most ``target``; the model is a few thousand numbers."""
    some = as_vectors(sampled(vectors, rows))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(some)
    width = len(scaler.mean)
    model = PCA(k=min(target, width), inputCol="centred", outputCol="reduced").fit(scaler.transform(some))
    shares = [float(x) for x in model.explainedVariance]
    total, kept = 0.0, 0
    for share in shares:
        kept += 1
        total += share
        if total >= variance:
            break
    matrix = model.pc.toArray()
    return Reducer([float(x) for x in scaler.mean], [[float(x) for x in matrix[:, j]] for j in range(kept)], shares[:kept])


def pca_report(reducer: Reducer, spark: SparkSession) -> DataFrame:
    width, kept = len(reducer.means), len(reducer.components)
    return spark.createDataFrame([(width, kept, round(sum(reducer.explained), 6), round(width / kept, 6))], "dims int, components int, explained double, compression double")


def pca_transform(vectors: DataFrame, reducer: Reducer) -> DataFrame:
    centred = F.zip_with(doubles(F.col("embedding")), F.array(*map(F.lit, reducer.means)), lambda x, m: x - m)
    table = F.array(*[F.array(*map(F.lit, c)) for c in reducer.components])
    return vectors.withColumn("_c", centred).withColumn("embedding", F.transform(table, lambda c: dot(F.col("_c"), c))).drop("_c")


def pca_reconstruct(reduced: DataFrame, reducer: Reducer) -> DataFrame:
    """Back to the full width."""
    columns = [[c[d] for c in reducer.components] for d in range(len(reducer.means))]
    table = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*map(F.lit, c)).alias("c")) for m, c in zip(reducer.means, columns, strict=True)])
    return reduced.withColumn("embedding", F.transform(table, lambda x: x["m"] + dot(F.col("embedding"), x["c"])))


def reconstruction_error(vectors: DataFrame, reducer: Reducer) -> DataFrame:
    back = pca_reconstruct(pca_transform(vectors.select("chunk_id", "embedding"), reducer), reducer).select("chunk_id", F.col("embedding").alias("back"))
    both = vectors.select("chunk_id", "embedding").join(back, "chunk_id")
    error = F.aggregate(F.zip_with(doubles(F.col("embedding")), "back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return both.agg(F.round(F.avg(error), 6).alias("mean_squared_error"), F.count("*").alias("vectors"))


def quality_report(log: DataFrame, similarity: float = 1.0) -> DataFrame:
    """Success rate, similarity kept, throughput against a hundred records a second, and what to do about them."""
    base = log.agg(F.count("*").alias("total"), (F.count_if(F.col("status") == "completed") / F.greatest(F.lit(1), F.count("*"))).alias("s"), F.avg("processing_duration_ms").alias("ms"))
    rate = F.coalesce(F.try_divide(F.lit(1000.0), F.col("ms")), F.lit(0.0))
    failing, lossy = F.col("s") < 0.95, F.lit(similarity < 0.9)
    advice = F.concat_ws("; ", F.when(failing, "investigate failed records"), F.when(lossy, "adjust dimension reduction"), F.when(~failing & ~lossy, "no action"))
    return base.select("total", F.round("s", 6).alias("success_rate"), F.lit(similarity).alias("similarity_score"), F.round(rate, 6).alias("per_second"), F.round(F.least(F.lit(1.0), rate / 100), 6).alias("throughput_score"), advice.alias("recommendation"))


def embed_texts(chunks: DataFrame, dims: int = 768) -> DataFrame:
    """A hashed bag of words for each distinct text (computed once for each hash, joined back to its chunks)."""
    rows = chunks.select("chunk_id", F.sha2("text_content", 256).alias("content_hash"), T.embedding_text(F.col("text_content")).alias("text"))
    once = rows.groupBy("content_hash").agg(F.min("text").alias("text")).withColumn("words", T.word_tokens(F.lower("text")))
    vectors = HashingTF(numFeatures=dims, inputCol="words", outputCol="v").transform(once).select("content_hash", vector_to_array("v").alias("embedding"))
    return rows.select("chunk_id", "content_hash").join(vectors, "content_hash")

