"""Registered vector queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gapline.operators import ml as M
from gapline.operators import neighbors as N
from gapline.operators import vectors as V
from gapline.registry import query
from gapline.sources.shared import exists, shared_folder

#: A fixed unit query of the test vectors' width.
Q = [round(math.sin(i + 1) / 5.7, 6) for i in range(64)]
#: Recall, as measured when the index is made, that the searches are set to: above 0.9, as ten probes differ from the mean.
AIM = 0.995
QL = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"


def s_dot(a: str, b: str) -> str:
    return f"coalesce(list_sum([CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE) FOR z IN list_zip([CAST(y AS DOUBLE) FOR y IN {a}], [CAST(y AS DOUBLE) FOR y IN {b}])]), 0)"


def s_norm(a: str) -> str:
    return f"coalesce(nullif(sqrt({s_dot(a, a)}), 0), 1)"


COS = f"round(1 - {s_dot('embedding', QL)} / ({s_norm('embedding')} * {s_norm(QL)}), 10)"
TOP = f"(SELECT chunk_id, artifact_type, label, {COS} AS distance FROM vectors ORDER BY distance, chunk_id LIMIT 50)"


@query("vector_search", f"SELECT * FROM {TOP} WHERE artifact_type IN ('cobol', 'irs') AND 1 - distance >= 0.05", "vectors")
def _(t):
    return V.vector_search(t.vectors.drop("model"), Q, 50, ["cobol", "irs"], 0.05)


@query("vector_search_prefilter", f"""
  SELECT * FROM (SELECT chunk_id, artifact_type, label, {COS} AS distance FROM vectors WHERE artifact_type IN ('cobol', 'irs') ORDER BY distance,
    chunk_id LIMIT 20) WHERE 1 - distance >= 0.05
""", "vectors")
def _(t):
    return V.vector_search(t.vectors.drop("model"), Q, 20, ["cobol", "irs"], 0.05, prefilter=True)


EUCLID = f"round(sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip([CAST(y AS DOUBLE) FOR y IN embedding], {QL})])), 10)"


@query("vector_metrics", f"""
SELECT 'COSINE' AS metric, chunk_id, distance FROM (SELECT chunk_id, {COS} AS distance FROM vectors ORDER BY distance, chunk_id LIMIT 30)
  WHERE 1 - distance >= 0.1
UNION ALL SELECT 'DOT_PRODUCT', chunk_id, distance FROM (SELECT chunk_id, round(-{s_dot('embedding', QL)}, 10) AS distance FROM vectors
  ORDER BY distance, chunk_id LIMIT 30) WHERE -distance >= 0.1
UNION ALL SELECT 'EUCLIDEAN', chunk_id, distance FROM (SELECT chunk_id, {EUCLID} AS distance FROM vectors ORDER BY distance, chunk_id LIMIT 30)
  WHERE distance <= 1.4
""", "vectors")  # fmt: skip
def _(t):
    parts = [V.vector_search(t.vectors, Q, 30, threshold=x, metric=m).select(F.lit(m).alias("metric"), "chunk_id", "distance") for m, x in (("COSINE", 0.1), ("DOT_PRODUCT", 0.1), ("EUCLIDEAN", 1.4))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def probes(t):
    return t.probes.join(t.embeddings.select("vec_id", F.col("embedding").alias("probe")), "vec_id").select("rule_name", "probe")


SIM = f"round({s_dot('v.embedding', 'e.embedding')} / ({s_norm('v.embedding')} * {s_norm('e.embedding')}), 6)"


@query("semantic_candidates", f"""
  SELECT * FROM (SELECT rule_name, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY rule_name ORDER BY similarity DESC,
    chunk_id) AS INT) AS neighbor_rank FROM (SELECT p.rule_name, v.chunk_id, {SIM} AS similarity FROM vectors v, probes p
    JOIN embeddings e ON e.vec_id = p.vec_id) WHERE similarity >= 0.1) WHERE neighbor_rank <= 8
""", "vectors", "probes")
def _(t):
    return N.semantic_candidates(t.vectors, probes(t), 8, 0.1)


@query("search_sources", f"""
  SELECT c.chunk_id, c.source, t.distance FROM (SELECT chunk_id, {COS} AS distance FROM vectors ORDER BY distance, chunk_id LIMIT 100) t
    JOIN chunks c ON c.chunk_id = t.chunk_id WHERE c.source IN ('src1', 'src2', 'src3')
""", "chunks", "vectors")
def _(t):
    found = V.vector_search(t.vectors.select("chunk_id", "embedding", "artifact_type"), Q, 100)
    return found.join(t.chunks.select("chunk_id", "source"), "chunk_id").filter(F.col("source").isin("src1", "src2", "src3")).select("chunk_id", "source", "distance")


def index(t) -> N.Index:
    """The search index of this table, made by the first query that needs it and found by later ones of any session."""
    about = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")
    mark = t.embeddings.select(about).distinct().agg(F.bit_xor("h")).first()[0] or 0
    path = f"{shared_folder(t.spark)}/vector-index-measured-{mark & (1 << 64) - 1:x}"
    if exists(t.spark, f"{path}/model/_SUCCESS"):
        return N.Index(t.spark, path)
    return N.Index.write(t.vectors, path)


@query("vector_search_ann")
def _(t):
    asked = t.spark.createDataFrame([("q", Q)], "rule_name string, probe array<double>")
    return index(t).search(asked, 10, recall=AIM)


@query("ann_recall", "SELECT true AS enough, CAST(count(*) * least(10, (SELECT count(*) FROM vectors)) AS BIGINT) AS exact FROM probes", "vectors", "probes")
def _(t):
    """Whether nine of ten exact neighbours of the probes were found, and how many there are."""
    asked = probes(t)
    found = N.recall(N.semantic_candidates(t.vectors, asked, 10, -2.0), index(t).search(asked, 10, recall=AIM))
    return found.select((F.col("recall") >= 0.9).alias("enough"), "exact")


@query("coerce_dims", "SELECT chunk_id, CAST(len(embedding) AS INT) AS dims, round(embedding[1], 6) AS first_value, round(embedding[32], 6) AS last_value FROM vectors", "vectors")
def _(t):
    v = V.coerce_dims(t.vectors, 32)
    wide = V.coerce_dims(t.vectors, 64)
    return v.select("chunk_id", F.round(F.element_at("embedding", 1).cast("float"), 6).alias("first_value"), F.round(F.element_at("embedding", 32).cast("float"), 6).alias("last_value")).join(wide.select("chunk_id", F.size("embedding").alias("dims")), "chunk_id")


@query("validate_vectors", """
  SELECT chunk_id, len(v) = 64 AS right_size, f AS finite, f AND len(v) = 64 AS valid FROM (SELECT *,
    len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AS f FROM (SELECT chunk_id, CASE CAST(chunk_id AS BIGINT) % 7
    WHEN 1 THEN list_append(embedding[1:63], 'nan'::DOUBLE) WHEN 2 THEN list_append(embedding[1:63], NULL)
    WHEN 3 THEN embedding[1:60] ELSE embedding END AS v FROM vectors))
""", "vectors")
def _(t):
    own, short = F.col("chunk_id").cast("long") % 7, F.slice(V.doubles(F.col("embedding")), 1, 63)
    changed = F.when(own == 1, F.array_append(short, F.lit(float("nan")))).when(own == 2, F.array_append(short, F.lit(None).cast("double"))).when(own == 3, F.slice(V.doubles(F.col("embedding")), 1, 60)).otherwise(V.doubles(F.col("embedding")))
    return V.validate_vectors(t.vectors.withColumn("embedding", changed), 64)


@query("embedding_stats", """
  SELECT count(*) AS vectors, count(DISTINCT chunk_id) AS chunk_ids, count(DISTINCT model) AS models, count(DISTINCT artifact_type) AS types,
    count(*) FILTER (len(embedding) = 64) AS valid_dims, count(*) FILTER (len(embedding) <> 64) AS invalid_dims, round(avg(len(embedding)),
    6) AS avg_dims, round(sum(len(embedding)) * 8 / 1048576.0::DOUBLE, 6) AS megabytes, min(made) AS first_at, max(made) AS last_at FROM (SELECT *,
    TIMESTAMP '2024-01-01 00:00:00' + CAST(chunk_id AS BIGINT) * INTERVAL '1' MINUTE AS made FROM vectors)
""", "vectors")
def _(t):
    return V.embedding_stats(t.vectors.withColumn("created_at", F.expr("TIMESTAMP '2024-01-01 00:00:00' + CAST(chunk_id AS BIGINT) * INTERVAL '1' MINUTE")), 64)


@query("dims_histogram", "SELECT CAST(len(embedding) AS INT) AS dims, count(*) AS n FROM vectors GROUP BY 1", "vectors")
def _(t):
    return V.dims_histogram(t.vectors)


@query("dedup_stats", """
  SELECT count(*) AS hashes, count(*) FILTER (n > 1) AS repeated_hashes, CAST(sum(n - 1) AS BIGINT) AS calls_saved,
    round(sum(n - 1) * 100.0::DOUBLE / sum(n), 6) AS saved_pct, round(avg(n), 6) AS avg_copies, max(n) AS max_copies
    FROM (SELECT sha256(text_content) AS h, count(*) AS n FROM chunks GROUP BY 1)
""", "chunks")
def _(t):
    return V.dedup_stats(t.chunks)


@query("duplicate_hashes", "SELECT sha256(text_content) AS content_hash, count(*) AS copies FROM chunks GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, content_hash LIMIT 10", "chunks")
def _(t):
    return V.duplicate_hashes(t.chunks)


@query("validate_embeddings_batch", """
SELECT *, round(greatest(0, 100 - (invalid + duplicates + orphans) * 100.0::DOUBLE / total), 6) AS health_pct FROM (SELECT count(*) AS total,
  count(*) FILTER (len(embedding) <> 64) AS invalid,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM vectors GROUP BY chunk_id, model)) AS duplicates, (SELECT count(*)
    FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE source <> 'src5')) AS orphans FROM vectors)
""", "chunks", "vectors")  # fmt: skip
def _(t):
    return V.validate_embeddings_batch(t.vectors, t.chunks.filter("source <> 'src5'"), 64)


@query("list_embeddings", """
  SELECT chunk_id, artifact_type, (SELECT count(*) FROM vectors WHERE artifact_type IN ('irs', 'mumps')) AS total, (SELECT count(*) FROM vectors
    WHERE artifact_type IN ('irs', 'mumps')) > 40 AS has_next, true AS has_previous FROM vectors WHERE artifact_type IN ('irs', 'mumps') ORDER BY
    CAST(chunk_id AS BIGINT) DESC LIMIT 20 OFFSET 20
""", "vectors")
def _(t):
    rows = t.vectors.withColumn("created_at", F.col("chunk_id").cast("long")).drop("embedding", "label", "model")
    return V.list_embeddings(rows, ["irs", "mumps"], 20, 20).drop("created_at")


@query("get_embedding", "SELECT chunk_id, label FROM vectors WHERE chunk_id = '7'", "vectors")
def _(t):
    return V.get_embedding(t.vectors.select("chunk_id", "label"), "7")


@query("count_embeddings", "SELECT artifact_type, count(*) AS n FROM vectors GROUP BY artifact_type", "vectors")
def _(t):
    return V.count_embeddings(t.vectors)


@query("count_classes", """
  SELECT count(*) FILTER (artifact_type IN ('fastapi', 'cobol', 'mumps')) AS code, count(*) FILTER (artifact_type = 'irs') AS documentation,
    count(*) FILTER (artifact_type NOT IN ('fastapi', 'cobol', 'mumps', 'irs')) AS other FROM vectors
""", "vectors")
def _(t):
    return V.count_classes(t.vectors)


def s_cos(a: str, b: str) -> str:
    return f"{s_dot(a, b)} / ({s_norm(a)} * {s_norm(b)})"


@query("similarity_correlation", f"""
  WITH sm AS (SELECT chunk_id, embedding AS a, embedding[1:48] AS b FROM vectors ORDER BY md5(chunk_id), chunk_id LIMIT 1000) SELECT
    round(corr({s_cos('x.a', 'y.a')}, {s_cos('x.b', 'y.b')}), 6) AS correlation, count(*) AS pairs FROM sm x JOIN sm y ON x.chunk_id < y.chunk_id
""", "vectors")
def _(t):
    return V.similarity_correlation(t.vectors, V.coerce_dims(t.vectors, 48))


NEAR = """
  (SELECT rule_name, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY similarity DESC, chunk_id) AS n
    FROM (SELECT p.rule_name, v.chunk_id, round({0}, 6) AS similarity FROM vectors v, probes p JOIN embeddings e ON e.vec_id = p.vec_id)) WHERE n <= 10)
"""


@query("neighbor_preservation", f"""
  SELECT round(count(b.chunk_id)::DOUBLE / count(*), 6) AS preservation FROM {NEAR.format(s_cos('v.embedding', 'e.embedding'))} a LEFT
    JOIN {NEAR.format(s_cos('v.embedding[1:48]', 'e.embedding[1:48]'))} b USING (rule_name, chunk_id)
""", "vectors", "probes")
def _(t):
    named = t.probes.select("rule_name", F.col("vec_id").cast("string").alias("chunk_id"))
    return N.neighbor_preservation(t.vectors, V.coerce_dims(t.vectors, 48), named)


@query("text_probe_embedding", """
  SELECT chunk_id, CAST(coalesce(list_sum([CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(coalesce(text_content, ''))), '..')]),
    0) % 768 AS INT) AS place FROM chunks
""", "chunks")
def _(t):
    v = V.text_probe_embedding(F.coalesce("text_content", F.lit("")))
    return t.chunks.select("chunk_id", (F.array_position(v, F.lit(1.0)) - 1).cast("int").alias("place"))


@query("search_text", f"""
  SELECT chunk_id, artifact_type, round(1 - CAST(embedding[{sum(b'deployment guide') % 64 + 1}] AS DOUBLE) / {s_norm('embedding')}, 10) AS distance
    FROM vectors ORDER BY distance, chunk_id LIMIT 10
""", "vectors")
def _(t):
    return V.search_text(t.vectors.select("chunk_id", "artifact_type", "embedding"), "deployment guide", 10, 64)


def s_scaled(place: int) -> str:
    x = f"CAST(embedding[{place}] AS DOUBLE)"
    return f"round(round(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER (), 10), 6) + 0"


@query("scale_vectors", f"SELECT chunk_id, CAST(len(embedding) AS INT) AS dims, {s_scaled(1)} AS first_value, {s_scaled(64)} AS last_value FROM vectors", "vectors")
def _(t):
    def shown(place):
        return F.round(F.round(F.element_at("embedding", place), 10), 6) + 0

    return M.scale_vectors(t.vectors).select("chunk_id", F.size("embedding").alias("dims"), shown(1).alias("first_value"), shown(64).alias("last_value"))


@query("pca_fit")
def _(t):
    return M.pca_report(M.fit_pca(t.vectors, 32), t.spark)


@query("pca_transform", "SELECT chunk_id, 16 AS dims, true AS no_longer FROM vectors", "vectors")
def _(t):
    """Reduced vectors: as many components as asked for, and none longer than the centred vector, as components are orthogonal."""
    model = M.fit_pca(t.vectors, 16, 2.0)
    centred = F.zip_with(V.doubles(F.col("embedding")), F.array(*map(F.lit, model.means)), lambda x, m: x - m)
    rows = M.pca_transform(t.vectors.withColumn("whole", V.dot(centred, centred)), model)
    return rows.select("chunk_id", F.size("embedding").alias("dims"), (V.dot(F.col("embedding"), F.col("embedding")) <= F.col("whole") + 1e-9).alias("no_longer"))


@query("pca_reconstruct")
def _(t):
    return M.reconstruction_error(t.vectors, M.fit_pca(t.vectors, 16))


@query("quality_report", """
WITH g AS (SELECT count(*) AS total, count(*) FILTER (status = 'completed')::DOUBLE / count(*) AS s, avg(processing_duration_ms) AS ms FROM ingestion_log)
SELECT total, round(s, 6) AS success_rate, 0.85::DOUBLE AS similarity_score, round(1000 / ms, 6) AS per_second, round(least(1, 1000 / ms / 100),
  6) AS throughput_score, concat_ws('; ', CASE WHEN s < 0.95 THEN 'investigate failed records' END, 'adjust dimension reduction') AS recommendation
  FROM g
""", "ingestion_log")  # fmt: skip
def _(t):
    return M.quality_report(t.ingestion_log, 0.85)


@query("embed_texts", """
  SELECT chunk_id, sha256(text_content) AS content_hash, 256 AS dims, CAST(len(regexp_extract_all(lower(text_content),
    '[a-z_][a-z0-9_]{2,}')) AS DOUBLE) AS words FROM chunks WHERE text_content IS NOT NULL
""", "chunks")
def _(t):
    """A vector's values add up to the words of its text."""
    rows = M.embed_texts(t.chunks.filter("text_content is not null"), 256)
    return rows.select("chunk_id", "content_hash", F.size("embedding").alias("dims"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("words"))
