import math

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import maxscore


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def test_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = shown(maxscore.top_k(rows, F.col("vec_id") % 100 == 0))
    assert got == brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_blocks_and_pruning(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)) * np.array([8, 4, 2, 1, 0.5, 0.2, 0.1, 0.05])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 7)
    monkeypatch.setattr(maxscore, "CANDIDATES", 32)
    monkeypatch.setattr(maxscore, "SHARD", 700)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert shown(maxscore.top_k(df, F.col("vec_id") % 10 == 0)) == brute(rows, every=10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (None, [5.0, 5.0]), (7, [-1.0, -1.0]), (200, None), (8, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    assert shown(maxscore.top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert maxscore.top_k(df.filter("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0
