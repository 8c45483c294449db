import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from gapline.llm import mixing


def brute(rows, weights=mixing.WEIGHTS, most=3, seed=7):
    """rows: (doc_id, text, source)"""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[2]].append(i)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
            open_.discard(s)
    out = []
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, run = target[s] - epochs * total[s], 0

        def key(i):
            d, t, _ = rows[i]
            x = int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:12], 16)
            other = len(re.sub(r"[^\W\d_]|[ \t\n\r\f]", "", t or ""))
            q = max(0.05, (1 + len(t or "") - other) / (1 + len(t or "")))
            return -math.log((x + 0.5) / 2**48) / q

        for i in sorted(by[s], key=lambda i: (key(i), rows[i][0] is not None, rows[i][0] or 0, size[i])):
            run += size[i]
            extra = run - size[i] / 2 <= rest
            out.append((str(rows[i][0]), size[i], total[s], round(target[s], 6), size[i] * (epochs + extra)))
    return sorted(out)


def shown(df):
    return sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shown(mixing.mix(docs))
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert got == shown(mixing.mix(docs.repartition(3)))


def test_targets_are_met_and_capped(spark):
    rows = [(i, "word " * (i % 7 + 1), "big") for i in range(300)] + [(1000 + i, "word word", "small") for i in range(5)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {r["source_size"]: r for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("m")).collect()}
    assert by[10]["target"] == by[10]["t"] == 30 and by[10]["m"] == 3
    assert all(abs(r["t"] - r["target"]) <= 7 for r in by.values())


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (None, "x y", "é"), (3, "1 2 3", "é"), (4, "w " * 50_000, "Z"), (5, " \t", None), (6, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(None).cast("int"))
    assert shown(mixing.mix(docs)) == brute(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert shown(mixing.mix(docs.filter("doc_id = 2"))) == [("2", 0, 0, 0.0, 0)] * 2
