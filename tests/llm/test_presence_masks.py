import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapline.llm import presence_masks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    tallies = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, []).extend(words(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c in tallies:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["Élan", "ÉLAN", "日本語", "don't", "a_b"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return [" ".join(rng.choices(names, weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [1 << 20, 3])
def test_matches_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(presence_masks, "VOCABULARY", vocabulary)
    docs = list(enumerate(corpus(1, 400)))
    items = list(enumerate(corpus(2, 12)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert shown(presence_masks.top_k(df, asked)) == brute(docs, items)
    assert shown(presence_masks.top_k(df, asked, k=3)) == brute(docs, items, k=3)


def test_many_blocks_and_wide_masks(spark, monkeypatch):
    """Blocks of few documents, shards of few postings, items of more than 64 terms over few documents at a time."""
    monkeypatch.setattr(presence_masks, "DOCUMENTS", 37)
    monkeypatch.setattr(presence_masks, "SHARD", 900)
    monkeypatch.setattr(presence_masks, "CELLS", 64 * 90)
    docs = list(enumerate(corpus(3, 300, 300)))
    items = [(0, " ".join(f"w{i}" for i in range(200))), (1, "w0 w0 w1"), (2, " ".join(f"w{i}" for i in range(64)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert shown(presence_masks.top_k(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_search_stops_early():
    """Groups below the k-th score are not evaluated: of 2000 documents with one common term none is looked at after ten with a rare one."""
    texts = ["rare common"] * 10 + ["common"] * 2000
    sizes, places = [10, 2010], list(range(10)) + list(range(2010))
    import numpy as np

    row = {"ids": list(range(2010)), "lengths": np.array([len(t.split()) for t in texts], np.int64).tobytes(), "sizes": sizes, "terms": ["rare", "common"], "places": np.array(places, np.int32).tobytes(), "counts": np.ones(2020, np.int32).tobytes()}
    block = presence_masks.Block(row, 2010, 2020)
    looked = []
    block.ids = type("Ids", (list,), {"__getitem__": lambda self, i: looked.append(i) or list.__getitem__(self, i)})(block.ids)
    best = block.search(["rare", "common"], [5000, 1], 10, [])
    assert [x[2] for x in best] == list(range(10)) and len(looked) <= 10


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "apple pear"), (4, "apple pear"), (5, "apple pear"), (5, "apple pear"), (6, "APPLE " * 5000), (7, "ÀPPLE àpple"), (8, "plum")]
    items = [(1, "Apple pear pear"), (2, None), (3, "?!"), (4, "unknown"), (5, "àpple"), (1, "plum"), (None, "pear")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("words", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("y"))
    assert shown(presence_masks.top_k(df, asked)) == brute(docs, items)
    assert presence_masks.top_k(df.limit(0), asked).count() == 0
    assert presence_masks.top_k(df, asked.limit(0)).count() == 0
