import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.llm import binary_fuse
from gapline.llm.common import Scratch


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 40000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = binary_fuse.BinaryFuse.of(np.concatenate([keys, keys[: n // 2]]))
    assert made.holds(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert made.holds(others).mean() < 0.006
    # About 9 bits a key in large filters; small ones need more, in whole segments.
    assert n < 40000 or len(made.prints) < 1.25 * n


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            out.append((i, keep, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=str)


ROWS = [(1, None), (2, ""), (3, "a"), (9, "a"), (4, "a "), (5, "A"), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "c"), (7, "d"), (8, "x" * 300_000), (10, "x" * 300_000), (11, "x" * 300_000 + "y")]


@pytest.mark.parametrize(("batches", "digits", "keys"), [(1, 64, 0), (2, 64, 0), (2, 64, 500_000), (3, 1, 500_000), (3, 1, 0), (1, 1, 0)])
def test_matches_brute_force(spark, monkeypatch, batches, digits, keys):
    """Also where digests of one digit make different texts collide, within a batch and with snapshots."""
    monkeypatch.setattr(binary_fuse, "BUCKET", 8)
    monkeypatch.setattr(binary_fuse, "KEYS", keys)
    rows = ROWS + [(100 + i, f"text {i * i % 31}") for i in range(120)] + [(1000 + i, "hot") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("digest", F.lit(1)).withColumn("key", F.lit("k"))
    assert shown(binary_fuse.deduplicate(df, batches, lambda sha: F.substring(sha, 1, digits))) == brute(rows)


def test_filters_screen_and_bytes_decide(spark):
    """A new batch: what is absent is screened out, a text of equal digest but other bytes is not known."""
    store = binary_fuse.Store(Scratch(spark, "test"), lambda sha: F.substring(sha, 1, 3))
    texts = [f"t{i}" for i in range(900)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:3]
    store.append(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:300])], "doc_id long, text string"))
    first = {digest(t) for t in texts[:300]}
    asked = spark.createDataFrame([(digest(t),) for t in texts[300:]], "digest string").distinct()
    positive = {r[0] for r in store.snapshots[0].screen(asked).collect()}
    wanted = {digest(t) for t in texts[300:]}
    assert positive >= wanted & first and len(positive - first) < 0.05 * len(wanted - first) + 5
    store.append(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts[200:900])], "doc_id long, text string"))
    assert store.snapshots[0].texts.count() == 300 and store.snapshots[1].texts.count() == 600
    assert store.added[1].filter("digest is null").count() == 100
    sizes = store.classes().groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in sizes} == {1: 800, 2: 100}


def test_empty(spark):
    assert binary_fuse.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
