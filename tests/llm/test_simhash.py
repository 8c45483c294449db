import numpy as np
from pyspark.sql import functions as F

from gapline.llm import simhash


def brute(rows, radius=3):
    prints = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            least[i] = min(ids) if ids else None
    return sorted([(str(rows[i][0]), f"{prints[i]:016x}", str(least[i])) for i in range(len(rows))])


def test_spark_hash_is_the_same(spark):
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("ça va bien")).alias("h")).first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("ça va bien".encode(), 42)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_edges(spark):
    long = "w%d " * 3
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "one two"), (2, "one two"), (9, "ONE two"), (None, "one two"), (None, "x y z w"), (7, " ".join(f"w{i}" for i in range(150_000))), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(None).cast("string"))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "2", "None", "None", "7", "8"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, c + "."), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"][0]) for r in simhash.keep_one(docs).collect())
    assert got == [("1", "a"), ("2", "b"), ("4", "c"), ("None", "c")]


def test_every_link_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.add(b ^ int(sum(1 << int(f) for f in flips)))
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    want = {(max(a, b), min(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    for radius_plan in (3,):
        got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius_plan).collect()}
        assert got == want


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_dense_balls(spark, monkeypatch):
    """Thousands of fingerprints around a few: links grow with them and not with their pairs, and components are those of all pairs."""
    rng = np.random.default_rng(11)
    fps = set()
    for centre in rng.integers(0, 2**63, 4, dtype=np.uint64).tolist():
        for _ in range(1250):
            fps.add(centre ^ int(sum(1 << int(f) for f in rng.choice(64, rng.integers(0, 4), replace=False))))
    values = np.array(sorted(fps), np.uint64)
    near = [(int(values[i]), int(values[j])) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist()]
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    for bucket in (2000, 300):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = [(r["hi"] % (1 << 64), r["lo"] % (1 << 64)) for r in simhash.links(df).collect()]
        assert len(near) > 30 * len(values) and len(got) < 30 * len(values)
        assert components(got) == components(near)
