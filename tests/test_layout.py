"""Folds as expressions, layouts on a curve, set-similarity joins, specifications and rules in one pass."""

import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gapline.functions.fold import scan
from gapline.operators import rules as U
from gapline.operators import set_join as SJ
from gapline.operators import text as X
from gapline.sources import ingest as N
from gapline.sources import tables as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 1000)], "a array<long>")
    sums = scan(F.col("a"), F.lit(0).cast("long"), "bigint", lambda s, x: (s + x, s + x), "bigint", lambda s: -s)
    for row in df.select("a", sums.alias("s")).collect():
        total, want = 0, []
        for x in row["a"]:
            total += x
            want.append(total)
        assert row["s"] == [*want, -total]


def texts():
    rng = random.Random(3)
    line = lambda: rng.choice(["", "  ", "def f(x):", "    return 1", "---", "{", "kind: Pod", "@app.get('/')", "05 ", "  10 NAME PIC X.", "^DD(1,2)=x", "^DPT(3", "word " * rng.randint(0, 30), "  spaced  ", "x" * rng.randint(0, 90), "日本 語"])
    made = ["\n".join(line() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [*made, "", "\n", "tiny", "import x\n" * 30 + "def a():\n  pass\n" + "y\n" * 60, "z" * 5000, "a b\n" * 700]


@pytest.mark.parametrize(("fold", "pieces", "args"), [(X.semantic, X.semantic_pieces, (40, 5)), (X.semantic, X.semantic_pieces, (300, 50, 0.3)), (X.fixed_width, X.fixed_width_pieces, (30,)), (X.hierarchy, X.hierarchy_pieces, (10,))])
def test_chunks_equal_the_fold(spark, fold, pieces, args):
    docs = [(str(i), t) for i, t in enumerate(texts())] + [("none", None)]
    df = spark.createDataFrame(docs, "chunk_id string, text_content string")
    out = X.chunk_lines(df, pieces, *args)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((i, n, *p) for i, t in docs if t is not None for n, p in enumerate(fold(t, *args)))
    assert got == want
    assert "Python" not in plan_of(out) and "MapInPandas" not in plan_of(out) and "Exchange" not in plan_of(out)


def test_long_copybook(spark):
    """Fifty thousand entries in seconds, and the same parents as by definition."""
    rng = random.Random(1)
    levels = [rng.choice([1, 5, 10, 15, 88, 49, 77]) for _ in range(50_000)]
    text = "\n".join(f"       {n:02d} F-{i} PIC X." for i, n in enumerate(levels))
    df = spark.createDataFrame([("f", text), ("n", None)], "path string, text string")
    began = time.time()
    rows = {r["line"]: r["parent"] for r in N.cobol_hierarchy(df).collect()}
    assert time.time() - began < 40
    stack = []
    for i, n in enumerate(levels):
        while stack and levels[stack[-1]] >= n:
            stack.pop()
        assert rows[i] == (f"F-{stack[-1]}" if stack else None)
        stack.append(i)
    field = None
    conditions = {r["condition"]: r["field"] for r in N.cobol_conditions(df).collect()}
    for i, n in enumerate(levels):
        if n == 88:
            assert conditions[f"F-{i}"] == field
        else:
            field = f"F-{i}"


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets(spark, threshold):
    rng = random.Random(7)
    base = [[f"t{rng.randint(0, 40)}" for _ in range(rng.randint(1, 15))] for _ in range(60)]
    docs = [(f"d{i:03d}", rng.choice(base)[: rng.randint(1, 15)] + [f"t{rng.randint(0, 40)}" for _ in range(rng.randint(0, 2))]) for i in range(200)]
    docs += [(f"e{i}", ["same", "set", "set"]) for i in range(50)] + [("none", None), ("empty", []), (None, ["a"]), ("hole", [None, "a"])]
    df = spark.createDataFrame(docs, "id string, tokens array<string>").repartition(4)
    pairs, members = SJ.similar_pairs(df, F.col("tokens"), threshold)
    sets = {}
    for i, t in docs:
        clean = frozenset(x for x in t or [] if x is not None)
        if i is not None and clean:
            sets.setdefault(clean, []).append(i)
    want_members = sorted((i, min(ids)) for ids in sets.values() for i in ids)
    assert sorted(tuple(r) for r in members.select("id", "class_id").collect()) == want_members
    named = sorted((min(ids), s) for s, ids in sets.items())
    want = {(a, b): len(s & t) / len(s | t) for k, (a, s) in enumerate(named) for b, t in named[k + 1 :] if len(s & t) / len(s | t) >= threshold}
    got = {(r["a_id"], r["b_id"]): r["similarity"] for r in pairs.collect()}
    assert got == pytest.approx(want)
    assert "Cartesian" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)


def written_by(spark, run):
    """Bytes that the stages of a run wrote to shuffles and tables."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = stages()
    new = [x for x in (after.apply(i) for i in range(after.size())) if x.stageId() not in before]
    return result, sum(x.shuffleWriteBytes() + x.outputBytes() for x in new)


def test_similar_sets_write_little(spark):
    """Sets that share rare tokens and are not similar are not shuffled pair by pair."""
    rng = random.Random(11)
    docs = [(f"d{i:04d}", [f"a{rng.randint(0, 400)}" for _ in range(60)] + [f"b{i}_{n}" for n in range(40)]) for i in range(1200)]
    docs += [("near", docs[5][1][:-1]), ("near", docs[5][1][:-1]), ("near", docs[7][1][1:])]
    df = spark.createDataFrame(docs, "id string, tokens array<string>").repartition(4).cache()
    size = sum(len(t) for _, tokens in docs for t in tokens)
    rows, bytes_ = written_by(spark, lambda: SJ.similar_pairs(df, F.col("tokens"), 0.3)[0].collect())
    sets = {i: set(t) for i, t in docs[:1200]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.3 * len(sets[a] | sets[b])}
    assert {(r["a_id"], r["b_id"]) for r in rows if r["b_id"] != "near"} == want
    assert {r["a_id"] for r in rows if r["b_id"] == "near"} == {"d0005", "d0007"}
    assert bytes_ < 6 * size


def test_near_copies_write_little(spark):
    """Sets of a cluster of near copies are shuffled once for each block, not once for each pair."""
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(100)] for _ in range(4)]
    docs = [(f"d{i:04d}", [*base[i % 4], f"own{i}"]) for i in range(800)]
    df = spark.createDataFrame(docs, "id string, tokens array<string>").repartition(4).cache()
    size = sum(len(t) for _, tokens in docs for t in tokens)
    rows, bytes_ = written_by(spark, lambda: SJ.similar_pairs(df, F.col("tokens"), 0.8)[0].collect())
    assert {(r["a_id"], r["b_id"]) for r in rows} == {(a, b) for a, _ in docs for b, _ in docs if a < b and int(a[1:]) % 4 == int(b[1:]) % 4}
    assert len(rows) == 4 * 200 * 199 // 2 and bytes_ < 3.6 * size, bytes_ / size


@pytest.mark.parametrize("limit", ["NAMED", "HITS", "TOKENS", "BLOCK"])
def test_similar_sets_in_small_steps(spark, monkeypatch, limit):
    rng = random.Random(2)
    docs = [(f"d{i:03d}", [f"t{rng.randint(0, 30)}" for _ in range(rng.randint(1, 30))]) for i in range(150)]
    df = spark.createDataFrame(docs + docs[:70] * 3, "id string, tokens array<string>").repartition(3)
    whole = sorted(tuple(r) for r in SJ.similar_pairs(df, F.col("tokens"), 0.4)[0].collect())
    assert len(whole) == len({r[:2] for r in whole}) > 100
    monkeypatch.setattr(SJ, limit, {"NAMED": 0, "BLOCK": 100}.get(limit, 64))
    assert sorted(tuple(r) for r in SJ.similar_pairs(df, F.col("tokens"), 0.4)[0].collect()) == whole
    assert SJ.similar_pairs(df.limit(0), F.col("tokens"), 0.4)[0].count() == 0


def groups_read(path, column, low, high):
    """Share of the row groups that a filter on a column must read, by their statistics."""
    all_, hit = 0, 0
    for file in pq.ParquetDataset(path).files:
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            all_, hit = all_ + 1, hit + (s.min <= high and s.max >= low)
    return hit / all_


def test_curve(spark, tmp_path):
    """A filter on any of three columns reads under a third; a plain sort reads all for the second and third."""
    rows = spark.range(60_000).select("id", *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).alias(c) for c in ("a", "b")], F.concat(F.lit("s"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(500)).cast("string"), 3, "0")).alias("c"))
    rows = rows.withColumn("b", F.when(F.col("id") % 100 > 0, F.col("b")))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "216")
    try:
        S.export_sorted_parquet(rows, f"file://{tmp_path}/z", ["a", "b", "c"], clustered=True)
        S.export_sorted_parquet(rows, f"file://{tmp_path}/plain", ["a", "b", "c"])
        S.write_partitioned(rows.withColumn("p", F.col("id") % 2), f"file://{tmp_path}/p", "p", ["a", "b"], curve=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # With 216 files and three columns, each file holds about a sixth of every column; a range over a border reads two.
    for column, low, high in (("a", 100, 110), ("b", 300, 310), ("c", "s150", "s155")):
        assert groups_read(f"{tmp_path}/z", column, low, high) < 1 / 3, column
    assert groups_read(f"{tmp_path}/plain", "b", 300, 310) > 0.9
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/z").collect()) == sorted((tuple(r) for r in rows.collect()))
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 60_000
    assert groups_read(f"{tmp_path}/p", "b", 300, 310) < 0.5


def test_one_parse_and_one_read(spark):
    rows = spark.createDataFrame([("k", "kubernetes", "x", '{"labels":{"app":"a"},"annotations":{"description":"long enough text"},"spec":{"template":{"spec":{"securityContext":{"runAsNonRoot":true},"containers":[{"resources":{"limits":{"cpu":1}}}]}}}}'), ("b", "kubernetes", "x", "no json"), ("n", "kubernetes", None, None)], "chunk_id string, artifact_type string, text_content string, metadata string")
    out = U.run_rules(rows)
    got = {(r["chunk_id"], r["rule_name"]): (r["passed"], r["confidence"], r["suggested_fix"]) for r in out.collect()}
    assert got["k", "kubernetes_deployment_description"] == (True, 1.0, None)
    assert got["k", "kubernetes_deployment_security"] == (False, 0.4, "Add security configurations: allowPrivilegeEscalation: false, readOnlyRootFilesystem: true")
    assert got["b", "kubernetes_deployment_description"] == got["n", "kubernetes_deployment_description"] == (False, 0.0, "Add missing fields: description annotation, app label, resource limits")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    files = spark.createDataFrame([("a", '{"openapi":"3","paths":{"/x":{"get":{}}}}'), ("b", "openapi: 3\npaths: {}\n"), ("c", "nothing")], "path string, text string")
    made = N.ingest_openapi(files)
    assert sorted((r["path"], r["route"], r["error"]) for r in made.collect()) == [("a", "/x", None), ("c", None, "no object")]
    assert plan_of(made).count("LocalTableScan") + plan_of(made).count("Scan ExistingRDD") == 1
