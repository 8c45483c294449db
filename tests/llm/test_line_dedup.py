import numpy as np
from pyspark.sql import functions as F

from gapline.llm import line_dedup as ld


def jaccard(a, b):
    def grams(x):
        return {x[k : k + 8] for k in range(len(x) - 7)} if len(x) >= 8 else {x}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def brute(rows):
    """Kept texts of (doc_id, text) rows by comparing all pairs of lines."""
    first = {}
    for d, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if x := ld.normal(line):
                at = (d is None, d or 0, n)
                first[x] = min(first.get(x, at), at)
    lines = list(first)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) - 8 and jaccard(a, b) >= ld.SIMILAR:
                parent[find(a)] = find(b)
    best = {}
    for x in lines:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    out = []
    for d, text in rows:
        if text is None:
            out.append((str(d), None))
            continue
        kept = [line for n, line in enumerate(text.split("\n")) if not (x := ld.normal(line)) or (d is None, d or 0, n) == first[x] == best[find(x)]]
        out.append((str(d), "\n".join(kept)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60)]
    a = " ".join(words)
    near = words.copy()
    near[20] = "other"
    far = " ".join(rng.permutation(words[::-1]))
    h = ld.bands([a, " ".join(near), far, "x", "", a])
    assert (h[0] == h[5]).all() and (h[0] == h[1]).sum() >= 4 and (h[0] == h[2]).sum() == 0 and len({*h[3], *h[4]}) == 2 * ld.BANDS


def test_forest_is_spanning():
    base = "the quick brown fox jumps over the lazy dog and runs away into the dark wood number "
    lines = [base + str(k) for k in range(40)] + ["something else entirely %d %s" % (k, "xyz" * k) for k in range(5)]
    found = ld.forest(lines)
    found.search(list(range(20)))
    assert len(found.links) == 19
    found.search(list(range(45)))
    assert len(found.links) == 39 and all(jaccard(lines[a], lines[b]) >= 0.8 for a, b in found.links)
    assert ld.forest(["a", "a", "b"]).near(0, np.array([1, 2])) == [1]


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = ld.drop_lines(docs)
    assert out.columns == docs.columns
    got = shown(out)
    assert got == brute(rows)
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_edges(spark):
    near = "this line is long enough to be compared by its shingles and nothing but them, number %d of all"
    rows = [(3, "A line\n\n a LINE \nother"), (2, "a line"), (1, None), (4, ""), (None, "a line\nonly without id"), (5, near % 1), (6, near % 2 + "\n" + near % 1), (7, "\n".join(f"{k} row {k * k}" for k in range(20_000))), (8, "x\ny"), (8, "x\ny"), (9, " \n\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("dropped", F.lit("x"))
    small = [r for r in rows if r[0] != 7]
    got = shown(ld.drop_lines(docs.filter("doc_id is null or doc_id <> 7")))
    assert got == brute(small)
    counted = {str(r["doc_id"]): (r["n_lines"], r["n_dropped"]) for r in ld.drop_lines(docs, counts=True).collect()}
    assert counted["3"] == (4, 2) and counted["1"] == (0, 0) and counted["6"] == (2, 2) and counted["7"] == (20_000, 0)
    assert ld.drop_lines(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "same line\nother", 5, "a", "b", 9), (2, "SAME line", 6, "c", "d", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, of string, n_lines string, row int")
    got = ld.drop_lines(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], (2, "", 6, "c", "d", 9)]
    counted = ld.drop_lines(docs, counts=True)
    assert counted.columns == ["doc_id", "text", "gone", "of", "row", "n_lines", "n_dropped"]


def test_frequent_bands_are_split(spark, monkeypatch):
    rows = [(k, "one very common sentence of a template that differs in the last few places only, item %04d" % k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ld, "BLOCK", 10)
    assert max(n for n, *_ in ld.frequent_bands(docs, 120).values()) > 1
    grouped = ld.members(docs, 120)
    assert grouped.groupBy("grp").agg(F.countDistinct("k").alias("n")).agg(F.max("n")).first()[0] < 40
    assert grouped.count() < 120 * ld.BANDS * 2
    assert [r["doc_id"] for r in ld.drop_lines(docs).filter("text <> ''").collect()] == [0]


def test_chains_over_blocks_are_found(spark, monkeypatch):
    """Lines that drift step by step: ends of a chain are not similar, and its links lie across blocks."""
    head = "a head that is the same on all of these lines and is long enough to give them bands in common, for sure it is "
    rows = [(100 * c + k, head + "".join(chr(97 + (7 * c + j) % 26) if j >= 3 * k else chr(65 + j % 26) + str(c) for j in range(60))) for c in range(3) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ld, "BLOCK", 4)
    assert shown(ld.drop_lines(docs)) == brute(rows)


def test_texts_are_not_split_for_each_line(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nc"), (2, "b\n\nd")], "doc_id long, text string")
    for counts in (False, True):
        out = ld.drop_lines(docs, counts=counts)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction(split" in plan and "lambdafunction(split(" not in plan
        assert shown(out) == [("1", "a\nb\nc"), ("2", "\nd")]
    assert "Generate" not in ld.lines_of(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_bits_leave_out_no_similar_line(monkeypatch):
    rng = np.random.default_rng(5)
    lines = []
    for n in (3, 9, 20, 60, 400, 3000):
        base = "".join(rng.choice(list("abcdefgh "), n))
        for changes in range(12):
            x = list(base)
            for at in rng.choice(n, min(n, changes * max(1, n // 200)), replace=False):
                x[at] = "#"
            lines.append("".join(x))
    found = ld.forest(lines)
    similar = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if jaccard(lines[a], lines[b]) >= ld.SIMILAR}
    possible = set(map(tuple, found.possible(np.arange(len(lines)))))
    assert similar <= possible and len(similar) > 30 and len(possible) < len(lines) ** 2 / 4
    assert all({(a, b) for b in found.near(a, np.arange(a + 1, len(lines)))} == {x for x in similar if x[0] == a} for a in range(len(lines) - 1))
    found.search(list(range(len(lines))))
    monkeypatch.setattr(ld, "FEW", 2)
    other = ld.forest(lines)
    other.search(list(range(len(lines))))
    assert len(found.links) == len(other.links) and all((found.root(a) == found.root(b)) == (other.root(a) == other.root(b)) for a in range(len(lines)) for b in range(a))


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L doc_id, cast(unhex('616263E40A6162630A4162630A') as string) text union all select 2L, cast(unhex('E4') as string)")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in ld.drop_lines(docs, counts=True).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {1: (4, 1), 2: (1, 0)}
