import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import kneser_ney as kn
from gapline.llm.common import Scratch


def brute(seqs, order, size):
    """Interpolated modified Kneser-Ney by the textbook: a function (context, symbol) -> p."""
    level = {order: Counter(tuple(s[k : k + order]) for s in seqs for k in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])

    def disc(c):
        n = Counter(min(v, 5) for v in c.values())
        if not n[1] or not n[2]:
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.5]
        return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]

    d = {k: disc(c) for k, c in level.items()}
    after = {k: defaultdict(dict) for k in level}
    for k, c in level.items():
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    def p(ctx, w, k):
        if k == 0:
            return 1 / size
        seen = after[k].get(tuple(ctx[len(ctx) - k + 1 :]), {})
        if not seen:
            return p(ctx, w, k - 1)
        total = sum(seen.values())
        off = sum(d[k][min(n, 3) - 1] for n in seen.values())
        own = max(0, seen[w] - d[k][min(seen[w], 3) - 1]) / total if w in seen else 0
        return own + off / total * p(ctx, w, k - 1)

    return lambda ctx, w: p(ctx, w, order)


def sequence(text):
    text = " ".join((text or "").split())
    return [kn.START] * (kn.ORDER - 1) + [ord(c) for c in text] if text else []


def perplexity(text, p):
    s = sequence(text)
    costs = [-math.log(p(tuple(s[k : k + 3]), s[k + 3])) for k in range(len(s) - 3)]
    return math.exp(sum(costs) / len(costs)) if costs else None


def test_perplexities_match_the_textbook(spark, monkeypatch):
    texts = ["the cat sat on the mat", "The dog ate the cat's food 12 times", "a cat and a dog and a mat", "mat mat mat the the", "кот и пёс 猫と犬"] * 3
    more = [*texts, "zebra cat", "THE dog", "猫 猫 猫", " \n ", "", None, "q", "the \t\n mat \U0001f600", "mat sat cat " * 30]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(more)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    model = kn.Model(docs.filter(f"doc_id < {len(texts)}"), scratch)
    p = brute([sequence(t) for t in texts], kn.ORDER, model.symbols)
    assert model.symbols == len({c for t in texts for c in t}) + 1
    for together, cached in ((1 << 20, kn.CACHED), (16, kn.CACHED), (1 << 20, 40), (16, 40)):
        monkeypatch.setattr(kn, "TOGETHER", together)
        got = {r["doc_id"]: r["perplexity"] for r in kn.perplexities(docs, model, scratch, cached).collect()}
        for k, t in enumerate(more):
            want = perplexity(t, p)
            assert got[k] == want or math.isclose(got[k], want, rel_tol=1e-9), (together, cached, t, got[k], want)


def test_classify_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 1500")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    trusted = {r[0] for r in kn.trusted_documents(labels).collect()} & {d for d, r in rows.items() if (r["text"] or "").strip()}
    apart = {d for d in trusted if zlib.crc32(str(d).encode()) % 4 == 0}
    p = brute([sequence(rows[d]["text"]) for d in sorted(trusted - apart)], kn.ORDER, len({c for d in trusted - apart for c in sequence(rows[d]["text"])}))
    want = {d: perplexity(r["text"], p) for d, r in rows.items()}
    for cached in (kn.CACHED, 3000):
        got = {r["doc_id"]: r for r in kn.classify(docs, kn.trusted_documents(labels), cached=cached).collect()}
        assert set(got) == set(rows)
        for d, r in got.items():
            assert r["perplexity"] == want[d] or math.isclose(r["perplexity"], want[d], rel_tol=1e-9)
            own = sorted(want[x] for x in apart if rows[x]["lang"] == r["lang"]) or sorted(want[x] for x in apart)
            assert math.isclose(r["threshold"], own[math.ceil(kn.QUANTILE * len(own)) - 1])
            assert r["keep"] == (want[d] is not None and r["perplexity"] <= r["threshold"])


def test_junk_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = kn.classify(docs, kn.trusted_documents(labels)).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.6, (np.mean(good), np.mean(bad))


def test_edges(spark):
    rows = [(1, "good plain text of words", "en"), (1, "good plain text of words", "en"), (2, None, "en"), (3, "", None), (4, " \n", "en"), (5, "$$$ ### !!! %%%", "en"), (6, "plain words", None), (None, "good text", "en"), (7, "plain good words of text " * 80_000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("p", F.lit(1)).withColumn("own", F.lit("x"))
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    got = {(r["doc_id"], r["perplexity"] is None, r["keep"]) for r in kn.classify(docs, ids).collect()}
    assert {(2, True, False), (3, True, False), (4, True, False), (1, False, True), (5, False, False)} <= got
    assert kn.classify(docs, ids).count() == len(rows)
    assert kn.classify(docs, ids.limit(0)).filter("keep or perplexity is not null").count() == 0
    assert kn.classify(docs.limit(0), ids).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, None), (5, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r[0] for r in kn.trusted_documents(labels).collect()) == [1, 5]


def test_white_space_of_any_kind():
    """A no-break space is a blank, and no sign of broken decoding."""
    assert kn.tidy("a\u00a0b\u0085c\u2003 d\n") == "a b c d" != kn.tidy("a\ufffdb\ufffdc d")
    assert kn.tidy(None) is None and kn.tidy(" \u00a0") == ""
    assert [p for _, parts in kn.pieces(["x\0y"]) for p in parts] == [chr(kn.START) * (kn.ORDER - 1) + "x\ufffdy"]
