import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=30):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(words(text))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        mine = {s: c for (g, s), c in groups.items() if g == lang}
        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        for s in p:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            out += [(lang, s, "pair", o, -x, r + 1) for r, (x, _, o) in enumerate(sorted(pair))]
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, "term", t, -x, r + 1) for r, (x, _, t) in enumerate(term)]
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).withColumns({"term": F.lit(0), "n": F.lit("n"), "kept": F.lit(True)})


def corpus(seed, n, sources):
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3] * (i % 25)}" for i in range(150)] + ["Ünï", "日本語の長い文字列がここにあります", "eightlet", "sixteenlettersxx", "seventeenlettersx", "x" * 40]
    out = []
    for _ in range(n):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(sources)
        start = hash(str(source)) % 40 if source else 0
        out.append((lang, source, rng.choice([" ", "-", "1"]).join(rng.choices(names[start : start + 120] + names[-6:], k=rng.randint(0, 30)))))
    return out


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus(1, 900, ["a", "b", "B", None, "é"])
    assert shown(source_divergence.audit(table(spark, rows))) == brute(rows)
    # Small buffers, tiles and blocks.
    for name, value in (("TOKENS", 500), ("TEXTS", 300), ("TILE", 2), ("TERMS", 16), ("LONG", 600)):
        monkeypatch.setattr(source_divergence, name, value)
    assert shown(source_divergence.audit(table(spark, rows))) == brute(rows)


def test_edges(spark):
    rows = [("en", "a", "the cat " * 3)] * 40 + [("en", "b", None), ("en", "c", ""), ("en", None, "1234 ..."), ("fr", "x", "rare"), ("fr", "y", "words"), ("one", "s", "a")] + [("one", "s", "a b")] * 30
    rows += [("en", "b", "the " * 100_000 + "z" * 50_000), (None, None, None)]
    assert shown(source_divergence.audit(table(spark, rows))) == brute(rows)
    assert source_divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_radix_order():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 1000).astype(np.uint32), rng.integers(0, 1 << 63, 1000).astype(np.uint64) >> rng.integers(0, 60, 1000).astype(np.uint64)
    assert (source_divergence.radix_order([a, b]) == np.lexsort((b, a))).all()
