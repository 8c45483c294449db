import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import cross_parsing as cp


def greedy(text, training):
    """Phrases by plain substring search."""
    n = k = 0
    while k < len(text):
        j = k
        while j < len(text) and text[k : j + 1] in training:
            j += 1
        k = max(j, k + 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    model = (("a", "the cat sat on the mat and that was that"), ("b", "der hund lief in den wald und dann nach haus"))
    codes, _, tables = cp.prepared(model)
    for text in ("that cat and the dog", "zzz?? q!!x  9", "in den haus", "a", "the cat sat on the mat", "", "żółw the żó"):
        s = cp.symbols(text, codes)
        want = []
        for _, t in model:
            train = "".join(chr(256 + x) for x in cp.symbols(t, codes))
            want.append(greedy("".join(chr(256 + x) for x in s), train))
        assert cp.phrases([s], tables).tolist() == [want], text


def test_phrases_go_on_over_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    train = "".join(rng.choice(list("abc"), 400)) + "abcabcabd" * 40
    model = (("a", train), ("b", "".join(rng.choice(list("abcd"), 300))))
    texts = ["abc" * 500, "".join(rng.choice(list("abcdé"), 700)), train[:350] + train[20:300], "", "d" * 65, train * 2]
    for stretch, settled in ((1024, 96), (64, 8), (8, 3), (7, 7), (5, 50), (1, 1)):
        monkeypatch.setattr(cp, "STRETCH", stretch)
        monkeypatch.setattr(cp, "SETTLED", settled)
        codes, _, tables = cp.prepared(model)
        seqs = [cp.symbols(t, codes) for t in texts]
        got = cp.phrases(seqs, tables).tolist()
        for s, row in zip(seqs, got, strict=True):
            trains = ["".join(chr(256 + x) for x in cp.symbols(t, codes)) for _, t in model]
            assert row == [greedy("".join(chr(256 + x) for x in s), t) for t in trains], (stretch, settled)


def brute(rows):
    """(doc_id, language, score) by plain substring search in the whole texts that are learned."""
    def gaps(text):
        return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()))

    model = {lang: gaps(text) for lang, text in rows["model"]}
    known = {c for t in model.values() for c in t}
    out = []
    for d, text in rows["texts"]:
        t = "".join(c if c in known or c == " " else "\1" for c in gaps(text))
        if not t.strip():
            out.append((d, "und", 0.0))
            continue
        n = sorted((greedy(t, m), lang) for lang, m in model.items())
        out.append((d, n[0][1], 1 - n[0][0] / n[1][0]))
    return out


def test_identify_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1200 or n_chars between 3000 and 4000").limit(90)
    model = cp.learn(docs, docs_each=6)
    learned = {r["text"] for r in docs.collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert len(model) == 4 and all(any(t in text for t in learned) for _, text in model)
    want = sorted(brute({"model": model, "texts": [(r["doc_id"], r["text"]) for r in docs.collect()]}))
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in cp.identify(docs, model).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_only_whole_texts_are_learned(spark):
    rows = [(k, f"wort{k} " + "abc " * k, "de") for k in range(40)] + [(100 + k, "mot " * 4000, "fr") for k in range(5)]
    model = dict(cp.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_each=50, longest=100))
    texts = {t for d, t, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2 and len(t) <= 100}
    assert sorted(model["de"].split()) == sorted(" ".join(texts).split()) and model["fr"] == "mot " * 4000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = cp.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(0, None, "en"), (1, "", "en"), (3, "12 ?!", None), (None, "der hund und die katze", "de"), (4, "the dog and the cat " * 20_000, "en"), (5, "der hund und die katze im wald", "de"), (5, "der hund und die katze im wald", "de"), (6, "кот", None), (7, "the dog and the house", "en"), (8, "die katze und der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(None).cast("int"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in cp.identify(docs).collect()]
    by = {(d, p) for d, p, _ in got}
    assert len(got) == 10 and {(0, "und"), (1, "und"), (3, "und"), (None, "de"), (4, "en"), (5, "de")} <= by
    assert (6, "de", 0.0) in got
    kept = cp.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert {r["lang_pred"] for r in cp.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert cp.identify(docs.limit(0)).count() == 0


def scripts(seed, n, letters):
    """Texts of a made-up language over so many letters, with words that come back."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(400)]
    return [" ".join(rng.choice(words, 60)) for _ in range(n)]


def test_sparse_steps_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(8)
    model = (("a", "".join(rng.choice(list("abcdef"), 900))), ("b", "".join(rng.choice(list("cdefgh"), 700))), ("c", "x"))
    texts = ["".join(rng.choice(list("abcdefghijé "), 500)) for _ in range(20)] + ["", "x", "xxxx", "ij"]
    seen = []
    for bound in (1 << 24, 0, 900 * 8):
        monkeypatch.setattr(cp, "DENSE", bound)
        cp.prepared.cache_clear()
        codes, _, tables = cp.prepared(model)
        seen.append(cp.phrases([cp.symbols(t, codes) for t in texts], tables).tolist())
    cp.prepared.cache_clear()
    assert seen[0] == seen[1] == seen[2]


def test_large_alphabets(spark):
    """Three scripts of thousands of letters beside Latin ones: no table of all states and letters, bounded memory, right languages."""
    han, kana, hangul = [chr(0x4E00 + i) for i in range(9000)], [chr(0x3041 + i) for i in range(80)] + [chr(0x6000 + i) for i in range(2500)], [chr(0xAC00 + i) for i in range(4000)]
    rows = []
    for lang, letters in (("zh", han), ("ja", kana), ("ko", hangul), ("en", list("etaoinshr")), ("xx", list("qwzjkvxyp"))):
        rows += [(lang, t) for t in scripts(len(letters), 60, letters)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = cp.learn(docs)
    assert {lang for lang, _ in model} == {"zh", "ja", "ko", "en", "xx"}
    found = {r["doc_id"]: r["lang_pred"] for r in cp.identify(docs, model).collect()}
    assert sum(found[i] == lang for i, (lang, _) in enumerate(rows)) > 0.97 * len(rows)
    long = tuple((lang, "".join(x for t in scripts(k, 330, letters) for x in t)[:131_072]) for k, (lang, letters) in enumerate((("zh", han), ("ja", kana), ("ko", hangul))))
    _, _, tables = cp.prepared(long)
    cp.prepared.cache_clear()
    for t in tables:
        held = sum(x.nbytes for x in (t.local, t.restart, t.at_root, *((t.table,) if t.dense else (t.key, t.target))))
        assert held < 100 << 20 and t.states <= 2 * 131_072


def test_ties_go_to_the_frequent_language(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(8)] + [(100 + i, "the dog and the cat", "en") for i in range(30)] + [(1000, "жж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in cp.identify(docs).collect()}
    assert got[1000] == ("en", 0.0) and got[0][0] == "de"
