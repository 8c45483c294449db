import corpus_pipeline
from gapline.llm import cross_parsing as cp
from tests.llm import test_decontaminate, test_line_dedup, test_mixing, test_simhash


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 2500")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    texts = {d: r["text"] for d, r in rows.items()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        if name == "language_id":
            langs, _ = cp.judge(list(texts.values()), cp.learn(docs))
            texts = {d: t for (d, t), lang in zip(texts.items(), langs, strict=True) if lang != "und"}
        elif name == "line_dedup":
            texts = {int(d): t for d, t in test_line_dedup.brute(list(texts.items()))}
        elif name == "near_duplicates":
            texts = {d: t for d, t in texts.items() if any(x[0] == x[2] == str(d) for x in simhash_rows(texts))}
        elif name == "decontamination":
            dirty = {d for d, _, _ in test_decontaminate.brute(list(texts.items()), items)}
            texts = {d: t for d, t in texts.items() if str(d) not in dirty}
        now = stage(spark, now, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        if name == "mixing":
            want = test_mixing.brute([(d, t, rows[d]["source"]) for d, t in texts.items()])
            assert test_mixing.shown(now) == [w for w in want if w[4] > 0]
        else:
            assert now.columns == docs.columns
            assert {r["doc_id"]: r["text"] for r in now.collect()} == texts, name
            assert now.filter("length(text) <> n_chars").count() == 0


_memo = {}


def simhash_rows(texts):
    key = tuple(sorted(texts.items()))
    if key not in _memo:
        _memo[key] = test_simhash.brute(list(texts.items()))
    return _memo[key]


def test_run_on_tables(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "taken"} <= set(out.columns) and out.count() > 50


def test_rows_at_the_edges(spark):
    en = "the quick brown fox jumps over the lazy dog near the quiet river bank while {} small birds sing above the old stone bridge"
    de = "der schnelle braune Fuchs springt über den faulen Hund am stillen Fluss während {} kleine Vögel über der alten Brücke singen"
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, gapline_row string, of string, copy string, k bigint, root bigint, size bigint"

    def row(i, text, lang, source="a"):
        return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", 1, 2, 3)

    long = " ".join(f"word{k} stands here for number {k * k}" for k in range(60_000))
    rows = [row(i, en.format(f"{i} and {i * 7919}"), "en") for i in range(1, 9)] + [row(i, de.format(f"{i} und {i * 7919}"), "de", None) for i in range(11, 19)]
    rows += [row(20, None, "en"), row(21, "", None), row(22, "12 34", None), row(None, "a document without an id that says nothing else", "en"), row(23, long, "en")]
    rows += [row(24, "two texts have one id and this is the first of them", "en"), row(24, "andere Worte stehen im zweiten Text mit derselben Nummer", "de")]
    rows += [row(25, "this row stands here twice and counts once only", "en")] * 2 + [row(26, "one line\n\none line\nand another", None, None)]
    docs = spark.createDataFrame(rows, names)
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-edges-{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != "mixing":
            assert now.columns == docs.columns
            assert all(r["gapline_row"] == "x" and r["of"] == "y" and r["copy"] == "z" and r["k"] == 1 and r["root"] == 2 and r["size"] == 3 for r in seen[name])
    assert {20, 21, 22}.isdisjoint(r["doc_id"] for r in seen["language_id"])
    assert len(seen["language_id"]) == len(rows) - 3
    lines = {(r["doc_id"], r["text"]) for r in seen["line_dedup"]}
    assert (23, long) in lines and (26, "one line\n\nand another") in lines
    kept = [(r["doc_id"], r["text"]) for r in seen["near_duplicates"]]
    assert len(kept) == len(set(kept)) and {d for d, _ in kept} >= {None, 23, 26} and len([d for d, _ in kept if d == 24]) == 2 and len([d for d, _ in kept if d == 25]) == 1
    assert all(r["taken"] > 0 for r in seen["mixing"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
        assert empty.count() == 0
