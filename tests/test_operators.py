"""Golden cases and plain-Python expectations of operators that SQL doesn't express."""

import random

import pytest
from pyspark.sql import functions as F

from gapline.functions import text as T
from gapline.operators import ml, scoring
from gapline.operators import text as X
from gapline.operators import upsert as U
from gapline.operators import vectors as V
from gapline.sources import files as P
from gapline.sources import ingest as N
from gapline.sources import tables as S
from gapline.streaming import jobs as J
from gapline.streaming import requests as R


def score(spark, base, similarity, passed=True, weight=0.25):
    row = spark.range(1).select(scoring.confidence(F.lit(base), F.lit(0.0), F.lit(similarity), F.lit(0 if passed else 1), F.lit(0), F.lit(0), 1.0, 0.0, F.lit(weight)).alias("x"))
    return row.first()["x"]


def test_confidence_golden_pairs(spark):
    assert score(spark, 0.6, 0.8) == 0.8
    assert score(spark, 0.6, 0.0) == 0.6
    assert score(spark, 0.6, 0.8, passed=False) == 0.6
    assert score(spark, 0.1, -3.0, passed=False) == 0.0 and score(spark, 1.0, 9.0) == 1.0


def test_token_windows(spark):
    docs = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(1500))), ("b", " "), ("c", "one")], "chunk_id string, text_content string")
    rows = X.chunk_tokens(docs, 1000).orderBy("chunk_id", "word_start").collect()
    assert [(r["chunk_id"], r["word_start"]) for r in rows] == [("a", 0), ("a", 638), ("a", 1276), ("c", 0)]
    assert rows[0]["tokens"] == 750 and rows[2]["content"].endswith("w1499")
    assert spark.range(1).select(T.estimate_tokens(F.lit("")).alias("n")).first()["n"] == 1


def test_greedy_chunkers():
    text = "\n".join(f"line {i} " + "word " * (i % 7) for i in range(60))
    every = list(X.semantic(text, 60, 1))
    assert all(n <= 60 + 20 for _, _, n in every) and every[0][1] == 0
    for (a, _, _), (b, _, _) in zip(every, every[1:], strict=False):
        keep = int(len(a.split("\n")) * 0.15)
        assert not keep or b.split("\n")[:keep] == a.split("\n")[-keep:]
    assert len(list(X.semantic("import x\n" * 30 + "def a():\n  pass\n" * 1 + "y\n" * 60, 1000, 5))) == 2
    assert list(X.semantic("tiny", 100)) == []
    fixed = list(X.fixed_width(" a \n\n" + "0123456789" * 8 + "\n" + "x" * 80, 25))
    assert [c for c, _, _ in fixed] == ["a\n" + "0123456789" * 8, "x" * 80]
    deep = "^DPT(1,2\n  a\n" + "    b\n" * 3 + "^DPT(2)\n" + "c\n"
    assert "\n".join(c for c, _, _ in X.hierarchy(deep, 2)) == deep
    assert X.level("^A(1,(2") == 2 and X.level("12 x") == 2 and X.level("   y") == 3


def test_code_windows():
    random.seed(1)
    text = "x = 1\n" * 100 + "\ndef f():\n" + "    y = 2\n" * 300 + "\nclass A:\n    pass\n"
    parts = list(X.code(text, "a/b.py"))
    assert all(len(c) <= 2000 for c, _, _ in parts) and parts[-1][0].startswith("class A") and any(c.startswith("def f") for c, _, _ in parts)
    assert list(X.code("short", "x")) == [("short", 0, 5)]


def test_scan_folder(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "src/a.py").write_text("print(1)")
    (tmp_path / "src/deep/b.md").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "src/c.py").write_bytes(b"ab\x00c")
    (tmp_path / "src/d.py").write_bytes(b"x" * 2000)
    (tmp_path / "src/e.bin").write_text("no")
    (tmp_path / "node_modules/f.py").write_text("no")
    (tmp_path / ".hidden/g.py").write_text("no")
    (tmp_path / "src/h.md").write_bytes(b"\x81 \xff")
    got = P.scan_corpus(spark, f"file://{tmp_path}", (".py", ".md"), most_bytes=1000)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.select("path").collect()) == ["a.py", "b.md", "h.md"]
    assert {r["ending"]: r["files"] for r in P.scan_corpus_stats(got).collect()} == {".py": 1, ".md": 2}
    read = {r["path"].rsplit("/", 1)[1]: (r["text"], r["encoding"], r["error"]) for r in P.read_text_with_fallback(got).collect()}
    assert read == {"a.py": ("print(1)", "utf-8", None), "b.md": ("café", "cp1252", None), "h.md": (None, None, "undecodable")}


def test_scan_of_odd_folders(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    for name in ("x.PY", "x.pyc", "build/y.py", "rebuild/z.py", ".hid/w.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1")
    got = P.scan_corpus(spark, f"file://{root}", (".py",))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.select("path").collect()) == ["x.PY", "z.py"]


def test_entries_and_nodes_at_the_edges(spark):
    text = "05  A PIC IS 9(3).\n  05 B PIC X VALUE IS 'a  b'.\r\n5 C PIC X.\n05 D. more\n05 e PIC X.\n05\n10 F PICTURE X OCCURS 1 TO 5 TIMES USAGE IS INDEX.\n88 G VALUE \"x\"."
    files = spark.createDataFrame([("f", text), ("n", None), ("e", "")], "path string, text string")
    got = [tuple(r)[2:] for r in N.cobol_fields(files).orderBy("line").collect()]
    assert got == [(5, "A", "9(3)", None, None, None, None), (5, "B", "X", None, None, "a  b", None), (10, "F", "X", 1, None, None, "INDEX"), (88, "G", None, None, None, "x", None)]
    assert [r["condition_value"] for r in N.cobol_conditions(files).collect()] == ["x"]
    lines = ["^DD(2,.01,0)=NAME", "^DD(2,,0)=no file", "^DD(1,2,3,4)=S X=1", "^X()=1", "x^A(1)=2", "^A(1)2", "^a(1)=2", "^B(1,(2)="]
    files = spark.createDataFrame([("d", "\n".join(lines)), ("g", "\n".join(lines[3:])), ("n", None)], "path string, text string")
    got = {(r["path"], r["content"]): (r["global_name"], r["attribute"], r["subscripts"], r["entry_value"]) for r in N.ingest_mumps(files).collect()}
    assert got == {
        ("d", lines[0]): ("DD", "0", None, "NAME"), ("d", lines[2]): ("DD", "3,4", None, "S X=1"), ("g", lines[3]): ("X", None, "", "1"), ("g", lines[7]): ("B", None, "1,(2", None),
    }


def test_kubernetes(spark):
    text = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p\n  labels: {app: x}\n---\n---\napiVersion: x/v1\nkind: Odd\n---\nkind: Service\n"
    rows = N.ingest_k8s(spark.createDataFrame([("a.yaml", text), ("b.yaml", "a: [1"), ("c", None)], "path string, text string"))
    got = {(r["path"], r["doc_no"]): r for r in rows.collect()}
    assert got["a.yaml", 0]["artifact_id"] == "k8s://default/Pod/p" and got["a.yaml", 0]["labels"] == {"app": "x"}
    assert got["a.yaml", 2]["artifact_id"] == "k8s://default/Odd/unnamed-2" and got["b.yaml", None]["error"].startswith("YAML")
    assert [(r["kind"], r["name"]) for r in N.k8s_validity(rows).collect()] == [("Pod", "p")]
    long = "".join(f"key{k}:\n" + "  a: b\n" * 40 for k in range(3))
    assert len(N.section_chunks(long)) == 3 and N.section_chunks("a: 1") == ["a: 1"] and "\n".join(N.section_chunks(long)) == long


def test_cobol_structures(spark):
    text = "      * top\n       01  CUSTOMER-RECORD.\n           05  NAME PIC X(10).\n           05  AGE PIC 9(3) VALUE ZERO.\n               88 OLD VALUE 99.\n       01  OTHER.\n           05  A REDEFINES B OCCURS 3 TIMES COMP.\n"
    files = spark.createDataFrame([("f", text), ("g", "nothing")], "path string, text string")
    got = [(r["path"], r["structure_no"], r["structure"], r["error"]) for r in N.ingest_cobol(files).orderBy("path", "structure_no").collect()]
    assert got == [("f", 0, "CUSTOMER-RECORD", None), ("f", 1, "OTHER", None), ("g", None, None, "no 01-level structure")]
    fields = {r["name"]: r for r in N.cobol_fields(files).collect()}
    assert (fields["NAME"]["pic"], fields["AGE"]["field_value"], fields["A"]["occurs"], fields["A"]["redefines"], fields["A"]["usage"]) == ("X(10)", "ZERO", 3, "B", "COMP")
    assert [tuple(r)[2:] for r in N.cobol_conditions(files).collect()] == [("OLD", "99", "AGE")]
    assert {r["name"]: r["parent"] for r in N.cobol_hierarchy(files).collect()} == {"CUSTOMER-RECORD": None, "NAME": "CUSTOMER-RECORD", "AGE": "CUSTOMER-RECORD", "OLD": "AGE", "OTHER": None, "A": "OTHER"}


def test_layout_and_dictionary_golden_lines(spark):
    line = "001-009  Social Security Number  PIC 9(09)  NUMERIC  Required  Section: IDENTITY"
    r = N.irs_fields(spark.createDataFrame([("f", line)], "path string, text string")).first()
    assert (r["start_position"], r["end_position"], r["field_length"], r["field_name"], r["required"], r["section"]) == (1, 9, 9, "Social Security Number", True, "IDENTITY")
    r = N.ingest_mumps(spark.createDataFrame([("f", '^DD(200,.01,0)="NAME^RF^^0;1^K:$L(X)>30 X"')], "path string, text string"))
    row = r.first()
    assert (row["file_no"], row["field_no"], row["attribute"]) == ("200", ".01", "0")
    assert N.mumps_nodes(r).first()["input_transform"] == "K:$L(X)>30 X"


def test_python_source(spark):
    text = "from fastapi import FastAPI\n@app.get('/a/{i}')\ndef a(i, u=Depends(user)): pass\n@app.post('/b', status_code=202)\nasync def b(): pass\n@app.post('/c')\ndef c(): pass\nclass M(BaseModel):\n    x: int\n"
    got = [(r["part"], r["name"], r["method"], r["route"], r["status_code"]) for r in N.ingest_fastapi_source(spark.createDataFrame([("f", text), ("g", "def (")], "path string, text string")).orderBy("path", "line", "part").collect()]
    assert got == [("dependency", "user", None, None, None), ("route", "a", "get", "/a/{i}", 200), ("route", "b", "post", "/b", 202), ("route", "c", "post", "/c", 201), ("model", "M", None, None, None), (None, None, None, None, None)]


def test_js_snippets(spark):
    files = spark.createDataFrame([("a", "function add(a, b) { return a + b; }\nclass A extends B {\n  constructor() { super(); this.value = 1; }\n}\n"), ("b", "z" * 1500)], "path string, text string")
    got = {(r["path"], r["kind"]): len(r["content"]) for r in N.js_snippets(files).collect()}
    assert set(got) == {("a", "function"), ("a", "class"), ("b", "text")} and got["b", "text"] == 1000


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ("no json",), (None,)], "x string").select(T.canonical_json(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in rows] == ['{"a":[1,2],"b":1}', "no json", None]


def test_not_in_with_nulls(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "chunk_id string")
    assert [r[0] for r in U.not_in_cleanup(rows, spark.createDataFrame([("a",)], "chunk_id string")).collect()] == ["b"]
    assert U.not_in_cleanup(rows, spark.createDataFrame([("a",), (None,)], "chunk_id string")).count() == 0
    assert U.not_in_cleanup(rows, spark.createDataFrame([], "chunk_id string")).count() == 3


def test_index_recall_and_share(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    bad = spark.createDataFrame([("none", None), ("nan", [float("nan")] * 64), ("zero", [0.0] * 64)], "chunk_id string, embedding array<float>")
    index = ml.write_index(v.unionByName(bad), f"{spark.conf.get('spark.checkpoint.dir')}/index-share-test")
    assert index.filter("chunk_id in ('none', 'nan')").count() == 0 and index.filter("chunk_id = 'zero'").count() == 1
    probes = v.filter("cast(chunk_id as int) % 40 = 0").select(F.col("chunk_id").alias("rule_name"), F.col("embedding").alias("probe"))
    assert ml.index_recall(v, index, probes, 10).first()["recall"] >= 0.9


def test_search_checks(spark):
    v = spark.createDataFrame([("a", "x", [0.0, 0.0]), ("b", "x", [1.0, 0.0])], "chunk_id string, artifact_type string, embedding array<double>")
    assert [r["chunk_id"] for r in V.vector_search(v, [2.0, 0.0], 2).collect()] == ["b", "a"]
    for bad in (lambda: V.vector_search(v, [0.0, 0.0], 1), lambda: V.vector_search(v, [1.0, 0.0], 0), lambda: V.search_text(v, "ab", 1, 2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        V.get_embedding(v, "z")


def test_approximate_search_and_reduction(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("x").alias("artifact_type"))
    probes = v.limit(20).select(F.col("chunk_id").alias("rule_name"), F.col("embedding").alias("probe"))
    assert ml.recall(v, probes, 10, ml.CELLS, ml.PROBED).first()["recall"] >= 0.9
    assert ml.recall(v, probes, 10, 8, 8).first()["recall"] == 1.0
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/index-test"
    index = ml.write_index(v, folder)
    assert ml.index_recall(v, index, probes, 10).first()["recall"] >= 0.9
    assert ml.index_recall(v, spark.read.parquet(folder), probes, 10, share=1.0).first()["recall"] == 1.0
    full, some = ml.fit_pca(v, 64, 2.0), ml.fit_pca(v, 16, 2.0)
    assert ml.reconstruction_error(v, full).first()["mean_squared_error"] < 1e-6 < ml.reconstruction_error(v, some).first()["mean_squared_error"]
    assert len(ml.fit_pca(v, 64, 0.5).components) < 64
    stats = ml.scale_vectors(v).select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-6 and abs(r["s"] - 1) < 1e-6 for r in stats)


def test_embedding_is_repeatable(spark):
    docs = spark.createDataFrame([("a", "some words here"), ("b", "some words here"), ("c", "")], "chunk_id string, text_content string")
    got = {r["chunk_id"]: r["embedding"] for r in ml.embed_texts(docs, 32).collect()}
    assert got["a"] == got["b"] and sum(got["a"]) == 3 and sum(got["c"]) == 0


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "1"), ("h1", "2"), ("h2", "3")], "content_hash string, chunk_id string")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    for more in ([], [("h2", "9"), ("h3", "4")]):
        if more:
            spark.createDataFrame(more, rows.schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        J.stream_ingest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted((r["content_hash"], r["chunk_id"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("h1", "1"), ("h2", "3"), ("h3", "4")]


def test_failed_run_is_logged(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("text_content"))
    with pytest.raises(Exception, match="broken"):
        S.run_logged(bad, f"file://{tmp_path}/out", f"file://{tmp_path}/log", "r", "x")
    assert spark.read.schema(S.RUNS).parquet(f"file://{tmp_path}/log").first()["status"] == "failed"


def test_ndjson_keeps_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": "x"}\n')
    rows = S.load_ndjson(spark, f"file://{tmp_path}/a.json", "a bigint").cache().collect()
    assert sorted((r["a"] is None, r["_corrupt_record"] is None) for r in rows) == [(False, True), (True, False), (True, False)]


def test_late_rows_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")], "request_id long, t string")
    late = spark.createDataFrame([(3, "2024-01-01 00:20:00"), (4, "2024-01-01 05:10:00")], "request_id long, t string")
    path = f"file://{tmp_path}"

    def counted():
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in").select("request_id", F.to_timestamp("t").alias("ts"))
        J.stream_updates(R.request_counts(stream), f"{path}/out", f"{path}/checkpoint")
        return {str(r["window_start"])[11:13]: r["requests"] for r in J.latest_metrics(spark.read.parquet(f"{path}/out").drop("batch"), ["window_start"]).collect()}

    rows.write.mode("append").parquet(f"{path}/in")
    assert counted() == {"00": 1, "05": 1}
    late.write.mode("append").parquet(f"{path}/in")
    assert counted() == {"00": 1, "05": 2}


def test_specifications_of_all_kinds(spark):
    texts = {
        "json": '{"openapi": "3.0.0", "paths": {"/a": {"summary": "s", "parameters": [{"name": "x"}], "GET": {"responses": {"200": {}}}, "post": null}}}',
        "yaml": "openapi: 3.0.0\npaths:\n  /b:\n    parameters: [{name: x}]\n    put:\n      operationId: p\n      responses: {default: {}, 204: {}}\n  /c: nothing\n",
        "flow": "{openapi: 3.0.0, paths: {/d: {delete: {}}}}",
        "broken": '{"openapi": [',
        "other": "just text",
        "none": None,
    }
    got = N.ingest_openapi(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    fine = sorted((r["path"], r["route"], r["method"], r["operation_id"], r["status_codes"]) for r in got if r["error"] is None)
    assert fine == [("flow", "/d", "delete", "delete__d", []), ("json", "/a", "get", "get__a", [200]), ("json", "/a", "post", "post__a", []), ("yaml", "/b", "put", "p", [204])]
    assert sorted(r["path"] for r in got if r["error"]) == ["broken", "none", "other"]


def test_layouts_in_any_case(spark):
    text = "001-009  social security number  pic 9(09)  numeric  required  section: identity\n010-012 Code (A/B-1.)  PIC X(3)  Alpha  Optional  Section: TAX_INFO"
    got = sorted(tuple(r) for r in N.irs_fields(spark.createDataFrame([("f", text)], "path string, text string")).collect())
    assert got == [("f", 1, 9, 9, "social security number", "9(09)", "NUMERIC", True, "identity"), ("f", 10, 12, 3, "Code (A/B-1.)", "X(3)", "ALPHA", False, "TAX_INFO")]
