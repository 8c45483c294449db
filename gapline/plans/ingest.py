"""Registered ingest queries over synthetic artifacts (``source_text``) and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import text as X
from gapline.registry import query
from gapline.sources import files as S
from gapline.sources import ingest as N


def files(t, kind):
    return t.source_text.filter(F.col("artifact_type") == kind).select(F.col("chunk_id").alias("path"), F.col("text_content").alias("text"))


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("scan_corpus_stats", r"SELECT regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1) AS ending, count(*) AS files FROM files GROUP BY 1", "files")
def _(t):
    return S.scan_corpus_stats(t.files)


# COBOL. The parsing query is shared by its readers.
COBOL = r"""
ln AS (SELECT chunk_id AS path, string_split(text_content, chr(10)) AS a FROM source_text WHERE artifact_type = 'cobol'),
l1 AS (SELECT path, unnest(range(0, len(a))) AS line, trim(regexp_replace(rtrim(unnest(a)), '\.$', '')) AS x FROM ln),
l2 AS (SELECT *, string_split_regex(x, ' +') AS w FROM l1),
fl AS (SELECT path, CAST(line AS INT) AS line, CAST(w[1] AS INT) AS level, w[2] AS name, w[3:] AS w, [upper(y) FOR y IN w[3:]] AS u, upper(x) AS x,
  trim(split_part(array_to_string(w[3:], ' '), 'VALUE ', 2)) AS v
  FROM l2 WHERE len(w) >= 2 AND regexp_full_match(w[1], '[0-9][0-9]') AND regexp_full_match(w[2], '[A-Z0-9_-]+'))"""


def behind(word: str) -> str:
    """The word behind a keyword."""
    return f"CASE WHEN list_contains(u, '{word}') THEN w[list_position(u, '{word}') + 1] END"


@query("cobol_fields", rf"""
WITH {COBOL} SELECT path, line, level, name, {behind('PIC')} AS pic, CASE WHEN list_contains(u,
  'TIMES') THEN TRY_CAST({behind('OCCURS')} AS INT) END AS occurs, {behind('REDEFINES')} AS redefines,
  nullif(trim(split_part(v, '.', 1), ' "'''), '') AS field_value, CASE WHEN contains(x, 'COMP-3') THEN 'COMP-3' WHEN contains(x, 'COMP') THEN 'COMP'
    WHEN contains(x, 'BINARY') THEN 'BINARY' END AS usage FROM fl
""", "source_text")  # fmt: skip
def _(t):
    return N.cobol_fields(files(t, "cobol"))


@query("cobol_conditions", rf"WITH {COBOL}, w AS (SELECT *, last_value(CASE WHEN level <> 88 THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS field FROM fl) SELECT path, line, name AS condition, trim(v, ' \"''') AS condition_value, field FROM w WHERE level = 88", "source_text")
def _(t):
    return N.cobol_conditions(files(t, "cobol"))


@query("cobol_hierarchy", f"""
  WITH {COBOL} SELECT c.path, c.line, any_value(c.level) AS level, any_value(c.name) AS name, arg_max(p.name, p.line) AS parent FROM fl c LEFT
    JOIN fl p ON p.path = c.path AND p.line < c.line AND p.level < c.level GROUP BY c.path, c.line
""", "source_text")
def _(t):
    return N.cobol_hierarchy(files(t, "cobol"))


@query("ingest_cobol", """
  SELECT chunk_id AS path, CAST(0 AS INT) AS structure_no, regexp_extract(text_content, '(?m)^[ \\t]*01[ \\t]+([A-Z0-9_-]+)', 1) AS structure,
    regexp_extract(text_content, '(?sm)^[ \\t]*01[ \\t]+[A-Z0-9_-]+.*', 0) AS content, CAST(NULL AS VARCHAR) AS error FROM source_text
    WHERE artifact_type = 'cobol'
""", "source_text")
def _(t):
    return N.ingest_cobol(files(t, "cobol"))


BROKEN = """
  replace(replace(text_content, 'S9(', CASE WHEN length(text_content) % 2 = 0 THEN 'S9((' ELSE 'S9(' END), '           05  ITEM-TYPE PIC', CASE
    WHEN length(text_content) % 3 = 0 THEN '           99  ITEM-TYPE PIC'
    WHEN length(text_content) % 3 = 1 THEN '           PIC' ELSE '           05  ITEM-TYPE PIC' END)
"""


@query("cobol_syntax_check", rf"""
WITH l1 AS (SELECT path, CAST(unnest(range(0, len(a))) AS INT) AS line, unnest(a) AS x FROM (SELECT chunk_id AS path, string_split({BROKEN},
  chr(10)) AS a FROM source_text WHERE artifact_type = 'cobol')),
p AS (SELECT path, line, CASE WHEN length(replace(pic, '(', '')) <> length(replace(pic, ')', '')) THEN 'unbalanced brackets'
  WHEN TRY_CAST(lv AS INT) < 1 OR TRY_CAST(lv AS INT) > 88 THEN 'level out of range' WHEN regexp_matches(x,
  '(?i)^[ \t]*(?:VALUE|PIC|OCCURS|REDEFINES|USAGE)[ \t]+') THEN 'clause alone' END AS problem
  FROM (SELECT *, regexp_extract(x, '(?i)PIC(?:TURE)?\s+([A-Z0-9()V+\-.$,]*)', 1) AS pic, regexp_extract(x, '^[ \t]*(\d{{2}})[ \t]+[A-Z0-9_-]+',
    1) AS lv FROM l1 WHERE NOT regexp_matches(x, '^[ \t]*(?:\*.*)?$')))
SELECT path, line, problem FROM p WHERE problem IS NOT NULL
""", "source_text")  # fmt: skip
def _(t):
    rows = t.source_text.filter("artifact_type = 'cobol'").select(F.col("chunk_id").alias("path"), F.expr(BROKEN).alias("text"))
    return N.cobol_syntax_check(rows)


# Every other layout is written in small letters.
LAYOUT = "CASE WHEN length(text_content) % 2 = 0 THEN lower(text_content) ELSE text_content END"


def layouts(t):
    return t.source_text.filter("artifact_type = 'irs'").select(F.col("chunk_id").alias("path"), F.expr(LAYOUT).alias("text"))


IRS = rf"""
im AS (SELECT chunk_id AS path, unnest(regexp_extract_all({LAYOUT}, '{q(N.IRS_FIELD)}', 0)) AS x FROM source_text WHERE artifact_type = 'irs'),
ff AS (SELECT path, CAST(regexp_extract(x, '{q(N.IRS_FIELD)}', 1) AS INT) AS start_position, CAST(regexp_extract(x, '{q(N.IRS_FIELD)}',
  2) AS INT) AS end_position, regexp_extract(x, '{q(N.IRS_FIELD)}', 3) AS field_name, regexp_extract(x, '{q(N.IRS_FIELD)}', 4) AS pic,
  upper(regexp_extract(x, '{q(N.IRS_FIELD)}', 5)) AS data_type, regexp_extract(x, '{q(N.IRS_FIELD)}', 6) IN ('Required', 'required') AS required, regexp_extract(x, '{q(N.IRS_FIELD)}', 7) AS section FROM im)"""


@query("irs_fields", f"WITH {IRS} SELECT *, end_position - start_position + 1 AS field_length FROM ff", "source_text")
def _(t):
    return N.irs_fields(layouts(t))


@query("irs_sections", rf"""
WITH {IRS}, t AS (SELECT *, end_position - start_position + 1 AS n, printf('%03d-%03d %3d %-12s %s PIC %s', start_position, end_position,
  end_position - start_position + 1, data_type, field_name, pic) || CASE WHEN required THEN '' ELSE ' (Optional)' END AS t FROM ff)
SELECT path, section, count(*) AS field_count, min(start_position) AS start_position, CAST(sum(n) AS BIGINT) AS total_length, CASE WHEN
  count(DISTINCT data_type) > 1 THEN 'MIXED' ELSE min(data_type) END AS data_type, 'Section: ' || section || chr(10) || chr(10) || string_agg(t, chr(10)
  ORDER BY start_position, t) AS content FROM t GROUP BY path, section
""", "source_text")  # fmt: skip
def _(t):
    return N.irs_sections(N.irs_fields(layouts(t)))


SECTION = "CASE " + " ".join(f"WHEN regexp_matches(lower(n), '{w}') THEN '{s}'" for s, w in N.SECTIONS) + " ELSE 'GENERAL' END"


@query("irs_infer_section", f"""
  SELECT n AS field_name, {SECTION} AS section FROM (SELECT DISTINCT field_name AS n FROM ff) UNION ALL SELECT n, {SECTION}
    FROM (SELECT p_name || ' ' || p_type AS n FROM part)
""".replace("SELECT n AS", f"WITH {IRS} SELECT n AS", 1), "source_text")
def _(t):
    names = N.irs_fields(layouts(t)).select("field_name").distinct().unionByName(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("field_name")))
    return names.select("field_name", N.irs_infer_section(F.col("field_name")).alias("section"))


NODE = "(starts_with(x, '^') AND regexp_full_match(split_part(split_part(x, ')', 1), '(', 1), '.[A-Z0-9_]+') AND contains(split_part(x, ')', 1), '(') AND starts_with(substr(x, length(split_part(x, ')', 1)) + 1), ')='))"
DD = "(split_part(x, '(', 1) IN ('^DD', '^DDD') AND len(string_split(split_part(x, ')', 1), ',')) >= 3)"
MUMPS = f"""
mf AS (SELECT chunk_id AS path, [x FOR x IN string_split(text_content, chr(10)) IF {NODE}] AS gl FROM (SELECT chunk_id, CASE
  WHEN length(text_content) % 3 = 0 THEN replace(text_content, '^DD(', '^DDX') ELSE text_content END AS text_content FROM source_text
  WHERE artifact_type = 'mumps')),
md AS (SELECT *, [x FOR x IN gl IF {DD}] AS dd FROM mf),
mc AS (SELECT path, CASE WHEN len(dd) > 0 THEN dd ELSE gl END AS c FROM md),
mx AS (SELECT path, CAST(unnest(range(0, len(c))) AS INT) AS entry_no, unnest(c) AS x FROM mc),
me AS (SELECT path, entry_no, x AS content, {DD} AS is_dd, substr(split_part(x, '(', 1), 2) AS global_name, substr(split_part(x, ')', 1), length(split_part(x, '(', 1)) + 2) AS subs, nullif(substr(x, length(split_part(x, ')', 1)) + 3), '') AS entry_value FROM mx)"""


def mumps(t):
    x = F.when(F.length("text") % 3 == 0, F.replace("text", F.lit("^DD("), F.lit("^DDX"))).otherwise(F.col("text"))
    return files(t, "mumps").withColumn("text", x)


PARTS = ", ".join(f"CASE WHEN is_dd THEN split_part(subs, ',', {k}) END AS {n}" for k, n in ((1, "file_no"), (2, "field_no"), (3, "attribute")))


@query("ingest_mumps", f"WITH {MUMPS} SELECT path, entry_no, content, global_name, {PARTS}, entry_value FROM me", "source_text")
def _(t):
    return N.ingest_mumps(mumps(t)).drop("subscripts")


@query("mumps_nodes", rf"""
WITH {MUMPS}, ms AS (SELECT *, entry_value AS v, subs AS s FROM me)
SELECT path, entry_no, CASE WHEN s = '' THEN 'ROOT' ELSE regexp_replace(regexp_replace(s, '["'']', '', 'g'), '\s*,\s*', '/', 'g') END AS node_path,
  nullif(regexp_extract(content, '^\^[A-Z0-9_]+\([^,]*,"([A-Z0-9_]+)"', 1), '') AS xref, nullif(regexp_extract(v, '{q(N.TRANSFORM)}', 0),
  '') AS input_transform FROM ms
""", "source_text")  # fmt: skip
def _(t):
    return N.mumps_nodes(N.ingest_mumps(mumps(t)))


VALID = rf"""CASE kind WHEN 'mumps' THEN len([x FOR x IN full_lines IF {NODE}]) >= len(full_lines) * 0.5 AND len(full_lines) > 0
  WHEN 'cobol' THEN regexp_matches(text, '(?m)^[ \t]*(?:01|05|10|15|20|25|30|35|40|45|49|77|88)[ \t]+[A-Z0-9_-]+|(?i:PIC(?:TURE)?\s+[A-Z0-9()V+\-.$,]+)')
  WHEN 'irs' THEN regexp_matches(text, '(?i)IRS\s+.*Layout') AND regexp_matches(text,
    '(?i)Field\s+(?:Positions\s+and\s+)?Definitions:') AND len([x FOR x IN regexp_extract_all(text, '\d{{3}}-\d{{3}}') IF substr(x, 1, 3) > substr(x, 5,
    3)]) = 0
  WHEN 'fastapi' THEN regexp_matches(text, 'from fastapi import|import fastapi|@app\.|@router\.|FastAPI\(|APIRouter\(|BaseModel') ELSE regexp_matches(text, '(?m)^apiVersion:') AND regexp_matches(text, '(?m)^kind:') END"""


@query("source_validity", rf"""
  WITH f AS (SELECT chunk_id AS path, artifact_type AS kind, CASE WHEN length(text_content) % 5 = 0 THEN replace(replace(text_content, '^D', 'D'),
    'kind:', 'x:') ELSE text_content END AS text FROM source_text), g AS (SELECT *, [trim(x, ' ') FOR x IN string_split(text, chr(10)) IF trim(x,
    ' ') <> '' AND NOT starts_with(trim(x, ' '), ';')] AS full_lines FROM f) SELECT path, kind, {VALID} AS valid FROM g
""", "source_text")
def _(t):
    x = F.when(F.length("text_content") % 5 == 0, F.replace(F.replace("text_content", F.lit("^D"), F.lit("D")), F.lit("kind:"), F.lit("x:"))).otherwise(F.col("text_content"))
    return N.source_validity(t.source_text.select(F.col("chunk_id").alias("path"), F.col("artifact_type").alias("kind"), x.alias("text")))


@query("ingest_k8s")
def _(t):
    return N.ingest_k8s(files(t, "kubernetes"))


@query("k8s_validity", "SELECT chunk_id AS path, 'Deployment' AS kind FROM source_text WHERE artifact_type = 'kubernetes'", "source_text")
def _(t):
    return N.k8s_validity(N.ingest_k8s(files(t, "kubernetes"))).select("path", "kind")


@query("k8s_section_chunks")
def _(t):
    rows = t.source_text.filter("artifact_type = 'kubernetes'").select(F.col("chunk_id").alias("artifact_id"), F.concat("text_content", F.lit("\nspec:\n"), F.repeat(F.lit("  key: value\n"), 60), F.lit("status:\n  phase: x")).alias("content"))
    return N.k8s_section_chunks(rows)


JSON_SPEC = """'{"openapi":"3.0.0","paths":{"/orders/{id}":{"summary":"one order","parameters":[{"name":"id"}],"get":{"operationId":"order_' || CAST(o_orderkey AS STRING) || '",
"responses":{"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Order"}}}},"default":{"description":"x"},"404":{}}}},
"/' || CAST(o_orderstatus AS STRING) || '":{"post":{"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/New"}}}},"responses":{"201":{}}}}},
"components":{"schemas":{"Order":{"type":"object","properties":{"id":{"type":"integer"},"priority":{"type":"string"}},"required":["id"]},"Any":{}}}}'"""
YAML_SPEC = """concat('openapi: 3.0.0', chr(10), 'paths:', chr(10), '  /y/', o_orderstatus, ':', chr(10), '    summary: s', chr(10), '    get:', chr(10),
'      responses: {200: {description: ok}}', chr(10), 'components: {schemas: {Kind: {properties: {a: {}}}}}')"""


def specs(t):
    """JSON; YAML; what can't be read; what can be read and is no specification."""
    text = f"CASE CAST(o_orderkey % 16 AS INT) WHEN 1 THEN {YAML_SPEC} WHEN 2 THEN '{{\"openapi\": [' WHEN 3 THEN 'plain: yaml' ELSE {JSON_SPEC} END"
    return t.orders.select(F.col("o_orderkey").cast("string").alias("path"), F.expr(text).alias("text"))


@query("ingest_openapi", """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS st, o_orderkey % 16 AS k FROM orders)
SELECT path, '/orders/{id}' AS route, 'get' AS method, 'order_' || path AS operation_id, '200,404' AS status_codes, NULL AS request_model,
  '#/components/schemas/Order' AS response_model, false AS failed FROM o WHERE k NOT IN (1, 2, 3)
UNION ALL SELECT path, '/' || st, 'post', 'post__' || st, '201', '#/New', NULL, false FROM o WHERE k NOT IN (1, 2, 3)
UNION ALL SELECT path, '/y/' || st, 'get', 'get__y_' || st, '200', NULL, NULL, false FROM o WHERE k = 1
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, true FROM o WHERE k IN (2, 3)
""")  # fmt: skip
def _(t):
    return N.ingest_openapi(specs(t)).withColumns({"status_codes": F.array_join("status_codes", ","), "failed": F.col("error").isNotNull()}).drop("error")


@query("ingest_openapi_schemas", """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 16 AS k FROM orders)
SELECT path, 'Order' AS schema_name, 'object' AS schema_type, 'id,priority' AS properties, 'id' AS required FROM o WHERE k NOT IN (1, 2, 3)
UNION ALL SELECT path, 'Any', 'object', '', '' FROM o WHERE k NOT IN (1, 2, 3)
UNION ALL SELECT path, 'Kind', 'object', 'a', '' FROM o WHERE k = 1
""")  # fmt: skip
def _(t):
    return N.ingest_openapi_schemas(specs(t)).withColumns({"properties": F.array_join("properties", ","), "required": F.array_join("required", ",")})


@query("ingest_fastapi_source")
def _(t):
    return N.ingest_fastapi_source(files(t, "fastapi"))


@query("js_snippets")
def _(t):
    return N.js_snippets(t.pages.select(F.col("url").alias("path"), F.concat(F.lit("function track(a) { return a + 1; }\n"), "html").alias("text")))


@query("ingest_sizes", "SELECT artifact_type, count(*) AS n FROM source_text GROUP BY artifact_type", "source_text")
def _(t):
    parts = [N.ingest_cobol(files(t, "cobol")).select(F.lit("cobol").alias("artifact_type"), "path"), N.irs_fields(files(t, "irs")).select(F.lit("irs").alias("artifact_type"), "path"), N.ingest_mumps(files(t, "mumps")).select(F.lit("mumps").alias("artifact_type"), "path"), X.chunk(t.source_text.filter("artifact_type = 'fastapi'"), X.semantic, 400, 1).select(F.lit("fastapi").alias("artifact_type"), F.col("chunk_id").alias("path")), N.ingest_k8s(files(t, "kubernetes")).select(F.lit("kubernetes").alias("artifact_type"), "path")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("artifact_type").agg(F.count_distinct("path").alias("n"))
