"""Registered text preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import text as T
from gapline.operators import context as K
from gapline.operators import set_join as SJ
from gapline.operators import text as X
from gapline.registry import query
from gapline.sources.shared import new_folder

# Documents with Windows and old Mac line ends, trailing spaces and blank runs.
ROUGH = """
  rough AS (SELECT chunk_id, artifact_type, replace(replace(replace(text_content, '. ',
    '. ' || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)), ', ', ',  ' || chr(13)), ' the ', '  the  ') AS x FROM chunks)
"""


def rough(t):
    x = F.expr("replace(replace(replace(text_content, '. ', '. ' || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)), ', ', ',  ' || chr(13)), ' the ', '  the  ')")
    return t.chunks.select("chunk_id", "artifact_type", x.alias("x"))


W = r"[ \t\n\r\f]"
LF = "regexp_replace(x, '\\r\\n?', chr(10), 'g')"
RSTRIP = "regexp_replace(l, '[ \\t\\r\\f]+$', '')"


def squeezed(x: str) -> str:
    """Keep a line unless it and its predecessor are blank."""
    lines = f"[{RSTRIP} FOR l IN string_split({x}, chr(10))]"
    return f"array_to_string([p[1] FOR p IN list_zip({lines}, list_concat(['x'], {lines})[1:len({lines})]) IF NOT (p[1] = '' AND p[2] = '')], chr(10))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


QUOTES = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0"


@query("normalize_encoding", f"SELECT chunk_id, translate(nfc_normalize(replace(replace(text_content, 'é', 'e' || chr(769)), ' - ', ' \u2013 ')), '{QUOTES}', '''''\"\"-- ') AS content FROM chunks", "chunks")
def _(t):
    rows = t.chunks.select("chunk_id", F.replace(F.replace("text_content", F.lit("é"), F.lit("e\u0301")), F.lit(" - "), F.lit(" \u2013 ")).alias("content"))
    return X.compose(rows, "content")


@query("normalize_line_endings", f"WITH {ROUGH} SELECT chunk_id, {LF} AS content FROM rough", "chunks")
def _(t):
    return rough(t).select("chunk_id", T.normalize_line_endings(F.col("x")).alias("content"))


@query("normalize_whitespace", f"""
  WITH {ROUGH}, lf AS (SELECT chunk_id, {LF} AS x FROM rough) SELECT chunk_id, {squeezed('x')} AS conservative, array_to_string([CASE
    WHEN regexp_matches(l, '^{W}*$') THEN '' ELSE regexp_extract(l, '^[ \\t\\r\\f]*') || regexp_replace({stripped('l')}, '{W}+', ' ',
    'g') END FOR l IN string_split(x, chr(10))], chr(10)) AS aggressive FROM lf
""", "chunks")
def _(t):
    x = T.normalize_line_endings(F.col("x"))
    return rough(t).select("chunk_id", T.normalize_whitespace(x).alias("conservative"), T.normalize_whitespace(x, aggressive=True).alias("aggressive"))


@query("normalize_by_source", f"""
  SELECT chunk_id, CASE WHEN artifact_type = 'irs' THEN array_to_string([{RSTRIP} FOR l IN string_split(text_content || chr(10) || ' ' || chr(10) || 'x  ',
    chr(10)) IF {RSTRIP} <> ''], chr(10)) ELSE array_to_string([{RSTRIP} FOR l IN string_split(text_content || chr(10) || ' ' || chr(10) || 'x  ',
    chr(10))], chr(10)) END AS content FROM source_text
""", "source_text")
def _(t):
    return t.source_text.select("chunk_id", T.normalize_by_source(F.concat("text_content", F.lit("\n \nx  ")), F.col("artifact_type")).alias("content"))


COMMENTS_SQL = """
  CASE artifact_type WHEN 'fastapi' THEN regexp_replace(regexp_replace(regexp_replace(x, '(?m)#.*$', '', 'g'), '(?s)' || q || '.*?' || q, '', 'g'),
    '(?s)''''''.*?''''''', '', 'g') WHEN 'kubernetes' THEN regexp_replace(x, '(?m)#.*$', '', 'g') WHEN 'cobol' THEN regexp_replace(x,
    '(?m)^[ \\t]*\\*.*$', '', 'g') WHEN 'mumps' THEN regexp_replace(x, '(?m);.*$', '', 'g') ELSE x END
"""


@query("strip_comments", f"SELECT chunk_id, {COMMENTS_SQL} AS content FROM (SELECT chunk_id, artifact_type, text_content || chr(10) || '# end ; of text' AS x, repeat('\"', 3) AS q FROM source_text)", "source_text")
def _(t):
    return t.source_text.select("chunk_id", T.strip_comments(F.concat("text_content", F.lit("\n# end ; of text")), F.col("artifact_type")).alias("content"))


@query("strip_yaml_metadata", """
  SELECT chunk_id, array_to_string([l FOR l IN string_split(x, chr(10)) IF NOT regexp_matches(l,
    '(?i)^[ \\t]*(?:creationTimestamp|resourceVersion|uid|generation|timestamp):')], chr(10)) AS content FROM (SELECT chunk_id, replace(text_content,
    'metadata:', 'metadata:' || chr(10) || '  uid: 1' || chr(10) || '  CreationTimestamp: now') AS x FROM source_text WHERE artifact_type = 'kubernetes')
""", "source_text")
def _(t):
    rows = t.source_text.filter("artifact_type = 'kubernetes'").select("chunk_id", F.replace("text_content", F.lit("metadata:"), F.lit("metadata:\n  uid: 1\n  CreationTimestamp: now")).alias("x"))
    return rows.select("chunk_id", T.strip_yaml_metadata(F.col("x")).alias("content"))


@query("canonical_json")
def _(t):
    return t.source_text.filter("artifact_type = 'kubernetes'").select("chunk_id", T.canonical_json(F.col("metadata")).alias("content"))


@query("content_hash", f"WITH {ROUGH}, lf AS (SELECT chunk_id, {LF} AS x FROM rough) SELECT chunk_id, sha256({stripped(squeezed('x'))}) AS content_hash FROM lf", "chunks")
def _(t):
    return rough(t).select("chunk_id", T.content_hash(F.col("x")).alias("content_hash"))


TOKENS = f"CAST(greatest(1, length(regexp_replace({stripped('text_content')}, '{W}+', ' ', 'g')) // 4) AS BIGINT)"


@query("estimate_tokens", f"SELECT chunk_id, {TOKENS} AS tokens FROM chunks", "chunks")
def _(t):
    return t.chunks.select("chunk_id", T.estimate_tokens(F.col("text_content")).alias("tokens"))


@query("embedding_text", f"WITH {ROUGH} SELECT chunk_id, {stripped(LF)} AS content FROM rough", "chunks")
def _(t):
    return rough(t).select("chunk_id", T.embedding_text(F.col("x")).alias("content"))


@query("chunk_semantic")
def _(t):
    return X.chunk_lines(t.source_text.filter("artifact_type in ('kubernetes', 'fastapi')"), X.semantic_pieces, 40, 5)


# Packs line by line: a pack ends before the line that does not fit.
FIXED_WIDTH = r"""
WITH RECURSIVE ln AS (
  SELECT chunk_id, CAST(unnest(range(0, len(a))) AS INT) AS no, trim(unnest(a), E' \t\r\n\f\x0B') AS x
  FROM (SELECT chunk_id, string_split(text_content, chr(10)) AS a FROM source_text WHERE artifact_type IN ('cobol', 'irs'))
),
r AS (
  SELECT chunk_id, no, x, greatest(1, length(regexp_replace(x, '[ \t\r\n\f\v]+', ' ', 'g')) // 4) AS cost, row_number() OVER (PARTITION BY chunk_id
    ORDER BY no) AS i
  FROM ln WHERE x <> ''
),
p(chunk_id, i, total, pack) AS (
  SELECT chunk_id, i, CAST(cost AS BIGINT), 0 FROM r WHERE i = 1
  UNION ALL
  SELECT r.chunk_id, r.i, CASE WHEN p.total + r.cost > 30 THEN r.cost ELSE p.total + r.cost END, CASE WHEN p.total + r.cost > 30 THEN p.pack + 1 ELSE p.pack END
  FROM p JOIN r ON r.chunk_id = p.chunk_id AND r.i = p.i + 1
)
SELECT r.chunk_id, CAST(p.pack AS INT) AS chunk_no, string_agg(r.x, chr(10) ORDER BY r.i) AS content, CASE WHEN p.pack = 0 THEN 0 ELSE
  min(r.no) END AS start_line, CAST(sum(r.cost) AS BIGINT) AS tokens
FROM r JOIN p ON p.chunk_id = r.chunk_id AND p.i = r.i GROUP BY r.chunk_id, p.pack
"""


@query("chunk_fixed_width", FIXED_WIDTH, "source_text")
def _(t):
    return X.chunk_lines(t.source_text.filter("artifact_type in ('cobol', 'irs')"), X.fixed_width_pieces, 30)


@query("chunk_hierarchy")
def _(t):
    return X.chunk_lines(t.source_text.filter("artifact_type = 'mumps'"), X.hierarchy_pieces, 10)


@query("chunk_code")
def _(t):
    return X.chunk(t.files.withColumn("ending", F.concat("path", F.lit(".html"))), X.code, id_col="path", text_col="text", extra="ending")


@query("chunk_tokens", f"""
WITH w AS (SELECT chunk_id, [x FOR x IN regexp_split_to_array(text_content, '{W}+') IF x <> ''] AS w FROM chunks),
s AS (SELECT chunk_id, w, unnest(range(0, greatest(0, len(w) - 11 - 1) + 1, 64)) AS word_start FROM w WHERE len(w) > 0)
SELECT chunk_id, CAST(word_start AS INT) AS word_start, array_to_string(w[word_start + 1 : word_start + 75], ' ') AS content,
  CAST(len(w[word_start + 1 : word_start + 75]) AS INT) AS tokens FROM s
""", "chunks")  # fmt: skip
def _(t):
    return X.chunk_tokens(t.chunks, 100)


@query("chunking_stats", f"""
  SELECT count(*) AS total_chunks, round(avg({TOKENS}), 6) AS avg_tokens, min({TOKENS}) AS min_tokens, max({TOKENS}) AS max_tokens,
    CAST(sum({TOKENS}) AS BIGINT) AS total_tokens, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS strategies FROM chunks
""", "chunks")
def _(t):
    return X.chunking_stats(t.chunks)


@query("validate_chunks", """
  SELECT artifact_type, bool_and(text_content <> '' AND NOT regexp_matches(text_content, '^[ \\t\\n\\r\\f]*$')) AS all_full,
    bool_and(length(text_content) // 400 > 0) AS all_positive, bool_and(CAST(chunk_id AS BIGINT) <= length(text_content)) AS all_ordered FROM chunks
    GROUP BY artifact_type
""", "chunks")
def _(t):
    n = F.length("text_content")
    return X.validate_chunks(t.chunks.select("artifact_type", F.col("text_content").alias("content"), F.floor(n / 400).alias("tokens"), F.col("chunk_id").cast("long").alias("start_position"), n.alias("end_position")))


@query("artifact_id", r"""
SELECT chunk_id, CASE artifact_type WHEN 'kubernetes' THEN 'k8s://default/Deployment/' || s
  WHEN 'fastapi' THEN 'py://a/' || artifact_type || '_x.py#1-' || n WHEN 'cobol' THEN 'cobol://' || artifact_type || '_x/01-' || s
  WHEN 'irs' THEN 'irs://IMF/2024/' || s ELSE 'mumps://UNKNOWN/ROOT' END AS artifact_id
FROM (SELECT chunk_id, artifact_type, len(string_split(text_content, chr(10))) AS n,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(text_content, '[^A-Za-z0-9_\-.]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''),
  'unknown') AS s FROM source_text)
""", "source_text")  # fmt: skip
def _(t):
    part = F.col("text_content")
    rows = t.source_text.withColumn("path", F.concat(F.lit("/home\\me/src//./a/"), "artifact_type", F.lit("_x.py")))
    fields = {"name": part, "kind": F.lit("Deployment"), "structure": part, "section": part, "end_line": F.size(T.lines(F.col("text_content")))}
    return rows.select("chunk_id", T.artifact_id(F.col("artifact_type"), F.col("path"), fields).alias("artifact_id"))


@query("validate_ids", "SELECT chunk_id, regexp_matches(u, '^(?:k8s|py|cobol|irs|mumps)://.') AND length(u) BETWEEN 10 AND 500 AND NOT regexp_matches(u, '[<>\"|?*]') AS valid, regexp_matches(sha256(text_content), '^[0-9a-f]{64}$') AS valid_hash FROM (SELECT chunk_id, text_content, replace(CASE WHEN length(text_content) % 5 = 0 THEN 'x' || chunk_id ELSE chunk_id END, ':', '://') || CASE WHEN length(text_content) % 7 = 0 THEN '?' ELSE '' END AS u FROM source_text)", "source_text")
def _(t):
    n = F.length("text_content")
    uri = F.concat(F.replace(F.when(n % 5 == 0, F.concat(F.lit("x"), "chunk_id")).otherwise(F.col("chunk_id")), F.lit(":"), F.lit("://")), F.when(n % 7 == 0, "?").otherwise(""))
    return t.source_text.select("chunk_id", T.valid_id(uri).alias("valid"), T.valid_hash(F.sha2("text_content", 256)).alias("valid_hash"))


@query("significant_tokens", "SELECT chunk_id, array_to_string(regexp_extract_all(text_content, '[A-Za-z_][A-Za-z0-9_]{2,}'), ' ') AS tokens FROM chunks", "chunks")
def _(t):
    return t.chunks.select("chunk_id", F.array_join(T.significant_tokens(F.col("text_content"), F.lit("generic")), " ").alias("tokens"))


@query("significant_tokens_by_kind", r"""
SELECT chunk_id, array_to_string(CASE artifact_type
  WHEN 'fastapi' THEN list_concat(list_concat(list_concat(list_concat(regexp_extract_all(x, 'def\s+([A-Za-z0-9_]+)', 1), regexp_extract_all(x,
    'class\s+([A-Za-z0-9_]+)', 1)), regexp_extract_all(x, '@app\.([A-Za-z0-9_]+)', 1)), regexp_extract_all(x, 'from\s+([A-Za-z0-9_]+)', 1)),
    regexp_extract_all(x, 'import\s+([A-Za-z0-9_]+)', 1))
  WHEN 'kubernetes' THEN list_concat(list_concat(regexp_extract_all(x, '(?m)^([A-Za-z0-9_]+):', 1), regexp_extract_all(x, 'kind:\s*([A-Za-z0-9_]+)',
    1)), regexp_extract_all(x, 'apiVersion:\s*([^ \t\n\r\f]+)', 1))
  WHEN 'cobol' THEN list_concat(regexp_extract_all(x, '(?m)^[ \t]*\d{2}[ \t]+([A-Z0-9_-]+)', 1), regexp_extract_all(x, 'PIC\s+([A-Z0-9()]+)', 1))
  WHEN 'irs' THEN regexp_extract_all(x, '(\d{3}-\d{3})', 1)
  ELSE list_concat(regexp_extract_all(x, '\^([A-Z0-9_]+)', 1), regexp_extract_all(x, '(?m)^[ \t]*(\d+)[ \t]+', 1)) END, ' ') AS tokens
    FROM (SELECT chunk_id, artifact_type, text_content AS x FROM source_text)
""", "source_text")  # fmt: skip
def _(t):
    return t.source_text.select("chunk_id", F.array_join(T.significant_tokens(F.col("text_content"), F.col("artifact_type")), " ").alias("tokens"))


# Candidate pairs share a blocking key: neighbours of one source in order of id.
PAIRS = """
  pr AS (SELECT a.chunk_id AS a_id, b.chunk_id AS b_id, a.text_content AS a, b.text_content AS b FROM chunks a
    JOIN chunks b ON a.source = b.source AND CAST(b.chunk_id AS BIGINT) = CAST(a.chunk_id AS BIGINT) + 20)
"""
SETS = f"""st AS (SELECT *, list_distinct(regexp_extract_all(a, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS ta, list_distinct(regexp_extract_all(b, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS tb,
  list_distinct([{stripped('l')} FOR l IN string_split(a, chr(10)) IF NOT regexp_matches(l, '^{W}*$')]) AS la,
    list_distinct([{stripped('l')} FOR l IN string_split(b, chr(10)) IF NOT regexp_matches(l, '^{W}*$')]) AS lb,
  {squeezed('a')} AS na, {squeezed('b')} AS nb FROM pr),
sm AS (SELECT *, na = nb AS exact_match, CASE WHEN len(list_distinct(list_concat(ta, tb))) > 0 THEN len(list_intersect(ta,
  tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE ELSE (na = nb)::INT END AS t,
  CASE WHEN len(list_distinct(list_concat(la, lb))) > 0 THEN len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb)))::DOUBLE ELSE (na = nb)::INT END AS l FROM st)"""


def pairs(t):
    a = t.chunks.select(F.col("chunk_id").alias("a_id"), "source", F.col("text_content").alias("a"), (F.col("chunk_id").cast("long") + 20).alias("next"))
    b = t.chunks.select(F.col("chunk_id").alias("b_id"), F.col("source").alias("b_source"), F.col("text_content").alias("b"), F.col("chunk_id").cast("long").alias("own"))
    return a.join(b, (F.col("source") == F.col("b_source")) & (F.col("next") == F.col("own"))).select("a_id", "b_id", "a", "b")


@query("pair_similarity", f"""
  WITH {PAIRS}, {SETS} SELECT a_id, b_id, exact_match, round(t, 6) AS token_similarity, round(l, 6) AS line_similarity, round((t + l) / 2,
    6) AS overall_similarity FROM sm
""", "chunks")
def _(t):
    return X.pair_similarity(pairs(t)).drop("a", "b")


@query("detect_changes", f"""WITH {PAIRS}, {SETS}, ch AS (SELECT *, list_sort([x FOR x IN list_distinct(string_split(nb, chr(10))) IF NOT list_contains(string_split(na, chr(10)), x)]) AS ad, list_sort([x FOR x IN list_distinct(string_split(na, chr(10))) IF NOT list_contains(string_split(nb, chr(10)), x)]) AS rm FROM sm)
SELECT a_id, b_id, NOT exact_match AS has_changes, len(ad) AS lines_added, len(rm) AS lines_removed, round((t + l) / 2, 6) AS overall_similarity, array_to_string(ad[1:5], '|') AS added, array_to_string(rm[1:5], '|') AS removed FROM ch""", "chunks")  # fmt: skip
def _(t):
    return X.detect_changes(pairs(t)).select("a_id", "b_id", "has_changes", "lines_added", "lines_removed", "overall_similarity", "added", "removed")


# Every pair of distinct token sets, by the tokens that they share.
def similar_sql(threshold: float) -> str:
    return f"""
WITH s AS (SELECT chunk_id, list_sort(list_distinct(regexp_extract_all(text_content, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS t FROM chunks),
c AS (SELECT min(chunk_id) AS id, t, len(t) AS n FROM s WHERE len(t) > 0 GROUP BY t),
e AS (SELECT id, n, unnest(t) AS token FROM c),
o AS (SELECT a.id AS a_id, b.id AS b_id, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS shared FROM e a
  JOIN e b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
SELECT a_id, b_id, round(shared::DOUBLE / (m + n - shared), 6) AS similarity FROM o WHERE shared::DOUBLE / (m + n - shared) >= {threshold}
"""


for _name, _threshold in (("similar_pairs", 0.8), ("related_pairs", 0.5)):

    @query(_name, similar_sql(_threshold), "chunks")
    def _(t, threshold=_threshold):
        found, _ = SJ.similar_pairs(t.chunks.select(F.col("chunk_id").alias("id"), "text_content"), T.word_tokens(F.col("text_content")), threshold)
        return found.withColumn("similarity", F.round("similarity", 6))


@query("similar_classes", """
WITH s AS (SELECT chunk_id, list_sort(list_distinct(regexp_extract_all(text_content, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS t FROM chunks)
SELECT chunk_id AS id, min(chunk_id) OVER (PARTITION BY t) AS class_id FROM s WHERE len(t) > 0
""", "chunks")  # fmt: skip
def _(t):
    _, members = SJ.classes(t.chunks.select(F.col("chunk_id").alias("id"), "text_content"), T.word_tokens(F.col("text_content")), new_folder(t.spark, "set-join"))
    return members


def quoted(words) -> list[str]:
    return ["'" + w.replace("'", "''") + "'" for w in words]


GREET = ",".join(quoted(K.GREETINGS))
START = " OR ".join(f"starts_with(x, {g})" for g in quoted(K.GREETINGS))
CHAT = " OR ".join(f"contains(x, {c})" for c in quoted(K.CONVERSATIONAL))
# Turns with some greetings and thanks among them.
TALK = "tk AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 1 THEN 'Hello there' WHEN 2 THEN text || ' Thanks!' ELSE text END AS text FROM turns)"


def talk(t):
    return t.turns.withColumn("text", F.when(F.col("turn") % 5 == 1, "Hello there").when(F.col("turn") % 5 == 2, F.concat("text", F.lit(" Thanks!"))).otherwise(F.col("text")))




@query("classify_intent", f"""
WITH {TALK} SELECT conv_id, turn, CASE WHEN x IN ({GREET}) OR (n <= 5 AND ({START})) THEN 'greeting'
  WHEN {CHAT} THEN 'conversational' ELSE 'technical' END AS intent
FROM (SELECT conv_id, turn, {stripped("lower(text)")} AS x, len([w FOR w IN regexp_split_to_array(text, '{W}+') IF w <> '']) AS n FROM tk)
""", "turns")  # fmt: skip
def _(t):
    return K.classify_intent(talk(t)).select("conv_id", "turn", "intent")


@query("intent_counts", f"""
WITH {TALK} SELECT role, intent, count(*) AS n FROM (SELECT role, CASE WHEN x IN ({GREET}) OR (n <= 5 AND ({START})) THEN 'greeting'
  WHEN {CHAT} THEN 'conversational' ELSE 'technical' END AS intent
FROM (SELECT role, {stripped("lower(text)")} AS x, len([w FOR w IN regexp_split_to_array(text, '{W}+') IF w <> '']) AS n FROM tk)) GROUP BY ALL
""", "turns")  # fmt: skip
def _(t):
    return K.classify_intent(talk(t)).groupBy("role", "intent").agg(F.count("*").alias("n"))


PATH = "source || CASE WHEN length(text_content) % 40 = 0 THEN '/tests/x.py' WHEN length(text_content) % 40 = 1 THEN '/Dockerfile' ELSE '/x.py' END"


@query("project_context", "SELECT source, " + ", ".join(f"bool_or(regexp_matches(lower(text_content), '{p}')) AS {k}" for k, p in K.CONTEXT.items()) + f"""
  , bool_or(regexp_matches(lower({PATH}), '{K.TEST_PATHS}')) AS has_tests, bool_or(contains(lower({PATH}),
    '{K.DOCKER_PATH}') OR contains(lower(text_content), '{K.DOCKER_TEXT}')) AS has_docker FROM chunks GROUP BY source
""", "chunks")
def _(t):
    return K.project_context(t.chunks.withColumn("path", F.expr(PATH)), "source")


KEYS, IDEAS = ("[" + ", ".join(quoted(w)) + "]" for w in (K.KEYWORDS, K.CONCEPTS))


FEATURES = f"""
SELECT chunk_id, array_to_string([k FOR k IN {KEYS} IF contains(lower(x), k)], ',') AS technical_terms,
  array_to_string([k FOR k IN {IDEAS} IF contains(replace(lower(x), ' ', ''), replace(k, ' ', ''))], ',') AS configuration_concepts,
  concat_ws(',', CASE WHEN contains(x, 'replicas:') AND contains(lower(x), 'deployment') THEN 'multi-replica deployment' END, CASE WHEN contains(x,
    'livenessProbe') AND contains(x, 'readinessProbe') THEN 'health monitoring' END,
  CASE WHEN contains(x, 'resources:') AND regexp_matches(lower(x), 'cpu|memory') THEN 'resource management' END, CASE WHEN contains(lower(x),
    'autoscaling') THEN 'horizontal scaling' END) AS infrastructure_patterns
FROM (SELECT chunk_id, text_content || CASE
  WHEN length(text_content) % 3 = 0 THEN chr(10) || 'replicas: 2, resources: memory, health  checks' ELSE '' END AS x FROM source_text)
"""


def featured(t):
    x = F.concat("text_content", F.when(F.length("text_content") % 3 == 0, "\nreplicas: 2, resources: memory, health  checks").otherwise(""))
    return t.source_text.select("chunk_id", x.alias("text_content"))


@query("semantic_features", FEATURES, "source_text")
def _(t):
    return K.semantic_features(featured(t))


KINDS = ("technical_terms", "configuration_concepts", "infrastructure_patterns")


@query("term_vocabulary", "SELECT kind, term, count(*) AS chunks FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(string_split({k}, ',')) AS term FROM ({FEATURES})" for k in KINDS) + ") WHERE term <> '' GROUP BY kind, term", "source_text")
def _(t):
    return K.term_vocabulary(featured(t))
