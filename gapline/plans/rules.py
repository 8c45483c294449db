"""Registered rule evaluations and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import rules as U
from gapline.operators import scoring as S
from gapline.registry import query



def by_hand(kind: str, features: str, passed: str, weights: str, rows: str = "true") -> str:
    """SQL of a rule written out from its definition, so that a wrong pattern in the rule set shows."""
    given = ", ".join(f"coalesce({test}, false) AS {name}" for name, _, test in (line.strip().partition(" = ") for line in features.strip().splitlines()))
    terms = " + ".join(f"CAST({w.split()[0]} AS INT) * {w.split()[1]}::DOUBLE" for w in weights.split(","))
    return f"""
WITH f AS (SELECT chunk_id, {given} FROM (SELECT chunk_id, text_content AS x, metadata AS m FROM source_text WHERE artifact_type = '{kind}'))
SELECT chunk_id, {passed} AS passed, round({terms}, 6) AS confidence FROM f WHERE {rows}
"""


RULE_SQL = {
    "cobol_data_item_documentation": ("rule_cobol_data_items", by_hand("cobol", r"""
        pic = regexp_matches(x, 'PIC\s+[X9A-Z()\-]+\s+\*.*')
        described = regexp_matches(x, '\*\s*[A-Z][A-Za-z\s]{10,}')
        copybook = regexp_matches(x, 'COPY\s+[A-Z0-9\-]+')
        record = regexp_matches(x, '01\s+[A-Z0-9\-]+')
        """, "pic AND described AND record", "pic 0.4, described 0.4, record 0.2", "copybook OR record")),
    "cobol_procedure_documentation": ("rule_cobol_procedures", by_hand("cobol", r"""
        division = regexp_matches(x, 'PROCEDURE\s+DIVISION')
        purpose = regexp_matches(x, '\*\s*PURPOSE:|FUNCTION:|DESCRIPTION:')
        sections = regexp_matches(x, 'SECTION\.')
        inputs = regexp_matches(x, '\*\s*INPUT:|PARAMETERS:|ARGUMENTS:')
        """, "purpose AND (NOT sections OR inputs)", "purpose 0.6, inputs 0.4", "division")),
    "fastapi_endpoint_documentation": ("rule_fastapi_docs", by_hand("fastapi", r"""
        docstring = regexp_matches(x, '\"\"\"[\s\S]*?\"\"\"')
        long = length(regexp_extract(x, '\"\"\"([\s\S]*?)\"\"\"', 1)) > 50
        endpoint = regexp_matches(x, '@app\.(get|post|put|delete|patch)')
        model = regexp_matches(x, 'response_model\s*=')
        """, "docstring AND long AND model", "docstring 0.4, long 0.4, model 0.2", "endpoint")),
    "fastapi_error_handling": ("rule_fastapi_errors", by_hand("fastapi", r"""
        handling = regexp_matches(x, 'HTTPException|raise|except')
        status = regexp_matches(x, 'status_code\s*=\s*[45]\d\d')
        tried = regexp_matches(x, 'try:\s*[\s\S]*?except')
        endpoint = regexp_matches(x, '@app\.(get|post|put|delete|patch)')
        """, "handling AND (status OR tried)", "handling 0.6, status 0.2, tried 0.2", "endpoint")),
    "irs_field_documentation": ("rule_irs_fields", by_hand("irs", r"""
        names = regexp_matches(x, 'Field\s+Name:|FIELD\s+NAME:')
        described = regexp_matches(x, 'Description:|DESCRIPTION:')
        form = regexp_matches(x, 'Format:|FORMAT:|Type:|TYPE:')
        place = regexp_matches(x, 'Position:|POSITION:|Columns?:|COLUMNS?:')
        """, "names AND described AND form AND place", "names 0.25, described 0.35, form 0.25, place 0.15")),
    "irs_validation_rules": ("rule_irs_validation", by_hand("irs", r"""
        known = regexp_matches(x, 'Valid\s+Values?:|VALID\s+VALUES?:|Allowable:|ALLOWABLE:')
        required = regexp_matches(x, 'Required:|REQUIRED:|Mandatory:|MANDATORY:')
        ranges = regexp_matches(x, 'Range:|RANGE:|Min:|MAX:|Minimum:|MAXIMUM:')
        patterns = regexp_matches(x, 'Pattern:|PATTERN:|Mask:|MASK:|Format:|FORMAT:')
        layout = regexp_matches(x, 'Field|FIELD|Record|RECORD')
        """, "known OR required OR ranges OR patterns", "known 0.3, required 0.3, ranges 0.2, patterns 0.2", "layout")),
    "kubernetes_deployment_description": ("rule_k8s_description", by_hand("kubernetes", r"""
        described = length(json_extract_string(m, '$.annotations.description')) > 10
        app = json_extract_string(m, '$.labels.app') IS NOT NULL
        limits = json_extract_string(m, '$.spec.template.spec.containers[0].resources.limits') IS NOT NULL
        """, "described AND app AND limits", "described 0.5, app 0.2, limits 0.3")),
    "kubernetes_deployment_security": ("rule_k8s_security", by_hand("kubernetes", r"""
        non_root = json_extract_string(m, '$.spec.template.spec.securityContext.runAsNonRoot') = 'true'
        contained = json_extract_string(m, '$.spec.template.spec.containers[0].securityContext.allowPrivilegeEscalation') = 'false'
        read_only = json_extract_string(m, '$.spec.template.spec.containers[0].securityContext.readOnlyRootFilesystem') = 'true'
        """, "non_root AND contained AND read_only", "non_root 0.4, contained 0.4, read_only 0.2")),
    "mumps_fileman_field_documentation": ("rule_mumps_fields", by_hand("mumps", r"""
        reference = regexp_matches(x, '\^DD\([0-9,.]+\)')
        described = regexp_matches(x, '"[A-Z][A-Za-z\s]{10,}"')
        typed = regexp_matches(x, 'TYPE:|Type:')
        help = regexp_matches(x, 'HELP-PROMPT:|Help-Prompt:')
        """, "reference AND described AND (typed OR help)", "reference 0.2, described 0.4, typed 0.2, help 0.2")),
    "mumps_routine_documentation": ("rule_mumps_routines", by_hand("mumps", r"""
        header = regexp_matches(x, '^[A-Z][A-Z0-9]*\s*;')
        version = regexp_matches(x, ';;[0-9.]+;[A-Z\s]+;[A-Z\s]+;')
        purpose = regexp_matches(x, ';;\s*PURPOSE:|;;\s*DESCRIPTION:|;;\s*Function:')
        inputs = regexp_matches(x, ';;\s*INPUT:|;;\s*PARAMETERS:|;;\s*Arguments:')
        outputs = regexp_matches(x, ';;\s*OUTPUT:|;;\s*RETURNS:|;;\s*Return:')
        routine = regexp_matches(x, '^[A-Z][A-Z0-9]*\s*[;\s]')
        """, "header AND purpose AND (inputs OR outputs)", "header 0.2, version 0.1, purpose 0.4, inputs 0.15, outputs 0.15", "routine")),
}

for _rule in U.RULES:

    @query(RULE_SQL[_rule.name][0], RULE_SQL[_rule.name][1], "source_text")
    def _(t, rule=_rule):
        return U.run_rule(t.source_text, rule)


ALL = " UNION ALL ".join(f"({U.oracle_sql(r)})" for r in U.RULES)


@query("run_rules", f"SELECT chunk_id, artifact_type, rule_name, ruleset_version, severity, passed, confidence, suggested_fix FROM ({ALL})", "source_text")
def _(t):
    return U.run_rules(t.source_text)


@query("run_rules_limited", f"""
  SELECT chunk_id, rule_name, 'v9' AS ruleset_version, passed FROM (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY chunk_id) AS n
    FROM ({ALL})) WHERE n <= 25
""", "source_text")
def _(t):
    return U.run_rules(t.source_text, per_rule=25, version="v9").select("chunk_id", "rule_name", "ruleset_version", "passed")


@query("suggested_fix", f"SELECT chunk_id, rule_name, suggested_fix FROM ({ALL}) WHERE NOT passed", "source_text")
def _(t):
    return U.run_rules(t.source_text).filter("not passed").select("chunk_id", "rule_name", "suggested_fix")


def _case(tests: dict[str, str], otherwise: str) -> str:
    return "CASE artifact_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tests.items()) + f" ELSE {otherwise} END"


WORDS = _case({k: rf"regexp_matches(x, '(?i)\b(?:{p})\b')" for k, p in S.VOCABULARY.items()}, "true")
FORM = _case({k: f"regexp_matches(s, '{p}')" for k, p in S.FORMATTED.items()}, "length(s) > 0")
QUALITY = rf"""
q0 AS (SELECT chunk_id, artifact_type, coalesce(text_content, '') AS x, regexp_replace(coalesce(text_content, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '',
  'g') AS s FROM chunks),
q1 AS (SELECT *, [l FOR l IN string_split(x, chr(10)) IF regexp_matches(l, '[^ \t\n\r\f]')] AS full_lines FROM q0),
q2 AS (SELECT *, [length(regexp_extract(l, '^[ \t\r\f]+')) FOR l IN full_lines IF l LIKE ' %'] AS ind FROM q1),
q3 AS (SELECT chunk_id, artifact_type, length(x) AS total_length, length(s) AS stripped_length, {FORM} AS formatted,
  (len(ind) <= 1 OR len([i FOR i IN ind IF i % 2 <> 0]) = 0) AS even_indent, {WORDS} AS domain_words,
  regexp_matches(x, '(?i)\b(?:{S.PLACEHOLDERS})\b') AS placeholders, len(full_lines) AS n FROM q2),
q AS (SELECT chunk_id, artifact_type, total_length, stripped_length, formatted, even_indent, domain_words, placeholders,
  round(least(1.0::DOUBLE, CASE WHEN formatted THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN even_indent THEN 0.3::DOUBLE ELSE 0 END + CASE
    WHEN n > 1 THEN 0.3::DOUBLE WHEN n = 1 THEN 0.15::DOUBLE ELSE 0 END), 6) AS structure_score,
  CASE WHEN domain_words AND NOT placeholders THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS vocabulary_score FROM q3)"""


@query("content_quality", f"WITH {QUALITY} SELECT * FROM q", "chunks")
def _(t):
    return S.content_quality(t.chunks)


@query("confidence_score", f"""WITH {QUALITY},
m AS (SELECT *, round(least(1::DOUBLE, 0.4::DOUBLE * least(1::DOUBLE,
  stripped_length / 10.0::DOUBLE) + 0.3::DOUBLE * ((formatted::INT + even_indent::INT) / 2.0::DOUBLE) + 0.3::DOUBLE * least(1::DOUBLE,
  0.5::DOUBLE * domain_words::INT + 0.3::DOUBLE * (NOT placeholders)::INT + 0.2::DOUBLE * coalesce(stripped_length / nullif(total_length, 0)::DOUBLE,
  0))), 6) AS quality FROM q)
SELECT chunk_id, quality, round_even(round(least(1::DOUBLE, greatest(0::DOUBLE, (formatted::INT + domain_words::INT) / 2.0::DOUBLE * 0.6::DOUBLE + quality * 0.4::DOUBLE - placeholders::INT * 0.2::DOUBLE)), 10), 3) AS final_confidence FROM m""", "chunks")  # fmt: skip
def _(t):
    return S.confidence_scores(t.chunks)


DOT = "list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) FOR p IN list_zip(a.embedding, b.embedding)])"


def candidates(t):
    """Similarity of every vector to the probe of its label."""
    v = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = t.probes.join(v.select("vec_id", F.col("v").alias("pv"), F.col("label").alias("plabel")), "vec_id").select("rule_name", "plabel", "pv")
    dot = F.aggregate(F.zip_with("v", "pv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return v.join(p, F.col("label") == F.col("plabel")).select("rule_name", F.col("vec_id").cast("string").alias("chunk_id"), F.round(dot, 6).alias("similarity"))


CANDIDATES = f"""
  cand AS (SELECT p.rule_name, CAST(a.vec_id AS VARCHAR) AS chunk_id, round({DOT}, 6) AS similarity FROM embeddings a
    JOIN embeddings b ON a.label = b.label JOIN probes p ON p.vec_id = b.vec_id)
"""


@query("semantic_support", f"WITH {CANDIDATES} SELECT rule_name, chunk_id, max(similarity) AS similarity FROM cand GROUP BY ALL", "probes")
def _(t):
    return S.semantic_support(candidates(t))


def support(t):
    """The candidates of probe 0 support the first probed rule's endpoints of the same number."""
    found = candidates(t).filter("rule_name in ('rule_0', 'rule_1')")
    rule = F.when(F.col("rule_name") == "rule_0", "fastapi_endpoint_documentation").otherwise("fastapi_error_handling")
    return S.semantic_support(found.select(rule.alias("rule_name"), F.concat(F.lit("fastapi:"), "chunk_id").alias("chunk_id"), "similarity"))


GAPS = f"""{CANDIDATES},
sup AS (SELECT CASE rule_name WHEN 'rule_0' THEN 'fastapi_endpoint_documentation' ELSE 'fastapi_error_handling' END AS rule_name,
  'fastapi:' || chunk_id AS chunk_id, max(similarity) AS similarity FROM cand WHERE rule_name IN ('rule_0', 'rule_1') GROUP BY ALL),
rr AS ({ALL}),
g0 AS (SELECT rr.*, coalesce(sup.similarity, 0) AS semantic_similarity, CASE rr.rule_name WHEN 'fastapi_endpoint_documentation' THEN 0.25::DOUBLE
  WHEN 'fastapi_error_handling' THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS w FROM rr LEFT JOIN sup USING (rule_name, chunk_id)),
g AS (SELECT 'analysis_1' AS analysis_id, rule_name, ruleset_version, chunk_id, artifact_type, passed, severity, confidence AS base_confidence,
  semantic_similarity,
  round_even(round(least(1::DOUBLE, greatest(0::DOUBLE, round_even(confidence * 100, 0) / 100 + least(1::DOUBLE, greatest(0::DOUBLE, semantic_similarity)) * w - (NOT passed)::INT * 0.2::DOUBLE)), 10), 3) AS final_confidence, coalesce(suggested_fix, '') AS suggested_fix FROM g0)"""


@query("gap_metrics", f"WITH {GAPS} SELECT * FROM g", "source_text", "probes")
def _(t):
    return S.gap_metrics(t.source_text, support(t), "analysis_1").drop("metadata")


@query("severity_escalation", r"""
SELECT chunk_id, greatest(CAST(1 + length(text_content) % 3 AS INT), CASE WHEN c < 0.1 THEN 5 WHEN c < 0.2 THEN 4 ELSE 1 END, CASE
  WHEN regexp_matches(lower(text_content), '\b(?:@SAFETY)\b') THEN 5 WHEN regexp_matches(lower(text_content),
  '\b(?:@SECURITY|@COMPLIANCE)\b') THEN 4 ELSE 1 END,
  CASE WHEN m > 2 THEN 5 WHEN m > 0 THEN 4 ELSE 1 END) AS severity FROM (SELECT *, CAST(length(text_content) % 100 AS DOUBLE) / 100 AS c, CASE
    WHEN length(text_content) % 10 = 0 THEN length(text_content) % 4 ELSE 0 END AS m FROM source_text)
""".replace("@SAFETY", S.SAFETY_WORDS).replace("@SECURITY", S.SECURITY_WORDS).replace("@COMPLIANCE", S.COMPLIANCE_WORDS), "source_text")  # fmt: skip
def _(t):
    n = F.length("text_content")
    return S.severity_escalation(t.source_text.withColumns({"severity": (1 + n % 3).cast("int"), "confidence": (n % 100).cast("double") / 100, "missing_fields": F.when(n % 10 == 0, n % 4).otherwise(0)}))


@query("confidence_band", """
  SELECT band, count(*) AS n FROM (SELECT CASE WHEN metric_value >= 0.9 THEN 'high' WHEN metric_value >= 0.7 THEN 'good'
    WHEN metric_value >= 0.5 THEN 'moderate' WHEN metric_value >= 0.3 THEN 'low' ELSE 'very low' END AS band FROM gap_metrics) GROUP BY band
""", "gap_metrics")
def _(t):
    return t.gap_metrics.groupBy(S.confidence_band(F.col("metric_value")).alias("band")).agg(F.count("*").alias("n"))


@query("input_contract_checks", """
WITH c AS (SELECT *, CASE WHEN length(text_content) % 3 = 0 THEN NULL ELSE kind END AS k FROM chunks)
SELECT *, field_coverage >= 0.8 AS accepted FROM (SELECT artifact_type, count(*) AS n, count(*) FILTER (text_content IS NULL) AS missing_fields,
  count(*) FILTER (artifact_type = 'kubernetes' AND NOT regexp_matches(text_content, 'kind:|apiVersion:')) AS wrong_type,
  count(*) FILTER (length(text_content) < 10) AS short_texts,
  count(*) FILTER (created_at < TIMESTAMP '2024-03-31' - INTERVAL 90 DAYS) AS stale, round(avg(CASE artifact_type
    WHEN 'kubernetes' THEN (3 + (k IS NOT NULL)::INT) / 5.0::DOUBLE ELSE (3 + (source <> 'src1')::INT) / 4.0::DOUBLE END), 6) AS field_coverage FROM c
    GROUP BY artifact_type)
""", "chunks")  # fmt: skip
def _(t):
    name = F.when(F.col("source") != "src1", F.col("source"))
    rows = t.chunks.withColumns({"kind": F.when(F.length("text_content") % 3 != 0, F.col("kind")), "api_path": name, "record_name": name})
    return S.input_contract_checks(rows, "2024-03-31 00:00:00")


@query("gap_consistency", """
SELECT 'orphans' AS check_name, count(*) AS n FROM gap_metrics m WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_orderkey AS VARCHAR) = m.chunk_id)
UNION ALL SELECT 'repeated_keys', count(*) FROM (SELECT 1 FROM gap_metrics GROUP BY chunk_id, rule_name, ruleset_version, analysis_id HAVING count(*) > 1)
UNION ALL SELECT 'confidence_range', count(*) FILTER (NOT metric_value BETWEEN 0 AND 1) FROM gap_metrics
UNION ALL SELECT 'severity_range', count(*) FILTER (NOT severity BETWEEN 1 AND 5) FROM gap_metrics
UNION ALL SELECT 'failed_without_severity', count(*) FILTER (NOT passed AND severity IS NULL) FROM gap_metrics
""", "gap_metrics")  # fmt: skip
def _(t):
    return S.gap_consistency(t.gap_metrics, t.orders.select(F.col("o_orderkey").cast("string").alias("chunk_id")))


@query("row_validity_rate", "SELECT o_orderstatus, round(count(*) FILTER (regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$'))::DOUBLE / count(*), 6) AS validity FROM orders GROUP BY o_orderstatus")
def _(t):
    return S.row_validity_rate(t.orders, "o_orderpriority", "^[1-3]-[A-Z]+$", "o_orderstatus")


@query("volume_flag", """
  SELECT day, n, round(m, 6) AS avg_amount, CASE WHEN n < 5 THEN 'LOW_VOLUME'
    WHEN m > 260000 THEN 'HIGH_VALUE_ANOMALY' ELSE 'NORMAL' END AS quality_flag FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n,
    avg(o_totalprice) AS m FROM orders GROUP BY 1)
""")
def _(t):
    return S.volume_flag(t.orders, "o_orderdate", "o_totalprice", 5, 260_000.0)


@query("remediate_nulls", """
  SELECT gap_id, event_id, coalesce(closed_at, status_at) AS closed_at, coalesce(CASE WHEN severity = 'LOW' THEN NULL ELSE severity END,
    'UNKNOWN') AS severity FROM gap_history
""", "gap_history")
def _(t):
    rows = t.gap_history.select("gap_id", "event_id", "closed_at", "status_at", F.when(F.col("severity") != "LOW", F.col("severity")).alias("severity"))
    return S.remediate_nulls(rows, {"closed_at": F.col("status_at"), "severity": F.lit("UNKNOWN")}).drop("status_at")


@query("retention_by_rule", """
WITH h AS (SELECT event_id, rule_id, severity, status_at, CAST(status_at AS DATE) AS version FROM gap_history),
k AS (SELECT * FROM h WHERE CAST(status_at AS DATE) >= DATE '2024-01-31' - CASE severity WHEN 'LOW' THEN 3 WHEN 'MEDIUM' THEN 10 ELSE 20 END),
v AS (SELECT rule_id, version FROM (SELECT rule_id, version, dense_rank() OVER (PARTITION BY rule_id ORDER BY version DESC) AS n
  FROM (SELECT DISTINCT rule_id, version FROM k)) WHERE n <= 5)
SELECT event_id, rule_id, severity AS severity_class, version FROM k SEMI JOIN v USING (rule_id, version)
""", "gap_history")  # fmt: skip
def _(t):
    rows = t.gap_history.select("event_id", "rule_id", F.col("severity").alias("severity_class"), "status_at", F.to_date("status_at").alias("version"))
    policy = t.spark.createDataFrame([("LOW", 3), ("MEDIUM", 10), ("HIGH", 20), ("CRITICAL", 20)], "severity_class string, keep_days int")
    return S.retention_by_rule(rows, policy, "2024-01-31").select("event_id", "rule_id", "severity_class", "version")
