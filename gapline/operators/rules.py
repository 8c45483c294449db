"""Documentation rules: boolean features of a chunk, a verdict and a confidence, all rules of a type in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``features`` are patterns over the text, or (JSON path, test) pairs over the metadata; ``passed`` and ``rows`` are SQL
    over the feature names; ``fixes`` are what to write for a missing feature.
    """

    name: str
    artifact_type: str
    severity: int
    features: dict[str, str | tuple[str, str]]
    weights: dict[str, float]
    passed: str
    rows: str = "TRUE"
    fixes: dict[str, str] = field(default_factory=dict)
    lead: str = "Add documentation: "
    version: str = "1.0.0"


# The features, weights, verdicts and fix texts of the rule set.
RULES = (
    Rule(
        "cobol_data_item_documentation", "cobol", 3,
        {"pic_comments": r"PIC\s+[X9A-Z()\-]+\s+\*.*", "descriptions": r"\*\s*[A-Z][A-Za-z\s]{10,}", "copybook": r"COPY\s+[A-Z0-9\-]+", "record": r"01\s+[A-Z0-9\-]+"},
        {"pic_comments": 0.4, "descriptions": 0.4, "record": 0.2},
        "pic_comments AND descriptions AND record", "copybook OR record",
        {"pic_comments": "PIC clause comments for data types", "descriptions": "field descriptions with business meaning", "record": "proper 01-level record structure"}, "Add COBOL documentation: ",
    ),
    Rule(
        "cobol_procedure_documentation", "cobol", 2,
        {"division": r"PROCEDURE\s+DIVISION", "purpose": r"\*\s*PURPOSE:|FUNCTION:|DESCRIPTION:", "sections": r"SECTION\.", "input_docs": r"\*\s*INPUT:|PARAMETERS:|ARGUMENTS:"},
        {"purpose": 0.6, "input_docs": 0.4},
        "purpose AND (NOT sections OR input_docs)", "division",
        {"purpose": "PURPOSE or FUNCTION comment explaining business logic", "input_docs": "INPUT or PARAMETERS documentation"}, "Add procedure documentation: ",
    ),
    Rule(
        "fastapi_endpoint_documentation", "fastapi", 2,
        {"docstring": r'"""[\s\S]*?"""', "adequate": (r'"""([\s\S]*?)"""', "group longer than 50"), "endpoint": r"@app\.(get|post|put|delete|patch)", "response_model": r"response_model\s*="},
        {"docstring": 0.4, "adequate": 0.4, "response_model": 0.2},
        "docstring AND adequate AND response_model", "endpoint",
        {"docstring": "Add comprehensive docstring", "adequate": "expand documentation to explain parameters and return values", "response_model": "add response_model parameter"}, "Improve endpoint documentation: ",
    ),
    Rule(
        "fastapi_error_handling", "fastapi", 4,
        {"handling": r"HTTPException|raise|except", "http_status": r"status_code\s*=\s*[45]\d\d", "try_except": r"try:\s*[\s\S]*?except", "endpoint": r"@app\.(get|post|put|delete|patch)"},
        {"handling": 0.6, "http_status": 0.2, "try_except": 0.2},
        "handling AND (http_status OR try_except)", "endpoint",
        {"handling": "implement HTTPException or try/except blocks", "http_status": "include appropriate HTTP status codes (4xx/5xx)"}, "Add error handling: ",
    ),
    Rule(
        "irs_field_documentation", "irs", 4,
        {"names": r"Field\s+Name:|FIELD\s+NAME:", "descriptions": r"Description:|DESCRIPTION:", "format": r"Format:|FORMAT:|Type:|TYPE:", "position": r"Position:|POSITION:|Columns?:|COLUMNS?:"},
        {"names": 0.25, "descriptions": 0.35, "format": 0.25, "position": 0.15},
        "names AND descriptions AND format AND position", "TRUE",
        {"names": "field names", "descriptions": "field descriptions", "format": "format specifications", "position": "position information"}, "Add IRS record documentation: ",
    ),
    Rule(
        "irs_validation_rules", "irs", 3,
        {"valid_values": r"Valid\s+Values?:|VALID\s+VALUES?:|Allowable:|ALLOWABLE:", "required": r"Required:|REQUIRED:|Mandatory:|MANDATORY:", "range_limits": r"Range:|RANGE:|Min:|MAX:|Minimum:|MAXIMUM:", "pattern_rules": r"Pattern:|PATTERN:|Mask:|MASK:|Format:|FORMAT:", "layout": r"Field|FIELD|Record|RECORD"},
        {"valid_values": 0.3, "required": 0.3, "range_limits": 0.2, "pattern_rules": 0.2},
        "valid_values OR required OR range_limits OR pattern_rules", "layout",
        {"valid_values": "valid values or allowable entries", "required": "required/mandatory field indicators", "range_limits": "range constraints", "pattern_rules": "pattern or format rules"}, "Add validation rules: ",
    ),
    Rule(
        "kubernetes_deployment_description", "kubernetes", 3,
        {"description": ("$.annotations.description", "longer than 10"), "app_label": ("$.labels.app", "present"), "limits": ("$.spec.template.spec.containers[0].resources.limits", "present")},
        {"description": 0.5, "app_label": 0.2, "limits": 0.3},
        "description AND app_label AND limits", "TRUE",
        {"description": "description annotation", "app_label": "app label", "limits": "resource limits"}, "Add missing fields: ",
    ),
    Rule(
        "kubernetes_deployment_security", "kubernetes", 4,
        {"non_root": ("$.spec.template.spec.securityContext.runAsNonRoot", "true"), "no_escalation": ("$.spec.template.spec.containers[0].securityContext.allowPrivilegeEscalation", "false"), "read_only": ("$.spec.template.spec.containers[0].securityContext.readOnlyRootFilesystem", "true")},
        {"non_root": 0.4, "no_escalation": 0.4, "read_only": 0.2},
        "non_root AND no_escalation AND read_only", "TRUE",
        {"non_root": "runAsNonRoot: true", "no_escalation": "allowPrivilegeEscalation: false", "read_only": "readOnlyRootFilesystem: true"}, "Add security configurations: ",
    ),
    Rule(
        "mumps_fileman_field_documentation", "mumps", 3,
        {"dd_ref": r"\^DD\([0-9,.]+\)", "description": r'"[A-Z][A-Za-z\s]{10,}"', "type_info": r"TYPE:|Type:", "help_prompt": r"HELP-PROMPT:|Help-Prompt:"},
        {"dd_ref": 0.2, "description": 0.4, "type_info": 0.2, "help_prompt": 0.2},
        "dd_ref AND description AND (type_info OR help_prompt)", "TRUE",
        {"dd_ref": "DD reference structure", "description": "field description with business meaning", "type_info": "field type information", "help_prompt": "help prompt for users"}, "Add FileMan documentation: ",
    ),
    Rule(
        "mumps_routine_documentation", "mumps", 2,
        {"header": r"^[A-Z][A-Z0-9]*\s*;", "version": r";;[0-9.]+;[A-Z\s]+;[A-Z\s]+;", "purpose": r";;\s*PURPOSE:|;;\s*DESCRIPTION:|;;\s*Function:", "input_docs": r";;\s*INPUT:|;;\s*PARAMETERS:|;;\s*Arguments:", "output_docs": r";;\s*OUTPUT:|;;\s*RETURNS:|;;\s*Return:", "routine": r"^[A-Z][A-Z0-9]*\s*[;\s]"},
        {"header": 0.2, "version": 0.1, "purpose": 0.4, "input_docs": 0.15, "output_docs": 0.15},
        "header AND purpose AND (input_docs OR output_docs)", "routine",
        {"header": "routine header with name", "purpose": "PURPOSE or DESCRIPTION comment", "input_docs": "INPUT parameter documentation", "output_docs": "OUTPUT or RETURNS documentation"}, "Add routine documentation: ",
    ),
)

BY_NAME = {r.name: r for r in RULES}


def feature(test: str | tuple[str, str]) -> Column:
    """A feature as a boolean, false for null text or metadata. ``_metadata_v`` is the metadata, parsed once for all paths."""
    if isinstance(test, str):
        return F.coalesce(F.col("text_content").rlike(test), F.lit(False))
    path, wanted = test
    if wanted == "group longer than 50":
        return F.coalesce(F.length(F.regexp_extract("text_content", path, 1)) > 50, F.lit(False))
    value = F.try_variant_get("_metadata_v", path, "string")
    if wanted == "present":
        return value.isNotNull()
    if wanted == "longer than 10":
        return F.coalesce(F.length(value) > 10, F.lit(False))
    return F.coalesce(value == wanted, F.lit(False))


def named(rule: Rule, formula: str) -> str:
    """AND, OR, NOT and brackets over feature names as SQL over the columns of ``with_features``."""
    words = formula.replace("(", " ( ").replace(")", " ) ").split()
    return " ".join(f"`{rule.name}.{w}`" if w in rule.features else w for w in words)


def with_features(chunks: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A column ``rule.feature`` for each feature of each rule, null for chunks of another type."""
    own = {name: F.col("artifact_type") == name for name in {r.artifact_type for r in rules}}
    reads_metadata = {r.artifact_type for r in rules if any(isinstance(t, tuple) and t[0].startswith("$") for t in r.features.values())}
    rows = chunks.select("chunk_id", "artifact_type", "text_content", "metadata") if "metadata" in chunks.columns else chunks.select("chunk_id", "artifact_type", "text_content", F.lit(None).cast("string").alias("metadata"))
    rows = rows.withColumn("_metadata_v", F.when(F.col("artifact_type").isin(*reads_metadata), F.try_parse_json("metadata")))
    columns = {f"{r.name}.{k}": F.when(own[r.artifact_type], feature(t)) for r in rules for k, t in r.features.items()}
    return rows.select("chunk_id", "artifact_type", *[c.alias(n) for n, c in columns.items()])


def verdict(rule: Rule) -> Column:
    """A struct (rule_name, version, severity, passed, confidence, missing), null where the rule does not apply."""
    found = {name: F.col(f"`{rule.name}.{name}`") for name in rule.features}
    passed, rows = F.expr(named(rule, rule.passed)), F.expr(named(rule, rule.rows))
    confidence = F.round(reduce(lambda a, b: a + b, [found[k].cast("int") * F.lit(w) for k, w in rule.weights.items()]), 6)
    missing = F.concat_ws(", ", *[F.when(~found[k], F.lit(text)) for k, text in rule.fixes.items()])
    fix = F.when(~passed, F.substring(F.concat(F.lit(rule.lead), missing), 1, 500))
    out = F.struct(F.lit(rule.name).alias("rule_name"), F.lit(rule.version).alias("ruleset_version"), F.lit(rule.severity).alias("severity"), passed.alias("passed"), confidence.alias("confidence"), fix.alias("suggested_fix"))
    return F.when((F.col("artifact_type") == rule.artifact_type) & rows, out)


def run_rules(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, per_rule: int | None = None, version: str | None = None) -> DataFrame:
    """All rules over all chunks in one scan: chunk_id, artifact_type, rule_name, ruleset_version, severity, passed, confidence,
    suggested_fix. ``per_rule`` keeps that many chunks of each rule (smallest ids), ``version`` overrides the rules' own.
    """
    every = F.filter(F.array(*map(verdict, rules)), lambda v: v.isNotNull())
    out = with_features(chunks, rules).select("chunk_id", "artifact_type", F.explode(every).alias("v")).select("chunk_id", "artifact_type", "v.*")
    if version is not None:
        out = out.withColumn("ruleset_version", F.lit(version))
    if per_rule is not None:
        from pyspark.sql import Window as W

        rank = F.row_number().over(W.partitionBy("rule_name").orderBy("chunk_id"))
        out = out.withColumn("n", rank).filter(F.col("n") <= per_rule).drop("n")
    return out


def run_rule(chunks: DataFrame, rule: Rule) -> DataFrame:
    return run_rules(chunks.filter(F.col("artifact_type") == rule.artifact_type), (rule,)).select("chunk_id", "passed", "confidence")


def oracle_sql(rule: Rule, source: str = "source_text") -> str:
    """The same rule in DuckDB's SQL (chunk_id, passed, confidence, and what all rules share)."""

    def test(t: str | tuple[str, str]) -> str:
        if isinstance(t, str):
            return "coalesce(regexp_matches(text_content, '" + t.replace("'", "''") + "'), false)"
        if t[1] == "group longer than 50":
            return f"coalesce(length(regexp_extract(text_content, '{t[0]}', 1)) > 50, false)"
        value = f"json_extract_string(metadata, '{t[0]}')"
        if t[1] == "present":
            return f"{value} IS NOT NULL"
        return f"coalesce(length({value}) > 10, false)" if t[1] == "longer than 10" else f"coalesce({value} = '{t[1]}', false)"

    columns = ", ".join(f"{test(t)} AS f_{k}" for k, t in rule.features.items())

    def named(formula: str) -> str:
        return " ".join(f"f_{w}" if w in rule.features else w for w in formula.replace("(", " ( ").replace(")", " ) ").split())

    weight = " + ".join(f"CAST(f_{k} AS INT) * {w}::DOUBLE" for k, w in rule.weights.items())
    missing = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT f_{k} THEN '{text}' END" for k, text in rule.fixes.items()) + ")"
    return f"""SELECT chunk_id, artifact_type, '{rule.name}' AS rule_name, '{rule.version}' AS ruleset_version, {rule.severity} AS severity, ({named(rule.passed)}) AS passed,
  round({weight}, 6) AS confidence, CASE WHEN NOT ({named(rule.passed)}) THEN substr('{rule.lead}' || {missing}, 1, 500) END AS suggested_fix
FROM (SELECT chunk_id, artifact_type, {columns} FROM {source} WHERE artifact_type = '{rule.artifact_type}') t WHERE {named(rule.rows)}"""
