"""Content quality, confidence scores, gap metrics and the checks around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.operators.rules import BY_NAME, RULES, Rule, run_rules

# Domain words of each artifact type, placeholder words, weights and penalties.
VOCABULARY = {
    "kubernetes": "pod|service|deployment|ingress|configmap|secret|namespace",
    "fastapi": "endpoint|route|schema|model|dependency|middleware|response",
    "cobol": "pic|copy|section|division|procedure|working|storage",
    "irs": "field|record|position|length|format|required|valid",
    "mumps": "routine|fileman|input|output|transform|help|prompt",
}
PLACEHOLDERS = "todo|fixme|tbd|placeholder|replace|change|update"
FORMATTED = {"kubernetes": r":", "fastapi": r"def |class |@", "cobol": r"(?i)PIC |COPY ", "irs": r"Field|Position|Length", "mumps": r";|\^"}
CRITICAL, SECURITY, COMPLIANCE = 0.20, 0.15, 0.10
# Words that raise the severity.
SECURITY_WORDS = "authentication|authorization|encrypt|decrypt|token|credential|password|secret|key|certificate|signature|hash|permission|access|role|privilege|audit|log|security|vulnerability|attack|breach|threat"
COMPLIANCE_WORDS = "pii|phi|gdpr|hipaa|sox|pci|compliance|regulation|audit|log|trace|monitor|report|privacy|retention|classification|protection|handling"
SAFETY_WORDS = "patient|safety|critical|emergency|life|death|drug|medication|dosage|allergy|interaction|alarm|alert|warning|failure|backup|recovery"
#: Weights of the semantic component by rule.
PROBE_WEIGHTS = {"fastapi_endpoint_documentation": 0.25, "fastapi_error_handling": 0.2}


def _by_type(tests: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda made, kv: F.when(F.col("artifact_type") == kv[0], kv[1]).otherwise(made), tests.items(), otherwise)


def content_quality(chunks: DataFrame) -> DataFrame:
    """Lengths, format, indentation, vocabulary, placeholders, structure and vocabulary scores of each chunk."""
    text = F.coalesce(F.col("text_content"), F.lit(""))
    stripped = F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    formatted = _by_type({k: stripped.rlike(p) for k, p in FORMATTED.items()}, F.length(stripped) > 0)
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"[^ \t\n\r\f]"))
    indents = F.transform(F.filter(full, lambda x: x.startswith(" ")), lambda x: F.length(F.regexp_extract(x, r"^[ \t\r\f]+", 0)))
    even = (F.size(indents) <= 1) | F.forall(indents, lambda n: n % 2 == 0)
    domain = _by_type({k: text.rlike(rf"(?i)\b(?:{p})\b") for k, p in VOCABULARY.items()}, F.lit(True))
    structure = F.when(formatted, 0.4).otherwise(0.0) + F.when(even, 0.3).otherwise(0.0) + F.when(F.size(full) > 1, 0.3).when(F.size(full) == 1, 0.15).otherwise(0.0)
    out = chunks.select("chunk_id", "artifact_type", F.length(text).alias("total_length"), F.length(stripped).alias("stripped_length"), formatted.alias("formatted"), even.alias("even_indent"), domain.alias("domain_words"), text.rlike(rf"(?i)\b(?:{PLACEHOLDERS})\b").alias("placeholders"), F.round(F.least(F.lit(1.0), structure), 6).alias("structure_score"))
    return out.withColumn("vocabulary_score", F.when(F.col("domain_words") & ~F.col("placeholders"), 1.0).otherwise(0.5))


def quality_multiplier(min_length: int = 10) -> Column:
    """0.4 length + 0.3 structure + 0.3 vocabulary over the columns of ``content_quality``."""
    length = F.least(F.lit(1.0), F.col("stripped_length") / F.lit(float(max(min_length, 1))))
    structure = (F.col("formatted").cast("double") + F.col("even_indent").cast("double")) / 2
    share = F.coalesce(F.try_divide(F.col("stripped_length"), F.col("total_length")), F.lit(0.0))
    vocabulary = F.least(F.lit(1.0), 0.5 * F.col("domain_words").cast("double") + 0.3 * (~F.col("placeholders")).cast("double") + 0.2 * share)
    return F.least(F.lit(1.0), 0.4 * length + 0.3 * structure + 0.3 * vocabulary)


def confidence(base: Column, quality: Column, similarity: Column, critical: Column, security: Column, compliance: Column, w_field: float = 0.6, w_quality: float = 0.4, w_semantic: Column | float = 0.0) -> Column:
    """base * w_field + quality * w_quality + clamp(similarity) * w_semantic - penalties (at most 1), clamped, to 3 digits."""
    similar = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0))))
    penalty = F.least(F.lit(1.0), critical * CRITICAL + security * SECURITY + compliance * COMPLIANCE)
    raw = base * w_field + quality * w_quality + similar * w_semantic - penalty
    # Rounded to ten digits first: sums that stand for a tie must not depend on the order of addition.
    return F.bround(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 10), 3)


def confidence_scores(chunks: DataFrame) -> DataFrame:
    """Confidence of each chunk from its content alone; placeholders count as one critical violation."""
    q = content_quality(chunks)
    base = (F.col("formatted").cast("int") + F.col("domain_words").cast("int")) / 2
    zero = F.lit(0)
    return q.select("chunk_id", F.round(quality_multiplier(), 6).alias("quality"), confidence(base, F.round(quality_multiplier(), 6), F.lit(None).cast("double"), F.col("placeholders").cast("int"), zero, zero).alias("final_confidence"))


def semantic_support(candidates: DataFrame) -> DataFrame:
    """Highest similarity of each chunk for each rule; ``candidates(rule_name, chunk_id, similarity)``."""
    return candidates.groupBy("rule_name", "chunk_id").agg(F.max("similarity").alias("similarity"))


def gap_metrics(chunks: DataFrame, support: DataFrame, analysis_id: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rules over all chunks, blended with semantic support: one scan, one join, no rows on the driver."""
    found = run_rules(chunks, rules)
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in PROBE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("rule_name")), F.lit(0.0))
    found = found.join(support.select("rule_name", "chunk_id", "similarity"), ["rule_name", "chunk_id"], "left").withColumn("semantic_similarity", F.coalesce("similarity", F.lit(0.0))).withColumn("semantic_weight", weight)
    base, zero = F.bround(F.col("confidence") * 100, 0) / 100, F.lit(0)
    final = confidence(base, F.lit(0.0), F.col("semantic_similarity"), (~F.col("passed")).cast("int"), zero, zero, 1.0, 0.0, F.col("semantic_weight"))
    meta = F.to_json(F.struct(F.col("confidence").alias("base_confidence"), F.col("semantic_similarity"), F.col("artifact_type"), F.col("passed")))
    return found.select(F.lit(analysis_id).alias("analysis_id"), "rule_name", "ruleset_version", "chunk_id", "artifact_type", "passed", "severity", F.col("confidence").alias("base_confidence"), "semantic_similarity", final.alias("final_confidence"), F.coalesce("suggested_fix", F.lit("")).alias("suggested_fix"), meta.alias("metadata"))


def severity_escalation(chunks: DataFrame) -> DataFrame:
    """Severity raised by low confidence, by words that touch security, compliance or safety, and by missing fields."""
    text, c, missing = F.lower(F.coalesce("text_content", F.lit(""))), F.col("confidence"), F.col("missing_fields")
    by_confidence = F.when(c < 0.1, 5).when(c < 0.2, 4).otherwise(1)
    by_word = F.when(text.rlike(rf"\b(?:{SAFETY_WORDS})\b"), 5).when(text.rlike(rf"\b(?:{SECURITY_WORDS}|{COMPLIANCE_WORDS})\b"), 4).otherwise(1)
    by_missing = F.when(missing > 2, 5).when(missing > 0, 4).otherwise(1)
    return chunks.select("chunk_id", F.greatest(F.col("severity"), by_confidence, by_word, by_missing).alias("severity"))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.9, "high").when(value >= 0.7, "good").when(value >= 0.5, "moderate").when(value >= 0.3, "low").otherwise("very low")


# Fields that each artifact type must have.
REQUIRED = {"kubernetes": ("kind", "metadata"), "fastapi": ("api_path",), "cobol": ("record_name",), "irs": ("record_name",), "mumps": ("record_name",)}


def input_contract_checks(chunks: DataFrame, as_of: str, least: int = 10, days: int = 90, coverage: float = 0.8) -> DataFrame:
    """Per artifact type: missing fields, wrong types, short texts, stale chunks, the share of required fields that are there and
    whether it reaches ``coverage``. Columns that the table lacks count as missing.
    """

    def there(c: str) -> Column:
        return F.col(c).isNotNull().cast("int") if c in chunks.columns else F.lit(0)

    common = there("chunk_id") + there("artifact_type") + there("text_content")
    share = _by_type({k: (common + reduce(lambda a, b: a + b, map(there, f))) / (3 + len(f)) for k, f in REQUIRED.items()}, common / 3)
    wrong = (F.col("artifact_type") == "kubernetes") & ~F.col("text_content").rlike("kind:|apiVersion:")
    stale = F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    out = chunks.groupBy("artifact_type").agg(F.count("*").alias("n"), F.count_if(common < 3).alias("missing_fields"), F.count_if(wrong).alias("wrong_type"), F.count_if(F.length("text_content") < least).alias("short_texts"), F.count_if(stale).alias("stale"), F.round(F.avg(share), 6).alias("field_coverage"))
    return out.withColumn("accepted", F.col("field_coverage") >= coverage)


def gap_consistency(metrics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts that must be 0: metrics without chunk, repeated keys, values out of range, failed rows without severity."""
    orphans = metrics.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").agg(F.lit("orphans").alias("check_name"), F.count("*").alias("n"))
    keys = metrics.groupBy("chunk_id", "rule_name", "ruleset_version", "analysis_id").count().filter("count > 1").agg(F.lit("repeated_keys").alias("check_name"), F.count("*").alias("n"))
    ranges = metrics.agg(F.count_if(~F.col("metric_value").between(0, 1)).alias("confidence_range"), F.count_if(~F.col("severity").between(1, 5)).alias("severity_range"), F.count_if(~F.col("passed") & F.col("severity").isNull()).alias("failed_without_severity"))
    wide = ranges.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in ("confidence_range", "severity_range", "failed_without_severity")])).alias("x")).select("x.*")
    return orphans.unionByName(keys).unionByName(wide)


def row_validity_rate(rows: DataFrame, column: str, pattern: str, by: str) -> DataFrame:
    ok = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return rows.groupBy(by).agg(F.round(F.try_divide(F.count_if(ok), F.count("*")), 6).alias("validity"))


def volume_flag(rows: DataFrame, at: str, amount: str, least: int, most: float) -> DataFrame:
    """Per day: LOW_VOLUME below ``least`` rows, HIGH_VALUE_ANOMALY above a mean amount of ``most``, else NORMAL."""
    per = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.avg(amount).alias("mean"))
    return per.select("day", "n", F.round("mean", 6).alias("avg_amount"), F.when(F.col("n") < least, "LOW_VOLUME").when(F.col("mean") > most, "HIGH_VALUE_ANOMALY").otherwise("NORMAL").alias("quality_flag"))


def remediate_nulls(rows: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """Nulls from backup columns or defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), fill) for c, fill in fills.items()})


def retention_by_rule(metrics: DataFrame, policy: DataFrame, as_of: str, versions: int = 5) -> DataFrame:
    """Rows inside their class's retention and among the newest versions; ``policy(severity_class, keep_days)``."""
    kept = metrics.join(policy, "severity_class").filter(F.to_date("status_at") >= F.date_sub(F.lit(as_of).cast("date"), F.col("keep_days")))
    # Versions of a rule are few; they are ranked once for each rule and joined back.
    ranked = kept.select("rule_id", "version").distinct().withColumn("n", F.dense_rank().over(W.partitionBy("rule_id").orderBy(F.desc("version")))).filter(F.col("n") <= versions)
    return kept.join(ranked.drop("n"), ["rule_id", "version"], "left_semi")


def rule_named(name: str) -> Rule:
    return BY_NAME[name]
