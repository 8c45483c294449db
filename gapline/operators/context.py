"""Conversation and context jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions import text as T

# Words by which turns, projects and documents are told apart.
GREETINGS = (
    "hi", "hello", "hey", "hiya", "howdy", "good morning", "good afternoon", "good evening", "what's up", "whats up", "how are you", "how's it going", "greetings", "salutations", "yo", "sup",
    "nice to meet you", "pleasure to meet you",
)
CONVERSATIONAL = ("how are things", "how's everything", "what's new", "nice weather", "how's your day", "thanks", "thank you")
CONTEXT = {
    "has_api": r"@app\.|fastapi|flask|router|endpoint",
    "has_database": r"database|db\.|session|query|model|sqlalchemy",
    "has_auth": r"auth|login|token|jwt|password|security",
    "has_frontend": r"react|vue|angular|component|jsx|tsx",
}
TEST_PATHS, DOCKER_PATH, DOCKER_TEXT = r"test_|_test|tests/|spec_", "dockerfile", "docker"
KEYWORDS = (
    "nginx", "kubernetes", "docker", "container", "deployment", "service", "configmap", "pod", "replica", "ingress", "cloud run", "autoscaling", "cpu", "memory", "port", "environment", "health",
    "liveness", "readiness",
)
CONCEPTS = ("resource limits", "health checks", "environment variables", "port configuration", "service discovery", "load balancing", "auto scaling", "container orchestration")


def classify_intent(turns: DataFrame) -> DataFrame:
    """greeting (exact, or at most five words that start with one), conversational (contains a phrase), else technical; confidence."""
    x = T.strip(F.lower(F.coalesce("text", F.lit(""))))
    words = F.size(F.filter(F.split("text", T.WS + "+"), lambda w: w != ""))
    exact = x.isin(*GREETINGS)
    greets = exact | ((words <= 5) & reduce(lambda a, b: a | b, [x.startswith(g) for g in GREETINGS]))
    chats = reduce(lambda a, b: a | b, [x.contains(c) for c in CONVERSATIONAL])
    intent = F.when(greets, "greeting").when(chats, "conversational").otherwise("technical")
    return turns.withColumns({"intent": intent, "confidence": F.when(intent == "conversational", "medium").otherwise("high")})


def project_context(chunks: DataFrame, by: str, path: str = "path") -> DataFrame:
    """Whether any chunk of a group, by its text or its path, shows each characteristic."""
    text, where = F.lower("text_content"), F.lower(path)
    flags = {k: text.rlike(p) for k, p in CONTEXT.items()}
    flags |= {"has_tests": where.rlike(TEST_PATHS), "has_docker": where.contains(DOCKER_PATH) | text.contains(DOCKER_TEXT)}
    return chunks.groupBy(by).agg(*[F.bool_or(f).alias(k) for k, f in flags.items()])


def semantic_features(chunks: DataFrame) -> DataFrame:
    """Technical terms, configuration concepts and infrastructure patterns of each chunk."""
    text = F.lower("text_content")
    terms = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(text, k))
    close = F.replace(text, F.lit(" "), F.lit(""))
    concepts = F.filter(F.array(*map(F.lit, CONCEPTS)), lambda k: F.contains(close, F.replace(k, F.lit(" "), F.lit(""))))
    raw = F.col("text_content")
    patterns = F.concat_ws(
        ",",
        F.when(raw.contains("replicas:") & text.contains("deployment"), "multi-replica deployment"),
        F.when(raw.contains("livenessProbe") & raw.contains("readinessProbe"), "health monitoring"),
        F.when(raw.contains("resources:") & text.rlike("cpu|memory"), "resource management"),
        F.when(text.contains("autoscaling"), "horizontal scaling"),
    )
    return chunks.select("chunk_id", F.array_join(terms, ",").alias("technical_terms"), F.array_join(concepts, ",").alias("configuration_concepts"), patterns.alias("infrastructure_patterns"))


def term_vocabulary(chunks: DataFrame) -> DataFrame:
    """The technical terms, configuration concepts and infrastructure patterns found anywhere, with the chunks that hold them."""
    found = semantic_features(chunks)
    kinds = ("technical_terms", "configuration_concepts", "infrastructure_patterns")
    named = [F.arrays_zip(F.array_repeat(F.lit(k), F.size(F.split(k, ","))).alias("kind"), F.split(k, ",").alias("term")) for k in kinds]
    each = F.filter(F.concat(*named), lambda x: x["term"] != "")
    return found.select(F.explode(each).alias("t")).groupBy("t.kind", "t.term").agg(F.count("*").alias("chunks"))
