"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws ``u`` from a hash of its id and gets the exponential key ``-ln(u) / quality``; ascending keys are a
weighted sample without replacement. Each source's budget of words is its share of all words by weight, at most
``most_epochs`` times its size, with the excess shared again by weight. A budget is filled by complete epochs first; the
rest is taken in key order until the running sum of sizes reaches it (the document on the edge is taken if that brings the sum
nearer). Running sums are taken over buckets of ln(key), of which the fullest holds less than ``1 / BUCKETS`` of a source
whatever its weights are; only the bucket on the edge is sorted, so no task ever holds a source. One row for each source, and no
more, goes through the windows that find the targets.

Defined cases: null, empty and blank texts have size 0 and are taken as often as their key falls below the edge; null sources
are one source, ordered last; very long texts are counted whole; equal keys are taken in order of id and size; repeated rows are
documents of their own; an empty table gives an empty result; if all sizes are
0, all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.llm.common import Scratch, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
#: Buckets for each factor e of the keys. ln(key) of an exponential key has a density of at most 1 / e.
BUCKETS = 1024
#: Weights below this would only delay a document for ever.
LEAST_QUALITY = 0.05


def quality(text: Column) -> Column:
    """Quality weight up to 1: one plus the letters and white space over one plus the characters, from the whole text."""
    text = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(text, r"[\p{L} \t\n\r\f]+", ""))
    return F.greatest(F.lit(LEAST_QUALITY), (F.lit(1.0) + F.length(text) - other) / (F.lit(1.0) + F.length(text)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the id (repeatable, and the same in any SQL engine)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most_epochs: int) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with ``target`` added.

    Sharing by weight, stopping at the cap and sharing the excess again ends at the water level: sources in order of
    cap / weight are full as long as the level over the others exceeds theirs. The level rises while full sources are set aside
and falls once others are, so the right one is the highest under which its own source isn't full.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most_epochs)
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("full_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("open_weight", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    level = (F.sum("source_size").over(W.partitionBy()) - F.col("full_before")) / F.col("open_weight")
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("open_level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy()))
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = 7, quality_weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    scratch = Scratch(docs.sparkSession, "mixing")
    weight = quality(F.col("text")) if quality_weight is None else quality_weight
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = scratch.save(sized.withColumn("bucket", F.floor(F.log("key") * BUCKETS)))
    totals = scratch.save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = scratch.save(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    targets = targets.withColumnRenamed("source", "of")
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = totals.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("of"))).filter("before <= rest")
    edges = edges.groupBy("of").agg(F.max(F.struct("bucket", "before")).alias("e"), *[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")])
    plan = scratch.save(edges.select("of", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"), "source_size", "target", "epochs", "rest"))
    placed = sized.join(plan, sized.source.eqNullSafe(plan.of))
    sure = placed.filter("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("int"))
    running = F.sum("size").over(W.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    on_edge = placed.filter("bucket = edge").withColumn("extra", (running - F.col("size") / 2 <= F.col("rest")).cast("int"))
    out = [F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken")]
    return sure.select(*out).unionByName(on_edge.select(*out))
