"""Exact percentiles by distributed selection.

No task holds a group's values. A first pass counts values in equal bins between each group's least and greatest value, with the least
and greatest value of every bin; the bins that hold the wanted ranks are the ranges of the next pass. Once no range holds more than
:data:`LEAF` values, one more pass counts those by value. Each pass is an aggregate that combines before its shuffle; on evenly spread
values there are two. A range's ends have bins of their own, so each pass narrows every range, however values are spread.

Nulls are left out, NaN is above all numbers, infinite values are values; groups whose values are all null have no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.sources.shared import new_folder, written

#: Bins of a range, values of a range that are ordered as they are, ranges that are sent to the rows.
BINS, LEAF, RANGES = 4096, 100_000, 200_000


def bin_of(v: Column, low: Column, high: Column) -> Column:
    """0 for the low end, BINS + 1 for the high end, between them by an even scale; it never falls as ``v`` rises."""
    scale = F.nanvl((v / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.0))
    return F.when(v == low, 0).when(v == high, BINS + 1).otherwise(1 + F.least(F.lit(BINS - 1), F.floor(scale * BINS).cast("int")))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """``by``, n, percentiles (an array in the order of ``ps``): positions ``(n - 1) p``, linear between neighbours."""
    folder, passes = new_folder(rows.sparkSession, "percentiles"), 0
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = rows.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")

    position = [(F.col("n") - 1) * F.lit(p) for p in ps]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in position])))
    ends = written(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), f"{folder}/ends")
    wanted = ends.select("g", "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high", F.col("n").alias("inside"))
    ranges = ends.select("g", "low", "high")

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows within the ranges; few ranges go to the rows, which then stay where they are, however large one group is."""
        few = ranges.count() <= RANGES
        ranges = ranges.select(F.col("g").alias("of"), "low", "high")
        return rows.join(F.broadcast(ranges) if few else ranges, (F.col("g") == F.col("of")) & F.col("v").between(F.col("low"), F.col("high"))).drop("of")

    def chosen(counted: DataFrame, order: str, *fields: Column) -> DataFrame:
        """The part of each range in which each wanted rank lies."""
        upto = F.sum("c").over(W.partitionBy("g", "low", "high").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        parts = counted.withColumn("upto", upto).select(F.col("g").alias("of"), F.col("low").alias("l"), F.col("high").alias("h"), "c", "upto", *fields)
        within = F.col("rank") - F.col("before")
        same = (F.col("g") == F.col("of")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
        return wanted.join(parts, same & (within < F.col("upto")) & (within >= F.col("upto") - F.col("c")))

    while True:
        counted = inside(ranges).groupBy("g", "low", "high", bin_of(F.col("v"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        found = chosen(counted, "bin", F.col("least"), F.col("most"))
        found = found.select("g", "n", "rank", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("c").alias("inside"))
        if passes:
            found = found.unionByName(wanted.filter("low = high"))
        passes += 1
        wanted = written(found, f"{folder}/{passes}")
        open_ranges = wanted.filter("low <> high")
        most = open_ranges.agg(F.max("inside")).first()[0]
        ranges = open_ranges.select("g", "low", "high").distinct()
        if most is None or most <= LEAF:
            break

    settled = wanted.filter("low = high").select("g", "n", "rank", F.col("low").alias("v"))
    if most is not None:
        values = inside(ranges).groupBy("g", "low", "high", "v").agg(F.count("*").alias("c"))
        settled = settled.unionByName(chosen(values, "v", F.col("v")).select("g", "n", "rank", "v"))
    at = settled.groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    percentiles = []
    for x in position:
        a, b = F.col("at")[F.floor(x)], F.col("at")[F.ceil(x)]
        percentiles.append(F.when(a == b, a).otherwise(a * (F.ceil(x) - x) + b * (x - F.floor(x))))
    return at.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", F.array(*percentiles).alias("percentiles"))


def sketch_k(error: float) -> int:
    """The size of a KLL sketch whose ranks are off by at most ``error`` of all values, at 99 % confidence (published fit 2.296 / k ** 0.9021)."""
    return min(65535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021))))
