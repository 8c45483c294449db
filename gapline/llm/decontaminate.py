"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over ``len(mask)`` successive words: positions marked ``1`` are hashed, positions marked ``0`` are
ignored, so a seed still matches where a word at an ignored position was replaced. The masks cover every way in which words can
be replaced within the tolerance: whichever words of a window differ, one of its masks hashes none of them at some offset, so
nothing that verification would accept is missed. Benchmark seeds are joined to the seeds of
all training texts; around each hit the whole item is laid over the text on the hit's diagonal and the words that agree are
counted.

Defined cases: a null, empty or blank text has no seeds and is never contaminated; items shorter than a window are compared
as a whole, with the same tolerance; items of less than ``least_words`` words (1: none) match nothing, which spares
short ones that occur by chance; very long texts are read whole; of equal hits each is a row; repeated benchmark rows count once; repeated
documents are reported under their id once; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch, words

#: An item is found in a text if, within ``WINDOW`` successive words (or the whole item if it is shorter), this share agrees.
WINDOW, AGREE = 13, 0.75
#: No item is left out by default.
LEAST_WORDS = 1
#: Masks for each size of window at ``AGREE``. They begin and end with a hashed word, so that what lies under a hit is in the text.
MASKS = {
    5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11011", "1111", "1100011"),
    9: ("111011", "1001111", "11010011", "111101"), 10: ("111011", "11010011", "11111"), 11: ("1101011", "1110011"),
    12: ("111011", "110100011", "11001011", "110111"), 13: ("111011", "1100001011", "110111"),
}
#: Rows (seeds, hits, items) up to which one side is broadcast; more are joined by a shuffle. Text seeds are then first looked up in a
#: bitmap of the benchmark's seeds with so many bits for each (up to ``MOST_BITS``, 64 MB), so that few of them are shuffled.
BROADCAST_ROWS = 500_000
BITS, MOST_BITS = 16, 1 << 29


def normal_words(text: Column) -> Column:
    return words(F.lower(text))


def covers(masks: tuple[str, ...], size: int, differ: int) -> bool:
    """Whether some mask at some offset avoids the replaced words, for all choices of ``differ`` words in ``size``."""
    hashed = [{at + k for k, bit in enumerate(m) if bit == "1"} for m in masks for at in range(size - len(m) + 1)]
    return all(any(h.isdisjoint(places) for h in hashed) for places in itertools.combinations(range(size), differ))


@functools.cache
def masks_for(size: int, agree: float) -> tuple[str, ...]:
    """Masks that find every window of ``size`` words of which the share ``agree`` is the same."""
    differ = size - math.ceil(size * agree)
    if covers(MASKS.get(size, ()), size, differ):
        return MASKS[size]
    # The words that agree stand in differ + 1 runs at most, so that one run is as long as this.
    return ("1" * max(1, -(-(size - differ) // (differ + 1))),)


def seeds(rows: DataFrame, masks: dict[str, int]) -> DataFrame:
    """Explode ``w`` (array of words) to one row for each position and mask: the other columns, ``pos``, ``mask``, ``h``.

    Shifted copies of the array are zipped, so that hashing runs on plain struct fields in generated code, and the array
    itself is not carried along (a long text would be copied for each of its words).
    """
    used = sorted({k for m in masks for k, bit in enumerate(m) if bit == "1"})
    shifted = [F.slice(F.col("w"), F.lit(k + 1), F.size("w")).alias(f"w{k}") for k in used]
    others = [c for c in rows.columns if c != "w"]
    at = rows.select(*others, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "s"))
    each = []
    for m, n in masks.items():
        h = F.xxhash64(F.lit(n), *[F.col(f"s.w{k}") for k, bit in enumerate(m) if bit == "1"])
        each.append(F.struct(F.lit(n).alias("mask"), F.when(F.col(f"s.w{len(m) - 1}").isNotNull(), h).alias("h")))
    at = at.select(*others, "pos", F.explode(F.array(*each)).alias("seed")).filter("seed.h is not null")
    return at.select(*others, "pos", "seed.mask", "seed.h")


def maybe(asked: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``h`` has its bit set in the bitmap of ``wanted``: all that are in it, and few others."""
    place = F.pmod("h", F.lit(bits)).cast("bigint")
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    rows = asked.withColumn("p", place).join(F.broadcast(maps), F.bitmap_bucket_number("p") == F.col("bucket"))
    byte = F.conv(F.hex(F.substr("map", F.floor(F.bitmap_bit_position("p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(p) % 8 as int))")) != 0
    return rows.filter(is_set).select(*asked.columns)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    agree: float = AGREE,
    broadcast_rows: int = BROADCAST_ROWS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Rows (doc_id, item_id, start, matched, item_words): each place where an item is found in a document.

    ``start`` is the word of the document on which the item's first word lies (negative if that is cut off), ``matched`` the
    number of the item's words that agree there.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def sized(df: DataFrame) -> DataFrame:
        """Broadcast what was counted to be small; what is larger is joined by a shuffle."""
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).filter(F.size("w") >= max(1, least_words)).distinct()
    items = scratch.save(items.withColumn("item", F.xxhash64("item_id", "w")).withColumn("n", F.size("w")))
    size = F.least(F.col("n"), F.lit(window))
    sizes = sorted(r["size"] for r in items.select(size.alias("size")).distinct().collect()) or [window]  # not more than ``window``
    numbers = {m: k for k, m in enumerate(sorted({m for k in sizes for m in masks_for(k, agree)}))}
    parts = [seeds(items.filter(size == k).select("item", "n", "w"), {m: numbers[m] for m in masks_for(k, agree)}) for k in sizes]
    wanted = scratch.save(functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("pos", "item_pos"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), normal_words(F.col("text")).alias("w"))
    asked = seeds(texts, numbers)
    if (known := wanted.count()) > broadcast_rows:
        asked = maybe(asked, wanted, min(MOST_BITS, 1 << max(15, (known * BITS).bit_length())))
    found = asked.join(F.broadcast(wanted) if known <= broadcast_rows else wanted, ["mask", "h"]).select("doc_id", "row", "item", "n", (F.col("pos") - F.col("item_pos")).alias("start"))
    hits = scratch.save(found.distinct())
    by_doc = hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item", "n", "start")).alias("hits")).withColumnRenamed("doc_id", "of").withColumnRenamed("row", "of_row")
    by_doc = sized(scratch.save(by_doc))
    read = docs.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_row")))
    read = read.select("doc_id", normal_words(F.col("text")).alias("w"), "hits")
    seen = F.transform("hits", lambda h: F.struct(h.item.alias("item"), h.start.alias("start"), F.slice(F.col("w"), F.greatest(h.start, F.lit(0)) + 1, F.greatest(h.n + F.least(h.start, F.lit(0)), F.lit(0))).alias("seen")))
    laid = read.select("doc_id", F.explode(seen).alias("at")).select("doc_id", "at.*")
    laid = laid.join(sized(items.select("item", "item_id", F.col("w").alias("words"))), "item")
    return overlaps(laid, window, agree).distinct()


def overlaps(hits: DataFrame, window: int, agree: float) -> DataFrame:
    """Keep the hits (start, words, seen) whose best window of words agrees enough; ``seen`` is the text under the item."""
    under = F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(-F.col("start"), F.lit(0))), F.col("seen"))
    same = F.zip_with("words", under, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    hits = hits.withColumn("same", F.slice(same, F.lit(1), F.size("words"))).withColumn("size", F.least(F.lit(window), F.size("words")))
    sums = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda k: F.aggregate(F.slice(F.col("same"), k, F.col("size")), F.lit(0), lambda a, x: a + x))
    hits = hits.withColumn("best", F.array_max(sums)).withColumn("matched", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    return hits.filter(F.col("best") >= F.ceil(F.col("size") * F.lit(agree))).select("doc_id", "item_id", "start", "matched", F.size("words").alias("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item is found; rows without an id are kept or dropped together."""
    dirty = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("gapline_dirty")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["gapline_dirty"]), "left_anti")
