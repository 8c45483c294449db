"""Quality by an interpolated modified Kneser-Ney character n-gram model trained on trusted text.

Every character is a symbol of its own, whatever its script or case; runs of white space are one blank. The n-grams of the trusted
documents are counted (summed in each task first, then sharded by n-gram), and the orders are joined on their shards: the discounts
come from the counts of counts, the weight of the lower order from each context's continuations. The highest order uses counts,
lower orders the number of distinct left neighbours. Every document then gets its perplexity per symbol, and is kept if it isn't
above the given quantile of the trusted documents of its own language that were held out from training.

Scoring has two tiers with the same result. The costs of the ``CACHED`` most frequent n-grams (a bound on what is sent, not on the
model) travel with the tasks, which look up the distinct n-grams of each batch of texts. N-grams that are not among them are left as
rows (document, n-gram, count); the distinct ones are scored by joins with the count tables of all orders, and joined back. If the whole
model is within the bound, an n-gram that isn't in it is known to be unseen and is scored from its shorter parts at once.

Defined cases: null, empty and blank texts have no perplexity (null) and are not kept; very long texts are read whole, in pieces;
documents with null language are one language of their own; languages without held-out trusted documents use the quantile over all of
them; where a part of the trusted documents is empty, all of them stand for it; without trusted text nothing has a perplexity and
nothing is kept; repeated rows are judged each; a document labelled twice is trusted if any label says so; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

ORDER = 4
#: Stands ``ORDER - 1`` times before each text; no character of any text.
START = 0x10FFFF
QUANTILE = 0.995
#: N-grams whose costs travel with the tasks (16 bytes each).
CACHED = 1 << 21
#: Trusted ids (16 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Characters counted or scored together.
TOGETHER = 1 << 20
#: Numbers up to this are told apart by a table, larger ones by sorting.
TABLE = 1 << 24


def held_out(doc_id: Column) -> Column:
    """A quarter of the trusted documents, of which nothing is learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 0


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and parts of the texts, together of bounded length; parts of a long text overlap by what an n-gram needs."""
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text = chr(START) * (ORDER - 1) + text.replace(chr(START), "�").replace("\0", "�")
        for at in range(0, max(1, len(text) - ORDER + 1), TOGETHER):
            owners.append(k)
            parts.append(text[at : at + TOGETHER + ORDER - 1])
            size += len(parts[-1])
            if size >= TOGETHER:
                yield owners, parts
                owners, parts, size = [], [], 0
    if owners:
        yield owners, parts


def tidy(text: str | None) -> str | None:
    """Runs of white space of any kind as one blank, none at the ends."""
    return " ".join(text.split()) if text else text


def numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    if size > TABLE:
        return np.unique(values, return_inverse=True)
    place = np.zeros(size, np.int32)
    place[values] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[values]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of highest order (code points in rows), the place among them of each n-gram of the parts, and the number of
    n-grams of each part.
    """
    lengths = np.array([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, c = numbered(codes, 0x110000)
    pairs, two = numbered(c[:-1].astype(np.int64) * len(letters) + c[1:], len(letters) ** 2)
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes) - ORDER + 1, bool)
    for k in range(1, ORDER):
        inside[ends[:-1] - k] = False
    four = (two[:-2].astype(np.int64) * len(pairs) + two[2:])[inside]
    found, place = numbered(four, len(pairs) ** 2)
    first, last = pairs[found // len(pairs)], pairs[found % len(pairs)]
    points = np.stack([letters[x] for x in (first // len(letters), first % len(letters), last // len(letters), last % len(letters))], axis=1)
    return points.astype(np.uint32), place, lengths - ORDER + 1


def as_strings(points: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(points).view(f"<U{points.shape[1]}").ravel().tolist(), pa.string())


def counts(trusted: DataFrame) -> DataFrame:
    """(g, n): how often each n-gram of highest order stands in the trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, parts in pieces([tidy(t) for t in batch.column("text").to_pylist()]):
                points, place, _ = grams(parts)
                yield pa.RecordBatch.from_arrays([as_strings(points), pa.array(np.bincount(place, minlength=len(points)))], ["g", "n"])

    return trusted.select("text").mapInArrow(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    have = {r["n"]: r["c"] for r in level.filter("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    n1, n2, n3, n4 = (have.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


class Model:
    """Count tables turned into probabilities: for each order (g, p, n) and (ctx, back), and what an unseen symbol gets."""

    def __init__(self, trusted: DataFrame, scratch: Scratch):
        level = scratch.save(counts(trusted))
        levels = [level]
        for k in range(ORDER - 1, 0, -1):
            # Distinct left neighbours of each suffix: every row of the higher order is one.
            level = scratch.save(levels[0].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n")))
            levels.insert(0, level)
        self.symbols = levels[0].count() + 1
        self.grams: list[DataFrame] = []
        self.contexts: list[DataFrame] = []
        for k, level in enumerate(levels, 1):
            d = discounts(level)
            off = F.element_at(F.array(*map(F.lit, d)), F.least(F.col("n"), F.lit(3)).cast("int"))
            rows = level.withColumn("ctx", F.substring("g", 1, k - 1))
            context = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
            context = scratch.save(context.select("ctx", "total", (F.col("left") / F.col("total")).alias("back")))
            rows = rows.join(context, "ctx").select("g", "n", "back", ((F.col("n") - off) / F.col("total")).alias("own"))
            if k == 1:
                self.unseen = context.first()["back"] / self.symbols
                rows = rows.withColumn("p", F.col("own") + F.lit(self.unseen))
            else:
                short = self.grams[-1].select(F.col("g").alias("suffix"), F.col("p").alias("below"))
                rows = rows.withColumn("suffix", F.substring("g", 2, k - 1)).join(short, "suffix").withColumn("p", F.col("own") + F.col("back") * F.col("below"))
            self.grams.append(scratch.save(rows.select("g", "p", "n")))
            self.contexts.append(context.select("ctx", "back"))
        self.size = sum(df.count() for df in (*self.grams, *self.contexts[1:]))

    def costs(self, wanted: DataFrame) -> DataFrame:
        """(g, cost) of distinct n-grams of highest order, seen or not, by joins with the tables of all orders."""
        p: Column = F.lit(self.unseen)
        for k in range(1, ORDER + 1):
            own = self.grams[k - 1].select(F.col("g").alias(f"g{k}"), F.col("p").alias(f"p{k}"))
            wanted = wanted.join(own, F.substring("g", ORDER - k + 1, k) == F.col(f"g{k}"), "left")
            if k > 1:
                back = self.contexts[k - 1].select(F.col("ctx").alias(f"c{k}"), F.col("back").alias(f"b{k}"))
                wanted = wanted.join(back, F.substring("g", ORDER - k + 1, k - 1) == F.col(f"c{k}"), "left")
                p = F.coalesce(F.col(f"b{k}"), F.lit(1.0)) * p
            p = F.coalesce(F.col(f"p{k}"), p)
        return wanted.select("g", (-F.log(p)).alias("cost"))

    def cache(self, limit: int) -> Cache:
        """The whole model, if it is within the limit, else the costs of the most frequent n-grams."""
        if self.size <= limit:
            return Cache([_columns(df, "g", "p") for df in self.grams], [_columns(df, "ctx", "back") for df in self.contexts], self.unseen)
        return Cache([_columns(self.grams[-1].orderBy(F.desc("n"), "g").limit(limit), "g", "p")], None, self.unseen)


def _columns(df: DataFrame, name: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, with their values; not more rows than the cache holds."""
    rows = df.select(name, value).toArrow()
    texts = rows.column(0).to_pylist()
    width = len(texts[0]) if texts else 0
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)
    k = keys(points)
    order = np.argsort(k)
    return k[order], rows.column(1).to_numpy().astype(np.float64)[order]


def keys(points: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams: exact up to three symbols, hashed for four (10^8 n-grams are confused with a chance below 10^-3)."""
    out = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        if k == 3:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out = out * np.uint64(1 << 21) + points[:, k].astype(np.uint64)
    return out


class Cache:
    def __init__(self, grams_: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]] | None, unseen: float):
        self.grams, self.contexts, self.unseen = grams_, contexts, unseen

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, absent: np.ndarray | float) -> np.ndarray:
        known, values = table
        if not len(known):
            return np.zeros(len(wanted)) + absent
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, values[at], absent)

    def costs(self, points: np.ndarray) -> np.ndarray:
        """Cost of each n-gram; NaN if it has to be looked up elsewhere."""
        if self.contexts is None:
            return -np.log(self.look(self.grams[-1], keys(points), np.nan))
        p = self.look(self.grams[0], keys(points[:, ORDER - 1 :]), self.unseen)
        for k in range(2, ORDER + 1):
            back = self.look(self.contexts[k - 1], keys(points[:, ORDER - k : ORDER - 1]), 1.0)
            p = self.look(self.grams[k - 1], keys(points[:, ORDER - k :]), back * p)
        return -np.log(p)


def perplexities(docs: DataFrame, model: Model, scratch: Scratch, cached: int = CACHED) -> DataFrame:
    """(doc_id, lang, perplexity, ...): perplexity per symbol of each whole text; other columns of ``docs`` but text stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model.cache(cached))
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", symbols bigint, known double, rest array<struct<g:string,n:bigint>>"
    rest_type = pa.list_(pa.struct([("g", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                total, known, rest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [None] * batch.num_rows
                for owners, parts in pieces([tidy(t) for t in batch.column("text").to_pylist()]):
                    points, place, sizes = grams(parts)
                    cost = cache.costs(points)
                    unknown = np.isnan(cost)
                    each = np.where(unknown, 0, cost)[place]
                    starts = np.cumsum(sizes) - sizes
                    full = sizes > 0
                    np.add.at(total, np.array(owners)[full], sizes[full])
                    if full.any():
                        np.add.at(known, np.array(owners)[full], np.add.reduceat(each, starts[full]))
                    if unknown.any():
                        names = as_strings(points).to_pylist()
                        for k, s, n in zip(owners, starts.tolist(), sizes.tolist(), strict=True):
                            g, count = np.unique(place[s : s + n][unknown[place[s : s + n]]], return_counts=True)
                            rest[k] = [*(rest[k] or ()), *({"g": names[i], "n": c} for i, c in zip(g.tolist(), count.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total), pa.array(known), pa.array(rest, rest_type)], [*kept, "symbols", "known", "rest"])

    scored = docs.mapInArrow(run, schema)
    perplexity = F.when(F.col("symbols") > 0, F.exp((F.col("known") + F.col("more")) / F.col("symbols"))).alias("perplexity")
    if model.size <= cached:
        return scored.withColumn("more", F.lit(0.0)).select(*kept, perplexity)
    scored = scratch.save(scored.withColumn("at", F.monotonically_increasing_id()))
    rows = scored.select("at", F.explode("rest").alias("r")).select("at", "r.g", "r.n")
    prices = scratch.save(model.costs(rows.select("g").distinct()))
    more = rows.join(prices, "g").groupBy("at").agg(F.sum(F.col("n") * F.col("cost")).alias("sum"))
    return scored.join(more, "at", "left").withColumn("more", F.coalesce("sum", F.lit(0.0))).select(*kept, perplexity)


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, cached: int = CACHED) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every document; ``trusted_ids(doc_id)`` names the trusted ones."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    ids = scratch.save(trusted_ids.select(F.col("doc_id").alias("trusted_id")).filter("trusted_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    read = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    nothing = F.lit(None).cast("double")
    trusted = read.join(ids, read.doc_id == ids.trusted_id, "left_semi").filter(F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0)
    learned = trusted.filter(~held_out(F.col("doc_id")))
    if not learned.limit(1).count():
        learned = trusted
        if not trusted.limit(1).count():
            return read.select("doc_id", "lang", nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(False).alias("keep"))
    scored = scratch.save(perplexities(read, Model(learned, scratch), scratch, cached))
    good = scored.join(ids, scored.doc_id == ids.trusted_id, "left_semi").filter("perplexity is not null")
    apart = good.filter(held_out(F.col("doc_id")))
    good = apart if apart.limit(1).count() else good
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    every = good.agg(limit).first()[0]
    by_lang = good.groupBy(F.col("lang").alias("of")).agg(limit.alias("own"))
    scored = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("own", F.lit(every)))
    return scored.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids whose labels say good quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.max(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")
