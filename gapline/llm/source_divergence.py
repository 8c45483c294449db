"""Source divergence audit: how far the use of words in one source of a language is from other sources and from the language.

Terms are counted where the texts are. A task packs terms by length: up to 8 bytes become one 64-bit word, up to 16 bytes two, in
big-endian order, so that numbers sort as bytes do; longer terms go to buckets by length, a power of two, as byte strings of that width.
Words are sorted by a radix sort of 16-bit digits, buckets by bytes, both stable over documents in order of arrival, so that the runs of
equal (group, term) give occurrences, and the runs of documents in them give document counts. Buffers are bounded, and each leaves
one row for every (lang, source, term) that it holds. One shuffle by (lang, term) adds these rows up and finds, in the same
partitions, the terms that enough documents of the language hold.

A term's share in a group is an integer, ``1 + floor(10**9 * (count + 5) / (N + 5 V))``. Sums of absolute differences between all pairs of
sources are taken in tiles: up to :data:`TILE` sources against as many, over a block of up to :data:`TERMS` terms, as a matrix in which
a term that a source lacks has the share of count 0. A tile's sum is kept relative to that of count 0, so that terms which neither source
has need no rows; the sums of all blocks are added by pair.

Defined cases: null text, lang and source are the empty string; a group without terms takes part with counts of 0; a language
without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows are documents of
their own; very long texts are read whole, cut nowhere; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

#: Fixed by the definition: documents of its language that a kept term is in, what is added to every count, terms shown for a group.
LEAST_DOCUMENTS, ADDED, SHOWN = 30, 5, 50
#: Tokens of a buffer, bytes of the texts that are cut at a time, bytes of long terms of a buffer.
TOKENS, TEXTS, LONG = 1 << 21, 1 << 22, 1 << 25
#: Sources of a tile, terms of a block.
TILE, TERMS = 256, 512

#: A byte's form in a term: ASCII letters in lower case, bytes beyond ASCII as they are, 0 for what separates.
_FORM = np.frombuffer(bytes(c if c > 127 or chr(c).isalpha() else 0 for c in range(256)).lower(), np.uint8)
#: The first n bytes of a word.
_FIRST = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``keys`` of unsigned integers, the most significant key first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = ((key >> np.array(shift, key.dtype)) & np.array(0xFFFF, key.dtype)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equal ones starts, its length, and the number of documents in it."""
    new = np.zeros(len(docs), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    doc = new.copy()
    doc[1:] |= docs[1:] != docs[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(docs))), np.add.reduceat(doc.astype(np.int64), starts)


class Counter:
    """Terms of many documents, by group; documents arrive in order."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.tokens = self.long = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, first_doc: int) -> None:
        """The texts between ``offsets`` of ``data``, each of its group."""
        size = len(data)
        form = np.zeros(size + 16, np.uint8)
        form[:size] = _FORM[data]
        inside = form[: size + 1] != 0
        border = np.zeros(size + 1, bool)
        border[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (border | ~before))
        ends = np.flatnonzero(before & (border | ~inside))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        group, doc, length = groups[doc], (doc + first_doc).astype(np.uint32), ends - starts
        # Overlapping 64-bit words at every byte.
        words = np.ndarray((size + 9,), ">u8", form.data, strides=(1,))
        for width, chosen in ((1, length <= 8), (2, (length > 8) & (length <= 16))):
            at, n = starts[chosen], length[chosen]
            packed = [words[at + 8 * w].astype(np.uint64) & _FIRST[np.clip(n - 8 * w, 0, 8)] for w in range(width)]
            self._keep(width, group[chosen], doc[chosen], *packed)
        far = np.flatnonzero(length > 16)
        bucket = np.ceil(np.log2(length[far])).astype(int)
        raw = form.tobytes()
        for b in np.unique(bucket).tolist():
            at = far[bucket == b]
            self.long += len(at) << b
            self._keep(1 << b, group[at], doc[at], np.array([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], f"S{1 << b}"))
        self.tokens += len(starts)

    def _keep(self, kind: int, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.setdefault(kind, []).append(columns)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, term, occurrences, documents) of all that was added; the buffer is empty then."""
        for kind, parts in sorted(self.parts.items()):
            group, doc, *term = (np.concatenate(x) for x in zip(*parts, strict=True))
            if kind <= 2:
                order = radix_order([group, *term])
            else:
                order = np.argsort(term[0], kind="stable")
                order = order[radix_order([group[order]])]
            group, doc, *term = (x[order] for x in (group, doc, *term))
            starts, n, docs = run_counts([group, *term], doc)
            term = [x[starts] for x in term]
            name = np.stack(term, axis=1).astype(">u8").reshape(-1).view(f"S{8 * kind}") if kind <= 2 else term[0]
            yield group[starts], name, n, docs
        self.parts, self.tokens, self.long = {}, 0, 0


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for each buffer of each task, from ``docs(lang, source, text)`` without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        counter, seen = Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            names = list(known)
            for group, term, n, in_docs in counter.take():
                for at in range(0, len(group), 50_000):
                    cut = slice(at, at + 50_000)
                    of = [names[g] for g in group[cut].tolist()]
                    columns = [pa.array([x[0] for x in of]), pa.array([x[1] for x in of]), pa.array(term[cut].tolist(), pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n[cut], pa.int64()), pa.array(in_docs[cut], pa.int64())], ["lang", "source", "term", "n", "docs"])
            known.clear()

        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            _, bounds, data = text.buffers()
            bounds = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(data or b"", np.uint8)
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            at = 0
            while at < len(pairs):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TEXTS, side="right")) - 1)
                groups = np.array([known.setdefault(p, len(known)) for p in pairs[at:to]], np.uint32)
                counter.add(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], groups, seen)
                seen, at = seen + to - at, to
                if counter.tokens >= TOKENS or counter.long >= LONG:
                    yield from out()
                    seen = 0
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, kept: Column) -> Column:
    """A term's share in billionths, exact; 0 where no term is kept."""
    top = F.lit(1_000_000_000).cast("decimal(38,0)") * (count + ADDED)
    return F.when(kept > 0, 1 + F.call_function("div", top, total + ADDED * kept)).otherwise(F.lit(0)).cast("long")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for other sources, ``term`` rows for the source's own words."""
    scratch = Scratch(docs.sparkSession, "source_divergence")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    here = W.partitionBy("lang", "term")
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("id", F.monotonically_increasing_id())
    kept = counts.withColumns({"all_n": F.sum("n").over(here), "all_docs": F.sum("docs").over(here), "term_id": F.max("id").over(here)})
    kept = scratch.save(kept.filter(F.col("all_docs") >= LEAST_DOCUMENTS).withColumn("last", F.col("id") == F.col("term_id")).drop("id", "docs", "all_docs"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.groupBy("lang").agg(F.sum("n").alias("all_total"), F.count_if("last").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0, ["total", "all_total", "kept"])
    groups = groups.withColumn("no", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count("*").over(W.partitionBy("lang")))
    groups = scratch.save(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("kept"))))

    shares = kept.join(groups, ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("kept")))
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = own.withColumn("rank", rank).filter(F.col("rank") <= SHOWN)

    pairs = distances(shares, groups)
    side = groups.select("lang", "no", "source")
    pairs = pairs.join(side, ["lang", "no"]).drop("no").join(side.withColumnsRenamed({"no": "other", "source": "item"}), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(own)


def distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, no, other, value) for every two sources of a language, both ways."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("long")
    tiles = F.ceil(F.col("sources") / TILE).cast("long")
    row = ["lang", "no", "term_id", "p", "absent"]
    filled = shares.filter("sources > 1").withColumn("block", F.pmod(F.xxhash64("term_id"), blocks)).select(*row, "block", tiles.alias("tiles"))
    # Every source is in every block, for the terms that others have.
    bare = groups.filter("sources > 1").select(
        "lang", "no", F.lit(-1).cast("long").alias("term_id"), F.lit(-1).cast("long").alias("p"), "absent", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), tiles.alias("tiles")
    )
    own = F.floor(F.col("no") / TILE).cast("long")
    rows = filled.unionByName(bare).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least(own, "facing"), "high": F.greatest(own, "facing")}).drop("tiles", "facing")

    def tile(block: pd.DataFrame) -> pd.DataFrame:
        no, at = np.unique(block["no"].to_numpy(), return_inverse=True)
        absent = np.zeros(len(no), np.int64)
        absent[at] = block["absent"].to_numpy()
        has = block["term_id"].to_numpy() >= 0
        term, column = np.unique(block["term_id"].to_numpy()[has], return_inverse=True)
        matrix = np.repeat(absent[:, None], len(term), axis=1)
        matrix[at[has], column] = block["p"].to_numpy()[has]
        low, high = int(block["low"].iloc[0]), int(block["high"].iloc[0])
        found = []
        for i in np.flatnonzero(no // TILE == low).tolist():
            others = np.flatnonzero((no // TILE == high) & (no > no[i]))
            value = np.abs(matrix[others] - matrix[i]).sum(axis=1) - len(term) * np.abs(absent[others] - absent[i])
            found.append(pd.DataFrame({"lang": block["lang"].iloc[0], "no": no[i], "other": no[others], "value": value}))
        return pd.concat(found) if found else pd.DataFrame({"lang": [], "no": [], "other": [], "value": []})

    parts = rows.groupBy("lang", "low", "high", "block").applyInPandas(tile, "lang string, no bigint, other bigint, value bigint")
    parts = parts.groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))
    sides = groups.select("lang", F.col("no").cast("long").alias("no"), "absent", "kept")
    parts = parts.join(sides, ["lang", "no"]).join(sides.select("lang", F.col("no").alias("other"), F.col("absent").alias("other_absent")), ["lang", "other"])
    parts = parts.withColumn("value", F.col("value") + F.col("kept") * F.abs(F.col("absent") - F.col("other_absent")))
    both = F.explode(F.array(F.struct("no", "other"), F.struct(F.col("other").alias("no"), F.col("no").alias("other"))))
    return parts.select("lang", both.alias("pair"), "value").select("lang", "pair.no", "pair.other", "value")
