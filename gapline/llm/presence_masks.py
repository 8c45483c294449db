"""Ranked lexical search by presence masks.

The documents become an inverted index in blocks: a block holds up to so many documents, and for each term the documents of the
block that hold it, as sorted positions, with the number of occurrences. A block's part of the answer to an item takes four steps:

1. each term of the item gives a bitmap over the block's documents; turned over, the bitmaps are each document's mask of matched terms;
2. equal masks are sorted together, so that documents fall into groups by mask;
3. a mask's maximum score is the sum of its terms' largest contributions in the block;
4. groups are scored by descending maximum, until the next maximum is below the item's k-th score so far. All documents of the groups
   that were not reached score less than that.

Blocks are dealt to shards of bounded size and items go to every shard, by the shuffle; the k-th score is carried from block to block of
a shard, and the k best of each item and shard are merged by key. Nothing is broadcast but the set of the items' terms, which tells the
index what to leave out, and only while it is below a bound of entries and bytes; beyond it, all terms are indexed, with the same result.

All scores are 64-bit integers. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.

Defined cases: documents with null text, or without a term, count for nothing; null texts of items have no terms, and items without
a term that occurs have no rows; rows that share an item_id are one item with the terms of all of them; rows that share a doc_id are
documents of their own, each with a rank; documents without an id are ranked, behind equal scores with an id; very long texts are
read whole, and items of very many terms are laid over fewer documents at a time; empty tables give an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.llm.common import Scratch, slices

#: Fixed by the definition of terms: what separates them.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the definition of scores.
SATURATION, LENGTH_SHARE = 8, 75
#: Documents and postings of a block, postings of a shard, cells of an item's bitmaps.
DOCUMENTS, POSTINGS, SHARD, CELLS = 8192, 1 << 20, 1 << 21, 1 << 24
#: Terms and bytes up to which the items' terms are sent to the tasks that index.
VOCABULARY, VOCABULARY_BYTES = 1 << 20, 1 << 25

_KEEP = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
INDEX = "docs long, words long, ids array<long>, lengths binary, terms array<string>, sizes array<int>, places binary, counts binary"


def terms(text: Column) -> Column:
    """The terms of a text, repeats included; null for null."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[^{NO_TERM}]+"), F.lit(0))


def index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the inverted index (:data:`INDEX`), of the terms in ``vocabulary`` or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        postings: dict[bytes, tuple[list[int], list[int]]] = {}
        docs = words = held = 0

        def block() -> pa.RecordBatch:
            names = sorted(postings)
            places = np.array([p for t in names for p in postings[t][0]], np.int32)
            counts = np.array([c for t in names for c in postings[t][1]], np.int32)
            values = {
                "docs": pa.array([docs], pa.int64()), "words": pa.array([words], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()),
                "terms": pa.array([[t.decode() for t in names]], pa.list_(pa.string())), "sizes": pa.array([[len(postings[t][0]) for t in names]], pa.list_(pa.int32())),
                "places": pa.array([places.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(values.values()), list(values))

        for part in slices(batches):
            for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = text.encode().translate(_KEEP).split()
                if not found:
                    continue
                docs, words = docs + 1, words + len(found)
                tally = Counter(found)
                hits = tally.keys() if vocabulary is None else tally.keys() & vocabulary
                if not hits:
                    continue
                for t in hits:
                    at, n = postings.setdefault(t, ([], []))
                    at.append(len(ids))
                    n.append(tally[t])
                ids.append(doc_id)
                lengths.append(len(found))
                held += len(hits)
                if len(ids) >= DOCUMENTS or held >= POSTINGS:
                    yield block()
                    ids, lengths, postings = [], [], {}
                    docs = words = held = 0
        if docs:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, INDEX)


class Block:
    """Postings of a block with what each adds to a score, weights left out."""

    def __init__(self, row: dict, count: int, words: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        relative = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * count) // words
        self.start = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
        self.places = np.frombuffer(row["places"], np.int32)
        tf = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.gain = (1_000_000_000 * tf) // (1000 * tf + SATURATION * relative[self.places])
        self.top = np.maximum.reduceat(self.gain, self.start[:-1]) if len(self.gain) else np.zeros(0, np.int64)
        self.at = {t: n for n, t in enumerate(row["terms"])}

    def search(self, words: list[str], weights: list[int], k: int, best: list[tuple]) -> list[tuple]:
        """The k best (-score, id is null, id) of ``best`` and this block."""
        known = [(self.at[t], w) for t, w in zip(words, weights, strict=True) if w > 0 and t in self.at]
        if not known:
            return best
        rows, weight = (np.array(x, np.int64) for x in zip(*known, strict=True))
        most = weight * self.top[rows]
        if len(best) == k and most.sum() < -best[-1][0]:
            return best
        lists = [slice(self.start[r], self.start[r + 1]) for r in rows.tolist()]
        step = max(64, CELLS // len(rows))
        for first in range(0, len(self.ids), step):
            best = self._range(first, min(first + step, len(self.ids)), lists, weight, most, k, best)
        return best

    def _range(self, first: int, last: int, lists: list[slice], weight: np.ndarray, most: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        cuts, gains = [], []
        present = np.zeros((-(-len(lists) // 64) * 64, last - first), bool)
        for n, of in enumerate(lists):
            places = self.places[of]
            a, b = np.searchsorted(places, [first, last])
            cuts.append(places[a:b] - first)
            gains.append(self.gain[of][a:b])
            present[n, cuts[-1]] = True
        # Bitmaps by term become masks by document, of whole 64-bit words.
        masks = np.ascontiguousarray(np.packbits(present, axis=0, bitorder="little").T).view(np.uint64)
        order = np.lexsort(masks.T)
        ranked = masks[order]
        starts = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(order))
        matched = np.unpackbits(ranked[starts].view(np.uint8), axis=1, bitorder="little")[:, : len(lists)]
        bound = matched @ most
        groups = np.argsort(-bound, kind="stable")
        groups = groups[bound[groups] > 0]
        size = np.cumsum(ends[groups] - starts[groups])
        at, chunk = 0, 8 * k
        while at < len(groups) and not (len(best) == k and bound[groups[at]] < -best[-1][0]):
            done = size[at - 1] if at else 0
            to = min(int(np.searchsorted(size, done + chunk)) + 1, len(groups))
            docs = np.sort(np.concatenate([order[starts[g] : ends[g]] for g in groups[at:to].tolist()]))
            score = np.zeros(len(docs), np.int64)
            for places, gain, w in zip(cuts, gains, weight.tolist(), strict=True):
                if len(places):
                    spot = np.minimum(np.searchsorted(places, docs), len(places) - 1)
                    score += np.where(places[spot] == docs, w * gain[spot], 0)
            if len(score) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                docs, score = docs[score >= edge], score[score >= edge]
            ids = [self.ids[first + d] for d in docs.tolist()]
            best = sorted([*best, *((-s, i is None, i if i is not None else 0) for s, i in zip(score.tolist(), ids, strict=True) if s > 0)])[:k]
            at, chunk = to, 2 * chunk
        return best


def top_k(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, ties to the smaller doc_id."""
    scratch = Scratch(docs.sparkSession, "presence_masks")
    asked = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    asked = scratch.save(asked)
    distinct = asked.select("term").distinct()
    count, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    small = count <= VOCABULARY and size <= VOCABULARY_BYTES
    blocks = scratch.save(index(docs, frozenset(t.encode() for (t,) in distinct.collect()) if small else None))
    documents, words, postings, most = blocks.agg(
        *(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("docs"), F.col("words"), F.octet_length("places") / 4)), F.count("*")
    ).first()

    df = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight"))
    asks = weighed.groupBy("item_id").agg(F.collect_list("term").alias("words"), F.collect_list("weight").alias("weights"))

    # As many shards as memory needs, and several for each core, so that uneven ones even out.
    shards = int(max(1, -(-postings // SHARD), min(4 * docs.sparkSession.sparkContext.defaultParallelism, most)))
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("places", "lengths"), F.lit(shards))).withColumn("item", F.lit(None).cast("struct<item_id:bigint,words:array<string>,weights:array<bigint>>"))
    asks = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.struct(F.col("item_id").cast("long").alias("item_id"), "words", "weights").alias("item"))
    met = dealt.unionByName(asks, allowMissingColumns=True).withColumn("asks", F.col("item").isNotNull()).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            if row["shard"] != now:
                now, held = row["shard"], []
            if not row["asks"]:
                held.append(Block(row, documents, words))
                continue
            best: list[tuple] = []
            for block in held:
                best = block.search(row["item"]["words"], row["item"]["weights"], k, best)
            if best:
                columns = [pa.array([x] * len(best), pa.int64()) for x in (row["item"]["item_id"],)]
                columns += [pa.array([None if none else i for _, none, i in best], pa.int64()), pa.array([-s for s, _, _ in best], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    found = met.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
