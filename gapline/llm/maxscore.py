"""Exact top-k inner-product search by MaxScore over shards.

Vectors become integers (``floor(1024 * x)``), so scores are exact. A dimension is a term: over a block of candidates its
posting list holds the vectors on the favourable side of the block's median, and its score bound is the best contribution in the
block. The terms of a query are ordered by bound. The lowest are non-essential while their summed bounds, on top of the
most that absence from all postings allows, stay below the query's current k-th score; only the postings of the essential
terms are traversed. Found candidates are probed for the other terms, the highest bound first, while the rest of the bounds can
still lift them to the k-th score. Survivors have their whole score.

Candidates are packed into blocks and dealt to shards of bounded size; queries are packed into blocks as well, and each block goes to
every shard, by the shuffle. A task holds one shard at a time and reads the query blocks one after the other; the k best of each
query and shard are merged by key. No query passes through the driver, and nothing is broadcast.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate; missing
dimensions of a shorter vector count as 0; very long vectors make smaller shards; a repeated row is a candidate of its own except for
queries of its own id; rows without an id take no part; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

SCALE = 1024
#: Queries of a block, candidates of a block, and numbers of the vectors of a shard.
QUERY_BLOCK, CANDIDATES, SHARD = 1024, 4096, 1 << 23


def whole(embedding: Column) -> Column:
    """The vector in integers, null if it can't take part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


class Block:
    """A block of candidates with the postings of each dimension and sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.high, self.low = self.vectors.max(axis=0), self.vectors.min(axis=0)
        self.middle = np.floor(np.median(self.vectors, axis=0)).astype(np.int64)
        self.over = [np.flatnonzero(self.vectors[:, d] > m) for d, m in enumerate(self.middle)]
        self.under = [np.flatnonzero(self.vectors[:, d] < m) for d, m in enumerate(self.middle)]

    def search(self, own: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and this block."""
        terms = np.flatnonzero(q)
        up = q[terms] > 0
        # What a term adds over a vector at the median: positive for members of its posting list, at most ``bound``.
        base = int(q @ self.middle)
        bound = np.abs(q[terms]) * np.where(up, self.high[terms] - self.middle[terms], self.middle[terms] - self.low[terms])
        order = np.argsort(bound, kind="stable")
        terms, bound = terms[order], bound[order]
        least = -best[-1][0] if len(best) == k else None
        rest = np.concatenate([[0], np.cumsum(bound)])
        essential = 0 if least is None else int(np.searchsorted(rest[1:] + base, least, side="left"))
        if essential == len(terms) and len(terms) and least is not None:
            return best
        limit = np.full(len(self.ids), base, np.int64)
        if len(terms):
            seen = np.zeros(len(self.ids), bool) if essential else np.ones(len(self.ids), bool)
            for t in terms[essential:].tolist():
                members = self.over[t] if q[t] > 0 else self.under[t]
                limit[members] += q[t] * (self.vectors[members, t] - self.middle[t])
                seen[members] = True
            alive = np.flatnonzero(seen)
        else:
            alive = np.arange(len(self.ids))
        limit = limit[alive]
        for n in range(essential - 1, -1, -1):
            if least is not None:
                stay = limit + rest[n + 1] >= least
                alive, limit = alive[stay], limit[stay]
            if not len(alive):
                return best
            t = terms[n]
            limit = limit + np.maximum(0, q[t] * (self.vectors[alive, t] - self.middle[t]))
        if least is not None:
            alive = alive[limit >= least]
        alive = alive[self.ids[alive] != own]
        scores = self.vectors[alive] @ q
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[scores >= edge], scores[scores >= edge]
        found = sorted([*best, *zip((-scores).tolist(), self.ids[alive].tolist(), strict=True)])
        return found[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller id."""
    scratch = Scratch(vectors.sparkSession, "maxscore")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = scratch.save(usable.filter("v is not null and vec_id is not null"))
    count, width = usable.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # As many as memory needs, and enough to keep the cores busy as long as each has a block of candidates.
    shards = max(1, -(-count * width // SHARD), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-count // CANDIDATES)))

    def packed(rows: DataFrame, most: int) -> DataFrame:
        """(ids, v) of up to so many rows in one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    part = batch.slice(at, most)
                    column = part.column("v")
                    lengths = pc.list_value_length(column).to_numpy()
                    full = np.zeros((len(lengths), width), np.int64)
                    full[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                    ids = np.ascontiguousarray(part.column("vec_id").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary())], ["ids", "v"])

        return rows.select("vec_id", "v").mapInArrow(run, "ids binary, v binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for shard, asks, ids, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "ids", "v")), strict=True):
                if shard != now:
                    now, blocks = shard, []
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(v, np.int64).reshape(len(ids), width)
                if not asks:
                    blocks.append(Block(ids, v))
                    continue
                rows = []
                for own, q in zip(ids.tolist(), v, strict=True):
                    best: list[tuple[int, int]] = []
                    for block in blocks:
                        best = block.search(own, q, k, best)
                    rows += [(own, i, -s) for s, i in best]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    dealt = packed(usable, CANDIDATES).select(F.pmod(F.xxhash64("ids"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "ids", "v")
    asked = packed(usable.filter("asks").select("vec_id", "v").distinct(), QUERY_BLOCK)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "ids", "v")
    met = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
