"""SimHash near-duplicates by generalised pigeonhole search.

Every text gets a 64-bit fingerprint (majority vote over hashed word shingles). Texts are linked when their fingerprints
differ in few bits. For the search, correlated bits are put into the same part of the fingerprint, each part gets its own
threshold (possibly none) by dynamic programming over estimated candidate counts, and the parts are probed by equi-joins.
By the generalised pigeonhole principle thresholds ``t_i`` find every pair within ``radius`` bits if
``sum(t_i + 1) = radius + 1``; the join verifies the whole fingerprint, so results are exact.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any others; very long texts are read whole, in
blocks; equal fingerprints are one node of the search; repeated rows (even of one id) are rows of their own; an empty table gives
an empty result; other columns are ignored by ``near_duplicates`` and pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch, connected_components, free_name, slices

SEED = 42
#: Shingles hashed at a time, so that a very long text takes bounded memory.
BLOCK = 1 << 16
#: Fingerprints that the cost estimates are drawn from (results do not depend on them).
SAMPLE = 4096
#: Relative cost of one probe row (made, shuffled, sorted) and of one candidate comparison.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02
#: Rows of a bucket whose pairs are all links, rows of a bucket that a task holds before the bucket is salted, probes compared at a time.
CROWDED, BUCKET, PROBED = 32, 2000, 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts, ends = (stops - lengths)[: len(words) - shingle + 1].tolist(), stops[shingle - 1 :].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        if n:
            a, b = np.indices((64, 64))
            yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "c": both.ravel().astype(np.int64), "n": n})

    rows = fps.mapInPandas(run, "a int, b int, c bigint, n bigint").groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # 4,096 rows whatever the input
    both = np.zeros((64, 64))
    for r in rows:
        both[r["a"], r["b"]] = r["c"]
    return (rows[0]["n"] if rows else 0), both


def correlated_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the 64 bits into parts of nearly equal size, strongly correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / spread)
    np.fill_diagonal(near, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        part = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < size:
            best = max(sorted(free), key=lambda b: near[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def plan(sample: np.ndarray, n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Parts of bits and their thresholds, at the least estimated cost over all numbers of parts.

    For each part the share of pairs within ``t`` bits is estimated from the sample (from independent bits where the
    sample has no such pair); the dynamic programme spends ``radius + 1`` units, ``t + 1`` for threshold ``t``.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best_cost, best = math.inf, []
    for count in range(1, radius + 2):
        parts = correlated_parts(both, n, count)
        costs = []
        for bits in parts:
            mask = np.uint64(sum(1 << b for b in bits))
            within = np.zeros(radius + 1)
            part, pairs = sample & mask, max(1, len(sample) * (len(sample) - 1))
            for k in range(0, len(part), 256):
                d = np.bitwise_count(part[k : k + 256, None] ^ part[None, :])
                within += [(d <= t).sum() for t in range(radius + 1)]
            share = np.maximum(0, within - len(sample)) / pairs
            law = np.array([1.0] + [0.0] * radius)
            for b in bits:
                law = law * (1 - differ[b]) + np.concatenate([[0.0], law[:-1]]) * differ[b]
            share = np.maximum(share, np.cumsum(law))
            probes = np.cumsum([math.comb(len(bits), t) for t in range(radius + 1)])
            costs.append([0.0] + [PROBE_COST * (1 + probes[t]) + CANDIDATE_COST * n * share[t] for t in range(radius + 1)])
        table = {0: (0.0, [])}
        for cost in costs:
            table = {spent: min((table[was][0] + cost[spent - was], [*table[was][1], spent - was - 1]) for was in table if 0 <= spent - was <= radius + 1) for spent in range(radius + 2)}
        cost, thresholds = table[radius + 1]
        if cost < best_cost:
            best_cost, best = cost, [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]
    return best


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(unique: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (hi, lo) of different fingerprints that keep together what is within ``radius`` bits; ``unique(fp)`` holds distinct ones.

    Rows that share a part exactly meet once by an ordered self-join of the index; thresholds above 0 add probes with changed bits. A
    bucket of up to ``CROWDED`` rows gives all its pairs within the radius. A larger one would give their square: there every
    probe is compared with every row, but each block of them gives one link for each member of the components that it holds, to
    the smallest, so links grow with the fingerprints. Buckets of more than ``BUCKET`` rows are dealt out over salts, with their probes.
    """
    n, both = bit_counts(unique)
    sample = unique.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    index, probe = [], []
    for k, (bits, threshold) in enumerate(plan(sample, n, both, radius)):
        mask = F.lit(signed(sum(1 << b for b in bits)))
        at = F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(mask).alias("v"))
        index.append(at)
        flips = [0]
        for _ in range(threshold):
            flips = sorted({f ^ (1 << b) for f in flips for b in bits} | set(flips))
        own = F.col("fp").bitwiseAND(mask)
        probe.append(F.array(*[F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(signed(f))).alias("v")) for f in flips]))
    rows = unique.select("fp", F.explode(F.array(*index)).alias("k")).select("fp", "k.part", "k.v")
    crowded = rows.groupBy("part", "v").count().filter(F.col("count") > CROWDED).select("part", "v", F.ceil(F.col("count") / BUCKET).cast("int").alias("salts"))
    rows = rows.join(crowded, ["part", "v"], "left")
    asks = unique.select("fp", F.explode(F.concat(*probe)).alias("k")).select("fp", "k.part", "k.v").join(crowded, ["part", "v"], "left")

    few = rows.filter("salts is null").select("part", "v", F.col("fp").alias("a")).join(asks.filter("salts is null").select("part", "v", F.col("fp").alias("b")), ["part", "v"])
    near = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    few = few.filter(near).select(F.col("a").alias("hi"), F.col("b").alias("lo"))

    dealt = rows.filter("salts is not null").select("part", "v", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("asks"), "fp")
    asked = asks.filter("salts is not null").select("part", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("asks"), "fp")
    met = dealt.unionByName(asked).repartition("part", "v", "salt").sortWithinPartitions("part", "v", "salt", "asks")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.int64)
        for batch in batches:
            part, v, salt, is_probe, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "v", "salt", "asks", "fp"))
            change = (part[1:] != part[:-1]) | (v[1:] != v[:-1]) | (salt[1:] != salt[:-1]) | (is_probe[1:] != is_probe[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (key := (part[a], v[a], salt[a])) != now:
                    now, held = key, np.zeros(0, np.int64)
                if not is_probe[a]:
                    held = np.concatenate([held, fp[a:b]])
                    continue
                for at in range(a, b, PROBED):
                    hi, lo = star_links(held, fp[at : min(b, at + PROBED)], radius)
                    if len(hi):
                        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])

    return few.unionByName(met.mapInArrow(stars, "hi bigint, lo bigint"))


def star_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the components that pairs of both sets within ``radius`` bits make: a link from each member to the smallest one."""
    near = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= radius
    a, b = np.nonzero(near)
    nodes, at = np.unique(np.concatenate([left[a], right[b]]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col))
    unique = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(links(unique.select("fp"), radius), scratch)
    placed = scratch.save(unique.join(roots, unique.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    component = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(component, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The documents without all but one of each component: the row with the smallest id, and of its texts that with the smallest
    XXH64, stays, once.

    Rows without an id can't be cited as a copy and stay.
    """
    copy, copy_row, of_row = (free_name(docs, x) for x in ("copy", "copy_row", "of_row"))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("row")))
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), radius).filter("doc_id is not null")
    copies = found.filter("component_id is null or doc_id <> component_id").select(F.col("doc_id.doc_id").alias(copy), F.col("doc_id.row").alias(copy_row))
    kept = docs.join(copies, (docs["doc_id"] == F.col(copy)) & (F.xxhash64(docs["text"]) == F.col(copy_row)), "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        once = kept.filter("doc_id is not null").withColumn(of_row, F.xxhash64("text")).dropDuplicates(["doc_id", of_row]).drop(of_row)
        kept = once.unionByName(kept.filter("doc_id is null"))
    return kept
