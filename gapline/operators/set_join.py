"""Set-similarity join: all pairs of documents whose token sets have a Jaccard similarity of at least a threshold, exact.

Equal sets are one class; only classes are compared, so copies make no pairs. A class's tokens are ordered from rare to frequent, as
counted by buckets of their hashes. Two sets of sizes m <= n with similarity t share at least ``t / (1 + t) (m + n)`` tokens, so the
first token that they share is among the first ``m - ceil(2 t / (1 + t) m) + 1`` of the smaller and the first ``n - ceil(t n) + 1`` of the
larger one. The sets are cut into blocks by size; a task holds the first tokens of a block's sets in an index and looks up those of the
sets that are as large or larger. A hit stays if the tokens behind it suffice for the overlap, and if the sets' sketches (parities of
tokens by hash) differ in no more bits than the sets may differ in tokens. Neither test loses a pair, also where hashes collide.

What is left is nearly the result. Only the sets in it are shuffled as text, once for each block that they were met in, and counted.
The shuffle before holds first tokens and sketches, a set once for each block of admissible sizes; blocks grow up to :data:`BLOCK`
tokens, then their number grows with the input. Hits grow with the square of the number of different sets that share a rare token.

Null ids and null or empty sets take no part; repeated ids with equal sets count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.sources.shared import new_folder, written

#: Buckets that tokens are counted in.
BUCKETS = 1 << 20
#: Tokens in the index of a block, at most, and at least where there are more blocks than one; tasks that share a block's probes.
BLOCK, LEAST_BLOCK, PARTS = 1 << 22, 1 << 14, 2
#: Bits of a sketch for each token of a block's largest set, and at most.
SKETCH, SKETCH_BITS = 4, 1 << 15
#: Tokens, and hits, that are looked at in one step.
TOKENS, HITS = 1 << 19, 1 << 20
#: Sets that are named to all tasks; more of them are joined by a shuffle.
NAMED = 1 << 19

SHIPPED = "task int, asks boolean, set_no long, n int, first binary, sketch binary"


def distinct(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))


def classes(docs: DataFrame, tokens: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """``sets(key, n, class_id, seen, set_no)``, one row for each distinct set, and ``members(id, class_id)``; a class is named by its smallest id.

    ``seen`` is a hash of the tokens in the order of the row that names the class: it tells this row from others of the same id.
    """
    rows = docs.filter("id is not null").select("id", distinct(tokens).alias("tokens"))
    # An empty set has a key too.
    rows = rows.select("id", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("seen"), F.unhex(F.sha2(F.concat_ws("\0", F.sort_array("tokens")), 256)).alias("key"))
    named = rows.groupBy("key", "n").agg(F.min(F.struct("id", "seen")).alias("first")).filter("n > 0")
    sets = written(named.select("key", "n", F.col("first.id").alias("class_id"), "first.seen", F.monotonically_increasing_id().alias("set_no")), f"{folder}/sets")
    members = rows.select("id", "key").distinct().join(sets.select("key", "class_id"), "key").select("id", "class_id")
    return sets, members


def own_rows(docs: DataFrame, tokens: Column, sets: DataFrame) -> DataFrame:
    """``sets`` with the tokens of the rows that they are named by; null tokens where an id has other sets too, and a row for each repeated one."""
    named = sets.select(F.col("class_id").alias("set_join_id"), F.struct(*sets.columns).alias("set_join_own"))
    few = sets.count() <= NAMED
    # Broadcast, a text is taken apart after the join; else the shuffle holds tokens, not texts.
    rows = docs if few else docs.select("id", distinct(tokens).alias("tokens"))
    met = rows.join(F.broadcast(named) if few else named, F.col("id") == F.col("set_join_id"))
    met = met.select("set_join_own.*", distinct(tokens).alias("tokens")) if few else met.select("set_join_own.*", "tokens")
    # No filter, as it would take the texts apart once more.
    return met.withColumn("tokens", F.when(F.xxhash64("tokens") == F.col("seen"), F.col("tokens")))


def least(x):
    # A hair below the bound, so that rounding never costs a pair; candidates are compared in full.
    return np.ceil(x - 1e-9).astype(np.int64)


def levels(docs: DataFrame, tokens: Column) -> np.ndarray:
    """Of each bucket, eight times the binary logarithm of its tokens' frequency."""
    hashes = F.transform(distinct(tokens), lambda x: F.xxhash64(x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    counted = docs.filter("id is not null").select(F.explode(hashes).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    found = counted.select("bucket", F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("int").alias("level")).toArrow()  # a bounded number of buckets
    out = np.zeros(BUCKETS, np.uint8)
    out[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    return out


def fraction(set_no: np.ndarray) -> np.ndarray:
    """Scattered numbers from 0 to 1."""
    return ((set_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)


@dataclass(frozen=True)
class Blocks:
    """Sets in order of their sizes, those of a size in order of :func:`fraction`, cut into blocks of equal numbers of first tokens."""

    threshold: float
    sizes: np.ndarray
    before: np.ndarray
    entries: np.ndarray
    count: int

    @classmethod
    def of(cls, sizes: np.ndarray, sets: np.ndarray, threshold: float, parallel: int) -> Blocks:
        entries = sets * cls.held(sizes, threshold)
        total = int(entries.sum())
        count = max(-(-total // BLOCK), min(parallel, -(-total // LEAST_BLOCK)), 1)
        return cls(threshold, sizes, np.cumsum(entries) - entries, entries, count)

    @staticmethod
    def held(n: np.ndarray, threshold: float) -> np.ndarray:
        """First tokens of a set that is the smaller one of a pair."""
        return n - least(2 * threshold / (1 + threshold) * n) + 1

    def asked(self, n: np.ndarray) -> np.ndarray:
        """First tokens of a set that is the larger one of a pair."""
        return n - least(self.threshold * n) + 1

    def at(self, place: np.ndarray) -> np.ndarray:
        return np.minimum(place / max(1, self.entries.sum()) * self.count, self.count - 1).astype(np.int64)

    def ranges(self, n: np.ndarray, set_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first block with sets that a set is compared with, and the last one, its own."""
        size = np.searchsorted(self.sizes, n)
        own = self.at(self.before[size] + fraction(set_no) * self.entries[size])
        return np.minimum(self.at(self.before[np.searchsorted(self.sizes, least(self.threshold * n))]), own), own

    def bits(self) -> np.ndarray:
        """Bits of the sketches of each block."""
        last = np.searchsorted(self.at(self.before), np.arange(self.count), "right") - 1
        return np.minimum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(64, SKETCH * self.sizes[last]))).astype(np.int64))


def sketches(hashes: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parities of the numbers of tokens of each row by hash."""
    flat = row * bits + ((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(flat, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits), axis=1)


def steps(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to a limit at most, or of a single one."""
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + limit, "right")))
        yield begin, end
        begin = end


def shipped(own: DataFrame, level: np.ndarray, blocks: Blocks) -> DataFrame:
    """First tokens and sketches of each set: for the index of its own block, and as a probe for all blocks of admissible sizes."""
    bits = blocks.bits()

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("hashes")))
            for begin, end in steps(pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False), TOKENS):
                yield from pieces(batch.slice(begin, end - begin))

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, no = batch.column("n").to_numpy().astype(np.int64), batch.column("set_no").to_numpy()
        hashes = batch.column("hashes").flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        first = level[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint32) << np.uint32(24) | (hashes >> np.uint64(40)).astype(np.uint32)
        first = first[np.lexsort((first, row))]
        start = np.cumsum(n) - n
        low, high = blocks.ranges(n, no)
        held, asked = Blocks.held(n, blocks.threshold), blocks.asked(n)
        for block in range(int(low.min()), int(high.max()) + 1):
            some = np.flatnonzero((low <= block) & (block <= high))
            width, step = int(bits[block]), max(1, (TOKENS * 8) // int(bits[block]))
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                place = np.full(len(n), -1)
                place[rows] = np.arange(len(rows))
                mine = place[row] >= 0
                made = sketches(hashes[mine], place[row[mine]], len(rows), width)
                out: list[tuple] = []
                for r, sketch in zip(rows.tolist(), made, strict=True):
                    sketch, s = sketch.tobytes(), start[r]
                    out.append((block * PARTS + int(no[r]) % PARTS, True, no[r], n[r], first[s : s + asked[r]].tobytes(), sketch))
                    if high[r] == block:
                        out += [(block * PARTS + q, False, no[r], n[r], first[s : s + held[r]].tobytes(), sketch) for q in range(PARTS)]
                if out:
                    types = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["task", "asks", "set_no", "n", "first", "sketch"])

    return own.mapInArrow(ship, SHIPPED)


class Rows:
    """First tokens of sets as flat arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]
        no = whole.column("set_no").to_numpy()
        self.no, self.n, self.scattered = no, whole.column("n").to_numpy().astype(np.int64), fraction(no)
        size = pc.binary_length(whole.column("first")).to_numpy().astype(np.int64) // 4
        self.first = np.frombuffer(b"".join(whole.column("first").to_pylist()), np.uint32).astype(np.uint64)
        self.row = np.repeat(np.arange(len(no), dtype=np.int32), size)
        self.place = (np.arange(len(self.first)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(len(no), -1)


class Held:
    """An index of a block's sets, by token and size."""

    def __init__(self, rows: Rows, threshold: float):
        self.rows, self.threshold = rows, threshold
        key = rows.first << np.uint64(32) | rows.n[rows.row].astype(np.uint64)
        order = np.argsort(key)
        self.key, self.row, self.place = key[order], rows.row[order], rows.place[order]
        del rows.first, rows.row, rows.place

    def meet(self, asked: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index and of ``asked`` that may be similar, each pair once."""
        token, n = asked.first << np.uint64(32), asked.n[asked.row]
        order = np.argsort(token)  # searches in order of tokens stay in the cache
        low, count = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        low[order] = np.searchsorted(self.key, (token | least(self.threshold * n).astype(np.uint64))[order])
        count[order] = np.searchsorted(self.key, (token | n.astype(np.uint64))[order], "right")
        count -= low
        codes = [np.zeros(0, np.int64)]
        for begin, end in steps(count, HITS):
            some = count[begin:end]
            which = np.repeat(np.arange(begin, end), some)
            at = np.arange(len(which)) + np.repeat(low[begin:end] - (np.cumsum(some) - some), some)
            codes.append(self.kept(self.row[at], self.place[at], asked, asked.row[which], asked.place[which]))
        code = np.unique(np.concatenate(codes))
        return code % len(self.rows.no), code // len(self.rows.no)

    def kept(self, a: np.ndarray, a_at: np.ndarray, asked: Rows, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        held, share = self.rows, self.threshold / (1 + self.threshold)
        m, n = held.n[a], asked.n[b]
        fine = np.minimum(m - a_at, n - b_at) >= share * (m + n) - 1e-9
        code = np.unique(b[fine].astype(np.int64) * len(held.no) + a[fine])
        a, b = code % len(held.no), code // len(held.no)
        m, n, x, y = held.n[a], asked.n[b], held.scattered[a], asked.scattered[b]
        before = (m < n) | (m == n) & ((x < y) | (x == y) & (held.no[a] < asked.no[b]))
        code, a, b = code[before], a[before], b[before]
        may = held.n[a] + asked.n[b] - 2 * least(share * (held.n[a] + asked.n[b]))
        step = max(1, HITS // held.sketch.shape[1])
        near = [np.bitwise_count(held.sketch[a[i : i + step]] ^ asked.sketch[b[i : i + step]]).sum(axis=1, dtype=np.int64) <= may[i : i + step] for i in range(0, len(a), step)]
        return code[np.concatenate(near)] if near else code


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows that agree in some columns."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
    cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cut, cut[1:], strict=False):
        if end > begin:
            yield tuple(c[begin].item() for c in columns), batch.slice(begin, end - begin)


def candidates(sent: DataFrame, blocks: Blocks) -> DataFrame:
    """block, a_no, b_no: each pair once."""
    threshold = blocks.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, side, rows, held, last = None, None, [], None, -1
        for batch in batches:
            for (now, asks), part in runs(batch, "task", "asks"):
                if now != task:
                    task, side, rows, held = now, None, [], None
                if asks != side:
                    side, last = asks, -1
                no = part.column("set_no").to_numpy()
                # Rows come in order of their numbers; a repeated id repeats its number.
                part, last = part.filter(pa.array(np.concatenate([[no[0] != last], no[1:] != no[:-1]]))), no[-1]
                if not asks:
                    rows.append(part)
                    continue
                if not rows and not held:
                    continue
                held = held or Held(Rows(rows), threshold)
                rows.clear()
                for begin, end in steps(pc.binary_length(part.column("first")).to_numpy(zero_copy_only=False) // 4, TOKENS):
                    asked = Rows([part.slice(begin, end - begin)])
                    a, b = held.meet(asked)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), now // PARTS, np.int32)), pa.array(held.rows.no[a]), pa.array(asked.no[b])], ["block", "a_no", "b_no"])

    dealt = sent.repartitionById(blocks.count * PARTS, F.col("task")).sortWithinPartitions("task", "asks", "set_no")
    return dealt.mapInArrow(run, "block int, a_no long, b_no long")


class Texts:
    """Token sets of a block as numbers, with their names."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        no = table.column("a_no").to_numpy()
        fresh = np.concatenate([[True], no[1:] != no[:-1]])
        table, self.no = table.filter(pa.array(fresh)), no[fresh]
        tokens = table.column("tokens").combine_chunks()
        self.name = table.column("name").combine_chunks()
        self.size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = tokens.flatten().dictionary_encode()
        self.token = flat.indices.to_numpy()
        self.mark = np.zeros(len(flat.dictionary), np.int64)

    def overlaps(self, a: np.ndarray, b: int) -> np.ndarray:
        """Tokens that each set of ``a`` shares with the set ``b``."""
        own = self.token[self.start[b] : self.start[b] + self.size[b]]
        self.mark[own] = 1
        size = self.size[a]
        begin = np.cumsum(size) - size
        shared = np.add.reduceat(self.mark[self.token[np.arange(size.sum()) + np.repeat(self.start[a] - begin, size)]], begin)
        self.mark[own] = 0
        return shared


def pair_type(docs: DataFrame) -> T.StructType:
    kind = docs.schema["id"].dataType
    return T.StructType([T.StructField("a_id", kind), T.StructField("b_id", kind), T.StructField("similarity", T.DoubleType())])


def compared(found: DataFrame, docs: DataFrame, tokens: Column, sets: DataFrame, threshold: float, blocks: Blocks) -> DataFrame:
    """a_id, b_id, similarity of the candidates that reach the threshold, by their tokens."""
    used = found.select("block", F.explode(F.array("a_no", "b_no")).alias("set_no")).distinct()
    kind = docs.schema["id"].dataType
    texts = own_rows(docs, tokens, used.join(sets, "set_no").select("block", "set_no", "class_id", "seen"))
    none = F.lit(None)
    texts = texts.select("block", F.lit(False).alias("asks"), F.col("set_no").alias("a_no"), none.cast("long").alias("b_no"), F.col("class_id").alias("name"), "tokens")
    pairs = found.select("block", F.lit(True).alias("asks"), "a_no", "b_no", none.cast(kind).alias("name"), none.cast("array<string>").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, texts = None, [], None
        for batch in batches:
            for (now, asks), part in runs(batch, "block", "asks"):
                if now != block:
                    block, held, texts = now, [], None
                if not asks:
                    held.append(part.select(["a_no", "name", "tokens"]).filter(pc.is_valid(part.column("tokens"))))
                    continue
                texts = texts or Texts(held)
                a, b = (np.searchsorted(texts.no, part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) for c in ("a_no", "b_no"))
                cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
                shared = np.concatenate([texts.overlaps(a[i:j], int(b[i])) for i, j in zip(cut, cut[1:], strict=False)])
                similarity = shared / (texts.size[a] + texts.size[b] - shared)
                fine = similarity >= threshold
                names = [texts.name.take(pa.array(side[fine])) for side in (a, b)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(similarity[fine])], ["a_id", "b_id", "similarity"])

    out = texts.unionByName(pairs).repartitionById(blocks.count, F.col("block")).sortWithinPartitions("block", "asks", F.coalesce("b_no", "a_no")).mapInArrow(run, pair_type(docs))
    return out.filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "similarity")


def similar_pairs(docs: DataFrame, tokens: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``pairs(a_id, b_id, similarity)`` between classes of equal sets, a_id < b_id, and ``members(id, class_id)``, from ``docs(id, ...)``."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    spark = docs.sparkSession
    folder = new_folder(spark, "set-join")
    sets, members = classes(docs, tokens, folder)
    # As many rows as there are sizes of sets, fewer than the root of twice the tokens.
    sizes = sets.groupBy("n").agg(F.count("*").alias("sets")).orderBy("n").collect()
    blocks = Blocks.of(np.array([r["n"] for r in sizes], np.int64), np.array([r["sets"] for r in sizes], np.int64), threshold, spark.sparkContext.defaultParallelism)
    if not sizes:
        return spark.createDataFrame([], pair_type(docs)), members
    own = own_rows(docs, tokens, sets.select("set_no", "n", "class_id", "seen")).select("set_no", "n", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    found = written(candidates(shipped(own, levels(docs, tokens), blocks), blocks), f"{folder}/found")
    return compared(found, docs, tokens, sets, threshold, blocks), members
