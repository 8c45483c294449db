"""Fuzzy line de-duplication: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

1. Lines are split, trimmed, lower-cased and hashed (96 bits of XXH3) on Arrow batches of texts; equal ones are counted together
   (map-side first, so a line that stands in a third of all documents is one row for each task).
2. Each distinct line gets a signature of ``BANDS * ROWS`` minima over its 8-character shingles, from three hash functions whose
   range is cut into bins (one-permutation hashing, empty bins borrow along fixed permutations). Six minima make a band; lines
   with Jaccard similarity 0.8 share a band with probability 0.998. A task signs a line that it meets again only after many others.
3. Band values travel as packed arrays, one row for each batch and part; lines that share a band value form a group. Band values
   that a bounded sample shows to be frequent are dealt into blocks of about ``BLOCK`` lines, each of which also gets one line of the
   sample (the pivot), so that no task gets an unbounded group and a family of lines is linked over all of its blocks.
4. Groups with the same smallest line are verified together: the shingles of a line are made once for all of them, and lines that
   are linked already are not compared again. The search is breadth first, so a dense group takes few comparisons and yields a
   spanning forest, never all pairs.
5. Lines of a frequent band value outside its largest component are compared with all lines of that value, block by block: two
   lines that share a band value are compared unless they are linked already.
6. Union-find over the links; the component's first line (smallest doc_id, then line number; no id is last) is kept.

Defined cases: null text stays null; blank lines are neither counted nor dropped; lines shorter than a shingle are one shingle;
very long texts and lines are read whole; rows that agree in id and text share one fate; a document may lose all its lines and then
has an empty text; an empty table gives an empty result; other columns pass through ``drop_lines`` whatever their names (``n_chars``,
if there, is counted anew; with ``counts`` the new columns take the place of columns of their names). Lines are told apart by 96-bit
hashes: among 10^12 distinct lines the chance of one confusion is below 10^-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gapline.llm.common import Scratch, connected_components, free_name, slices

SHINGLE, FUNCTIONS, BANDS, ROWS = 8, 3, 20, 6
BINS = BANDS * ROWS // FUNCTIONS
SIMILAR = 0.8
#: Characters hashed together; lines of one block that a task compares; lines sampled to find frequent band values.
TOGETHER, BLOCK, SAMPLE = 1 << 18, 500, 100_000
#: Bits by which most lines that aren't similar are told apart before their shingles are compared.
BITS = 1024
#: Lines of a group of which all pairs are looked at by their bits.
FEW = 128
#: Band values that a task packs together and that a part gets; parts are matched one at a time, whatever their number.
PACK, PART, MOST_TASKS = 1 << 19, 250_000, 20_000
#: Lines that a task remembers as signed; lines that stand oftener than one in so many places are joined by a broadcast.
REMEMBERED, HEAVY = 1 << 16, 2000
#: Distinct lines in groups up to which their keys are broadcast (12 bytes each).
BROADCAST_KEYS = 2_000_000

_rng = np.random.default_rng(20_240_131)
_MULTIPLY = _rng.integers(1 << 62, 1 << 63, FUNCTIONS + BANDS * ROWS + 2, dtype=np.uint64) | np.uint64(1)
_BORROW = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_U = np.uint64
_TOP = np.iinfo(np.uint64).max


def normal(line: str) -> str:
    """What is compared of a line; empty for a blank one."""
    return line.strip().lower()


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines, one after the other, and their number in each line."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    h, k, power = codes, 1, _MULTIPLY[:1]
    while k < SHINGLE:  # a polynomial of k characters and its neighbour make one of 2 k
        h, k, power = h[:-k] * power + h[k:], 2 * k, power * power
    h ^= h >> _U(31)
    h *= _MULTIPLY[1]
    inside = np.ones(len(h), bool)
    ends = np.cumsum(lengths)[:-1]
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return h[inside], lengths - SHINGLE + 1


def bands(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) band values."""
    h, counts = shingles(lines)
    owner = np.repeat(np.arange(len(lines)) * BINS, counts)
    h ^= h >> _U(29)
    rows = []
    for f in range(FUNCTIONS):
        g = h * _MULTIPLY[2 + f]
        g ^= g >> _U(32)
        at = g & _U(0xFFFFFFFF)
        at *= _U(BINS)
        at >>= _U(32)
        at = at.view(np.int64)
        at += owner
        least = np.full(len(lines) * BINS, _TOP, _U)
        np.minimum.at(least, at, g)
        least = least.reshape(-1, BINS)
        line, bin_ = np.nonzero(least == _TOP)
        filled = least.copy()
        for step in range(BINS):
            if not len(line):
                break
            borrowed = least[line, _BORROW[bin_, step]]
            filled[line, bin_] = borrowed
            still = borrowed == _TOP
            line, bin_ = line[still], bin_[still]
        rows += [filled[:, k * BANDS : (k + 1) * BANDS] for k in range(BINS // BANDS)]
    out = np.zeros((len(lines), BANDS), _U) + np.arange(BANDS, dtype=_U)
    for k, values in enumerate(rows):
        out = (out ^ values) * _MULTIPLY[2 + FUNCTIONS + k]
        out ^= out >> _U(29)
    return out


def bitmaps(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each set of shingles ``BITS`` bits, those of its shingles are set."""
    out = []
    for at in range(0, len(sets), 2048):
        n = sizes[at : at + 2048]
        marks = np.zeros(len(n) * BITS, bool)
        marks[np.repeat(np.arange(len(n)) * BITS, n) + (np.concatenate(sets[at : at + 2048]) % _U(BITS)).astype(np.int64)] = True
        out.append(np.packbits(marks).view(_U).reshape(len(n), -1))
    return np.concatenate(out)


class Forest:
    """Links between lines by exact Jaccard similarity of their shingles, found group by group."""

    def __init__(self, sets: list[np.ndarray], similar: float):
        self.sets, self.similar = sets, similar
        self.sizes = np.array([len(s) for s in sets])
        self.bits = bitmaps(sets, self.sizes)
        self.only_one = (1 - similar) / (1 + similar)  # of the shingles of two similar lines, those that only one has are no more
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.failed: set[tuple[int, int]] = set()

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def near(self, own: int, others: np.ndarray) -> list[int]:
        """Which of the others are similar enough."""
        small, large = np.minimum(self.sizes[others], self.sizes[own]), np.maximum(self.sizes[others], self.sizes[own])
        others = others[small >= self.similar * large - 1e-9]
        # Bits that differ are at most the shingles that only one of two lines has, so this leaves out no similar line.
        apart = np.bitwise_count(self.bits[others] ^ self.bits[own]).sum(axis=1, dtype=np.int64)
        others = others[apart <= (self.sizes[others] + self.sizes[own]) * self.only_one + 1e-9]
        if not len(others):
            return []
        every = np.concatenate([self.sets[k] for k in others]) if len(others) > 1 else self.sets[others[0]]
        spot = np.searchsorted(self.sets[own], every)
        spot[spot == self.sizes[own]] = 0
        sizes = self.sizes[others]
        shared = np.add.reduceat(self.sets[own][spot] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
        return others[shared >= self.similar * (sizes + self.sizes[own] - shared) - 1e-9].tolist()

    def possible(self, members: np.ndarray) -> list[list[int]]:
        """Pairs of a few lines whose bits allow that they are similar."""
        bits, sizes = self.bits[members], self.sizes[members]
        one, two = np.triu_indices(len(members), 1)
        apart = np.bitwise_count(bits[one] ^ bits[two]).sum(axis=1, dtype=np.int64)
        near = apart <= (sizes[one] + sizes[two]) * self.only_one + 1e-9
        return np.stack([members[one[near]], members[two[near]]], axis=1).tolist()

    def link(self, a: int, b: int) -> None:
        self.links.append((a, b))
        self.parent[self.root(b)] = self.root(a)

    def compare(self, a: int, b: int) -> None:
        """Link two lines, if they are similar and not linked."""
        if (a, b) in self.failed or self.root(a) == self.root(b):
            return
        one, two = self.sets[a], self.sets[b]
        if len(one) > len(two):
            one, two = two, one
        if len(one) >= self.similar * len(two) - 1e-9:
            spot = two.searchsorted(one)
            shared = np.count_nonzero(two.take(spot, mode="clip") == one)
            if shared >= self.similar * (len(one) + len(two) - shared) - 1e-9:
                self.link(a, b)
                return
        self.failed.add((a, b))

    def search(self, members: list[int]) -> None:
        """Link the lines of one group: breadth first, without comparing what is linked."""
        if len(members) == 2:
            self.compare(*members)
            return
        if len(members) <= FEW:
            for a, b in self.possible(np.array(members)):
                self.compare(a, b)
            return
        open_ = np.array(members)
        while len(open_) > 1:
            queue, open_ = [int(open_[0])], open_[1:]
            while queue and len(open_):
                own = queue.pop()
                linked = np.array([self.root(k) == self.root(own) for k in open_.tolist()])
                queue += open_[linked].tolist()
                open_ = open_[~linked]
                found = self.near(own, open_) if len(open_) else []
                for k in found:
                    self.link(own, k)
                if found:
                    queue += found
                    open_ = np.setdiff1d(open_, found, assume_unique=True)


def distinct(h: np.ndarray) -> np.ndarray:
    """Like numpy's ``unique``, which is several times slower on so few values."""
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def forest(lines: list[str], similar: float = SIMILAR) -> Forest:
    h, counts = shingles(lines)
    cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return Forest([distinct(h[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], similar)


def keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """k and k2, the key of a line, from the digests of lines."""
    both = np.frombuffer(b"".join(digests), np.dtype([("k", np.int64), ("k2", np.int32), ("rest", np.int32)]))
    return both["k"].copy(), both["k2"].copy()


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def split(text: bytes | None) -> list[str]:
    """The lines of a text; bytes that are no UTF-8 are replaced, as Spark does."""
    return [] if text is None else text.decode("utf-8", "replace").split("\n")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, k, k2) of every line that isn't blank; ``row`` is the XXH64 of the text, k and k2 are the line's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, numbers, counts = [], [], []
            for text in batch.column("text").to_pylist():
                before = len(digests)
                for n, raw in enumerate(split(text)):
                    if line := normal(raw):
                        digests.append(digest(line))
                        numbers.append(n)
                counts.append(len(digests) - before)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(numbers, pa.int32()), *map(pa.array, keys(digests))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "line", "k", "k2"])

    rest = (("row", LongType()), ("line", IntegerType()), ("k", LongType()), ("k2", IntegerType()))
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(*x) for x in rest)])
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def distinct_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(k, k2, line) of texts in bounded batches; a line comes again only after ``REMEMBERED`` others."""
    seen: set[bytes] = set()
    found: list[bytes] = []
    lines: list[str] = []
    size = 0
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            for raw in split(text):
                if not (line := normal(raw)) or (key := digest(line)) in seen:
                    continue
                seen.add(key)
                found.append(key)
                lines.append(line)
                size += len(line)
                if size >= TOGETHER:
                    yield *keys(found), lines
                    found, lines, size = [], [], 0
                    if len(seen) >= REMEMBERED:
                        seen.clear()
    if found:
        yield *keys(found), lines


def only_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def together(h: np.ndarray, k: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows whose value h stands at more than one line, in order; where the values start and how many rows each has."""
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    more = np.flatnonzero(np.append(same, False) | np.append(False, same))
    h, k, k2 = h[more], k[order[more]], k2[order[more]]
    order = np.lexsort((k2, k, h))
    h, k, k2 = h[order], k[order], k2[order]
    new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))[: len(h)]
    h, k, k2 = h[new], k[new], k2[new]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h, k, k2, starts, np.diff(np.append(starts, len(h)))


Hot = dict[int, tuple[int, int, int]]


def frequent_bands(docs: DataFrame, count: int) -> Hot:
    """Band values expected on more than ``BLOCK`` distinct lines: blocks that they are dealt into and a line (k, k2) of each.

    Estimated from the lines of some documents, chosen by a hash of the text, about ``SAMPLE``; it only spreads the load, results do
    not depend on it.
    """
    rate = min(1.0, SAMPLE / max(count, 1))
    some = docs.filter(F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    least = max(3, rate * BLOCK)
    parts = max(1, -(-min(count, SAMPLE) * BANDS // PART))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, k2, texts in distinct_batches(batches):
            h, k, k2 = bands(texts).ravel(), np.repeat(k, BANDS), np.repeat(k2, BANDS)
            dealt = (h >> _U(32)) % _U(parts)
            at = [np.flatnonzero(dealt == p) for p in range(parts)]
            packed = [pa.array([a[x].tobytes() for x in at], pa.binary()) for a in (h.view(np.int64), k, k2)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *packed], ["part", "h", "k", "k2"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("h", "k", "k2")), strict=True)]
        if held:
            h, k, k2, starts, sizes = together(*(np.concatenate([np.frombuffer(x[j], t) for x in held]) for j, t in enumerate((np.int64, np.int64, np.int32))))
            many = sizes > least
            columns = [h[starts[many]], sizes[many], k[starts[many]], k2[starts[many]]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h", "n", "k", "k2"])

    signed = only_texts(some).mapInArrow(sign, "part int, h binary, k binary, k2 binary")
    found = signed.repartition(parts, "part").mapInArrow(common, "h bigint, n bigint, k bigint, k2 int")
    return {r["h"]: (int(np.ceil(r["n"] / rate / BLOCK)), r["k"], r["k2"]) for r in found.collect()}  # fewer than SAMPLE * BANDS / 3


MEMBERS = "run bigint, grp bigint, k bigint, k2 int, value bigint, block int"


def members(docs: DataFrame, count: int) -> DataFrame:
    """(run, grp, k, k2, value, block): lines that share a band value, with the run that verifies the group.

    Groups of frequent values are their blocks; ``value`` and ``block`` are null for others.
    """
    hot = frequent_bands(docs, count)
    parts = max(1, -(-count * BANDS // PART))
    frequent = np.array(sorted(hot), np.int64)

    def name(*what: int) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(repr(what).encode())).view(np.int64))

    def packed(h: np.ndarray, k: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
        rows = []
        if hot:
            spot = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
            dealt: dict[tuple[int, int], list[int]] = {}
            for j in np.flatnonzero(spot).tolist():
                n = hot[int(h[j])][0]
                dealt.setdefault((int(h[j]), (int(k[j]) * 0x9E3779B1 >> 11) % n), []).append(j)
            rows = [((name(v, b) >> 3) % parts, v, b, None, k[js].tobytes(), k2[js].tobytes()) for (v, b), js in dealt.items()]
            h, k, k2 = h[~spot], k[~spot], k2[~spot]
        part = ((h.view(_U) >> _U(32)) % _U(parts)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        h, k, k2, part = h[order].astype(np.uint32), k[order], k2[order], part[order]
        full, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], len(h))
        rows += [(p, None, None, h[a:b].tobytes(), k[a:b].tobytes(), k2[a:b].tobytes()) for p, a, b in zip(full.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "value", "block", "h", "k", "k2"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for k, k2, texts in distinct_batches(batches):
            held.append((bands(texts).view(np.int64).ravel(), np.repeat(k, BANDS), np.repeat(k2, BANDS)))
            size += len(k) * BANDS
            if size >= PACK:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def grouped(h: np.ndarray, k: np.ndarray, k2: np.ndarray, value: int | None, block: int | None) -> Iterator[pa.RecordBatch]:
        h, k, k2, starts, sizes = together(h, k, k2)
        more = sizes > 1
        if not more.any():
            return
        held = np.repeat(more, sizes)
        grp = [xxhash.xxh64_intdigest(k[a : a + n].tobytes()) for a, n in zip(starts[more].tolist(), sizes[more].tolist(), strict=True)]
        run = k[starts[more]] if value is None else np.array([name(value, block)], np.int64)
        n = int(held.sum())
        columns = [np.repeat(run, sizes[more]), np.repeat(np.array(grp, _U).view(np.int64), sizes[more]), k[held], k2[held]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([value] * n, pa.int64()), pa.array([block] * n, pa.int32())], ["run", "grp", "k", "k2", "value", "block"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(now: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            _, value, block = now
            k, k2 = (np.concatenate([np.frombuffer(x[j], t) for x in held]) for j, t in ((1, np.int64), (2, np.int32)))
            if value is None:
                h = np.concatenate([np.frombuffer(x[0], np.uint32) for x in held])
            else:
                _, pivot, pivot2 = hot[value]
                k, k2 = np.append(k, np.int64(pivot)), np.append(k2, np.int32(pivot2))
                h = np.zeros(len(k), np.uint32)
            yield from grouped(h, k, k2, value, block)

        now, held = None, []
        for batch in batches:
            for part, value, block, *arrays in zip(*(batch.column(c).to_pylist() for c in ("part", "value", "block", "h", "k", "k2")), strict=True):
                if (part, value, block) != now:
                    if held:
                        yield from made(now, held)
                    now, held = (part, value, block), []
                held.append(arrays)
        if held:
            yield from made(now, held)

    tasks = min(MOST_TASKS, -(-parts // 4))
    rows = only_texts(docs).mapInArrow(pack, "part bigint, value bigint, block int, h binary, k binary, k2 binary")
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "value", "block").mapInArrow(match, MEMBERS)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, k, k2, text) of the wanted lines ``wanted(id, k, k2)``, whose keys are broadcast up to a bound, else joined by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, k2, lines in distinct_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), pa.array(lines, pa.string())], ["k", "k2", "text"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    lines = only_texts(docs).mapInArrow(run, "k bigint, k2 int, text string")
    return lines.join(wanted, ["k", "k2"]).dropDuplicates(["id"]).select("id", "k", "k2", "text")


def line_links(grouped: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (hi, lo) between the ids of similar lines; ``grouped(run, grp, k, k2)``, ``texts(id, k, k2, text)``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, groups, size = [], [], {}, 0

        def linked() -> pa.RecordBatch:
            found = forest(lines, similar)
            for where in groups.values():
                if len(where) > 1:
                    found.search(where)
            return pa.RecordBatch.from_arrays([pa.array([ids[p[j]] for p in found.links], pa.int64()) for j in (0, 1)], ["hi", "lo"])

        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for run, own, grps, line in zip(*(part.column(c).to_pylist() for c in ("run", "id", "grps", "text")), strict=True):
                    if run != last and size >= TOGETHER:
                        yield linked()
                        ids, lines, groups, size = [], [], {}, 0
                    last = run
                    for g in grps:
                        groups.setdefault((run, g), []).append(len(ids))
                    ids.append(own)
                    lines.append(line)
                    size += len(line)
        if ids:
            yield linked()

    runs = grouped.groupBy("run", "k", "k2").agg(F.collect_set("grp").alias("grps"))
    full = runs.join(texts, ["k", "k2"]).select("run", "id", "grps", "text")
    return full.repartition("run").sortWithinPartitions("run").mapInArrow(verify, "hi bigint, lo bigint")


def rest_of_frequent(hot: DataFrame, wanted: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(run, grp, k, k2): blocks in which the lines of a frequent value outside its largest component meet all lines of the value."""
    rooted = hot.select("value", "block", "k", "k2").distinct().join(wanted, ["k", "k2"]).join(roots, F.col("id") == F.col("node"), "left")
    placed = scratch.save(rooted.select("value", "block", "k", "k2", F.coalesce("root", "id").alias("root")))
    sizes = placed.groupBy("value", "root").agg(F.countDistinct("k", "k2").alias("n"))
    values = sizes.groupBy("value").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    values = values.select("value", F.col("most.root").alias("largest"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("slices")).filter("slices > 0")
    blocks = placed.groupBy("value").agg(F.collect_set("block").alias("blocks"))
    full = placed.join(values, "value").withColumn("slice", F.pmod(F.xxhash64("k"), F.col("slices")).cast("int"))
    every = full.select("value", "k", "k2", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    outside = full.filter("root <> largest").join(blocks, "value").select("value", "k", "k2", F.explode("blocks").alias("block"), "slice")
    met = every.unionByName(outside).select(F.xxhash64("value", "block", "slice").alias("run"), "k", "k2").distinct()
    return met.select("run", F.col("run").alias("grp"), "k", "k2")


def similar_lines(docs: DataFrame, count: int, similar: float, scratch: Scratch) -> DataFrame:
    """(k, k2, id, root) of the lines that are linked to others."""
    grouped = scratch.save(members(docs, count))
    # Written with its numbers: they are the same for all that reads them.
    wanted = scratch.save(grouped.select("k", "k2").distinct().withColumn("id", F.monotonically_increasing_id()))
    texts = scratch.save(line_texts(docs, wanted))
    # Written first: two Python steps in one stage would keep twice the workers.
    links = scratch.save(line_links(grouped, texts, similar))
    roots = connected_components(links, scratch)
    hot = grouped.filter("value is not null")
    if hot.limit(1).count():
        more = scratch.save(rest_of_frequent(hot, wanted, roots, scratch))
        if more.limit(1).count():
            late = scratch.save(line_links(more, texts, similar))
            if not late.limit(1).count():
                return wanted.join(roots, F.col("id") == F.col("node")).select("k", "k2", "id", "root")
            roots = connected_components(roots.select(F.col("node").alias("hi"), F.col("root").alias("lo")).unionByName(late), scratch)
    return wanted.join(roots, F.col("id") == F.col("node")).select("k", "k2", "id", "root")


def dropped_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, row, dropped): the numbers of the lines that each document loses; ``row`` is the XXH64 of its text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    at = scratch.save(lines_of(read))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "row")
    distinct = scratch.save(at.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    count, every = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    linked = similar_lines(read, count, similar, scratch)
    found = scratch.save(distinct.join(linked, ["k", "k2"], "left").filter("n > 1 or id is not null"))
    placed = found.filter("root is not null")
    # A table of its own: both sides of the join are then plain exchanges, which Spark can split where one component is large.
    keepers = scratch.save(placed.groupBy("root").agg(F.min(F.struct("first", "id")).alias("f")).select("root", F.col("f.id").alias("keeper")))
    lost = placed.join(keepers, "root").withColumn("lost", F.col("id") != F.col("keeper"))
    marks = found.filter("root is null").withColumn("lost", F.lit(False)).unionByName(lost.drop("keeper"))
    marks = scratch.save(marks.filter("n > 1 or lost").select("k", "k2", "first", "n", "lost"))
    # Fewer than HEAVY lines stand in that many places each; all others are shuffled.
    often = every // HEAVY
    repeated = at.join(F.broadcast(marks.filter(F.col("n") > often)), ["k", "k2"]).unionByName(at.join(marks.filter(F.col("n") <= often), ["k", "k2"]))
    kept = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line") == F.col("line")) & (F.col("first.row") == F.col("row"))
    gone = repeated.filter(F.col("lost") | ~kept)
    return scratch.save(gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("dropped")))


def drop_lines(docs: DataFrame, similar: float = SIMILAR, counts: bool = False) -> DataFrame:
    """The documents without the lines that repeat an earlier one; with ``counts`` also n_lines and n_dropped."""
    of, of_row, gone, split_ = (free_name(docs, x) for x in ("of", "of_row", "gone", "split"))
    dropped = dropped_lines(docs, similar).select(F.col("doc_id").alias(of), F.col("row").alias(of_row), F.col("dropped").alias(gone))
    # Texts are hashed against the few dropped numbers, not sorted; a document's key stands once among these.
    joined = docs.join(dropped.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(dropped[of]) & (F.xxhash64(docs["text"].cast("string")) == dropped[of_row]), "left")
    # A column of its own, used more than once: inside of the function below the text would be split again for each line.
    joined = joined.withColumn(split_, F.when(F.lit(counts) | F.col(gone).isNotNull(), F.split(docs["text"], "\n")))
    lines = F.col(split_)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), docs["text"]).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    new = {"n_lines", "n_dropped"} if counts else set()
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in new]
    if counts:
        out += [F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped")]
    result = joined.select(*out)
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns and not counts else result
