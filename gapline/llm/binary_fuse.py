"""Exact de-duplication of arriving batches against immutable snapshots, screened by static binary-fuse filters.

A snapshot holds the texts that were new when it was made: a table of exact texts with their digests, in buckets by digest, and one
3-wise binary-fuse filter of 8 bits a slot for each bucket, about nine bits for a text. It is never changed. A batch goes through three steps:

1. the batch's own duplicates are grouped by digest and bytes, in an aggregate that combines before its shuffle;
2. the batch's distinct digests meet the filters of each snapshot, bucket by bucket; only those that a filter calls present go on
   (one in 256 of those that are absent);
3. positives join the snapshot's digests, and where both have a digest its texts are compared byte by byte. A known text adds its rows to
   the class of the snapshot; all others are the next snapshot.

The last step gives each row its class. Digests that two different texts share are looked for; the rows of those go by text.

No texts but distinct ones are shuffled or written, once; what meets a snapshot are digests, and texts only where these agree. Rows find their class by digest; the classes that hold over a thousandth of all
rows (fewer than a thousand) are broadcast for that, so that a text with a third of all rows makes no hot key.

Defined cases: null text counts as empty; rows without an id take part, any id is larger than none, and a class without ids has a null
keep_id; of rows that repeat both id and text one is kept; very long texts are compared whole; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

#: Texts of a bucket, on average.
BUCKET = 1 << 14
#: Digests of known texts that are sent to the rows.
KEYS = 500_000
#: A class with more than this share of all rows is broadcast.
HEAVY = 1000

FILTER = "bucket long, seed long, segment long, slots long, prints binary"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64-bit numbers: the finaliser of MurmurHash3 over key plus seed."""
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static filter: three slots for a key, in three consecutive segments, whose prints XOR to the key's own print."""

    def __init__(self, seed: int, segment: int, prints: np.ndarray):
        self.seed, self.segment, self.prints = seed, segment, prints

    def _places(self, h: np.ndarray) -> np.ndarray:
        low = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(len(self.prints) - 2 * self.segment)) >> np.uint64(32)
        step = np.uint64(self.segment)
        return np.stack([first, (first + step) ^ (h >> np.uint64(18) & low), (first + step + step) ^ (h & low)]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> BinaryFuse:
        """The filter of these 64-bit keys; repeated ones count once."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        # Segment length and slots a key by the formulas of the filter's authors.
        segment = 1 << min(18, int(np.log(n) / np.log(3.33) + 2.25))
        wanted = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        slots = (max(1, int(np.ceil(wanted / segment)) - 2) + 2) * segment
        seed = 0
        while True:
            made = cls(seed, segment, np.zeros(slots, np.uint8))
            h = mixed(keys, seed)
            places = made._places(h)
            layers = made._peel(places, slots)
            if layers is not None:
                own = cls._print(h)
                for key, slot in reversed(layers):
                    a, b, c = places[:, key]
                    made.prints[slot] = own[key] ^ made.prints[a] ^ made.prints[b] ^ made.prints[c]
                return made
            seed += 1

    @staticmethod
    def _peel(places: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(keys, slots) layer by layer, each key alone in its slot among those left; None if some keys can't be told apart."""
        n = places.shape[1]
        flat = places.ravel()
        count = np.bincount(flat, minlength=slots)
        total = np.bincount(flat, weights=np.tile(np.arange(n, dtype=float), 3), minlength=slots).astype(np.int64)
        layers, left = [], n
        ready = np.flatnonzero(count == 1)
        while len(ready):
            # Where one key is left, the sum of keys is that key; one that is alone in several slots takes the first.
            key, first = np.unique(total[ready], return_index=True)
            layers.append((key, ready[first]))
            left -= len(key)
            touched = places[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.tile(key, 3))
            ready = np.unique(touched[count[touched] == 1])
        return layers if left == 0 else None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were not there."""
        h = mixed(keys.astype(np.uint64), self.seed)
        a, b, c = self._places(h)
        return self._print(h) == self.prints[a] ^ self.prints[b] ^ self.prints[c]


def key_of(digest: Column) -> Column:
    return F.xxhash64(digest)


class Snapshot:
    """Exact texts (class_id, digest, text) and their filters."""

    def __init__(self, scratch: Scratch, texts: DataFrame):
        self.texts = texts
        self.buckets = max(1, -(-texts.count() // BUCKET))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(bucket: int, keys: list[np.ndarray]) -> pa.RecordBatch:
                f = BinaryFuse.of(np.concatenate(keys))
                return pa.RecordBatch.from_pylist([{"bucket": bucket, "seed": f.seed, "segment": f.segment, "slots": len(f.prints), "prints": f.prints.tobytes()}])

            now, held = None, []
            for batch in batches:
                bucket, key = batch.column("bucket").to_numpy(), batch.column("key").to_numpy()
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if bucket[a] != now and held:
                        yield made(now, held)
                        held = []
                    now = int(bucket[a])
                    held.append(key[a:b].astype(np.uint64))
            if held:
                yield made(now, held)

        keys = texts.select(self.bucket(F.col("digest")).alias("bucket"), key_of(F.col("digest")).alias("key"))
        self.filters = scratch.save(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, FILTER))

    def bucket(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest, F.lit("bucket")), F.lit(self.buckets))

    def screen(self, digests: DataFrame) -> DataFrame:
        """The digests that a filter calls present."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for batch in batches:
                bucket = batch.column("bucket").to_numpy()
                is_key = batch.column("is_key").to_numpy(zero_copy_only=False)
                key = batch.column("key").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (is_key[1:] != is_key[:-1])) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if not is_key[a]:
                        row = batch.slice(a, 1).to_pylist()[0]
                        now, held = row["bucket"], BinaryFuse(row["seed"], row["segment"], np.frombuffer(row["prints"], np.uint8))
                    elif now == bucket[a]:
                        present = held.holds(key[a:b].astype(np.int64).astype(np.uint64))
                        yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, b - a).filter(pa.array(present))], ["digest"])

        asked = digests.select(self.bucket(F.col("digest")).alias("bucket"), F.lit(True).alias("is_key"), F.coalesce(key_of(F.col("digest")), F.lit(0)).alias("key"), "digest")
        filters = self.filters.select("*", F.lit(False).alias("is_key"), F.lit(0).cast("long").alias("key"))
        met = filters.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "is_key")
        return met.select("bucket", "is_key", "key", "digest", "seed", "segment", "prints").mapInArrow(probe, "digest string")


def group(rows: DataFrame) -> DataFrame:
    """A batch's own classes: (digest, text, n, last)."""
    return rows.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose ``digest`` is (``left_semi``) or is not (``left_anti``) among the saved ``keys(digest)``.

    Rows carry texts, keys do not: up to :data:`KEYS` keys go to the rows, more of them meet the rows by a shuffle.
    """
    few = keys.count() <= KEYS
    return rows.join(F.broadcast(keys) if few else keys, "digest", how)


class Store:
    """Snapshots in order of arrival, with what each batch added to each class."""

    def __init__(self, scratch: Scratch, digest: Callable[[Column], Column]):
        self.scratch, self.digest = scratch, digest
        self.snapshots: list[Snapshot] = []
        self.added: list[DataFrame] = []

    def append(self, batch: DataFrame) -> None:
        """Take in ``batch(doc_id, text)``; its new texts become the next snapshot."""
        text = F.coalesce(F.col("text"), F.lit(""))
        batch = batch.select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(F.sha2(text, 256)).alias("digest"), text.alias("text"))
        digests = batch.select("digest").distinct()
        hits = []
        if self.snapshots:
            digests = self.scratch.save(digests)
        for snapshot in self.snapshots:
            positive = snapshot.screen(digests)
            hits.append(self.scratch.save(positive.join(snapshot.texts.select("digest").distinct(), "digest", "left_semi")))
        own = group(batch).withColumn("class_id", F.lit(len(self.snapshots) << 56) + F.monotonically_increasing_id())
        own = self.scratch.save(own)
        # Whose digest a snapshot has: texts of the same digest are compared byte by byte.
        known, new, narrow = [], own, own.select("class_id", "digest", "n", "last")
        for snapshot, hit in zip(self.snapshots, hits, strict=True):
            suspects = among(own, hit, "left_semi").select("class_id", "digest", "text")
            stored = among(snapshot.texts, hit, "left_semi").select(F.col("class_id").alias("found"), "digest", "text")
            found = self.scratch.save(suspects.join(stored, ["digest", "text"]).select("class_id", "found", "digest"))
            known.append(found.drop("digest"))
            fresh = among(new, hit, "left_semi").join(found.select("class_id"), "class_id", "left_anti")
            new = among(new, hit, "left_anti").unionByName(fresh.select(*new.columns))
        if known:
            both = known[0]
            for k in known[1:]:
                both = both.unionByName(k)
            narrow = narrow.join(both, "class_id", "left").select(F.coalesce("found", "class_id").alias("class_id"), F.when(F.col("found").isNull(), F.col("digest")).alias("digest"), "n", "last")
        self.added.append(narrow)
        self.snapshots.append(Snapshot(self.scratch, new.select("class_id", "digest", "text")))

    def classes(self) -> DataFrame:
        """(class_id, digest, size, keep_id) of every text."""
        out = self.added[0]
        for added in self.added[1:]:
            out = out.unionByName(added)
        return out.groupBy("class_id").agg(F.max("digest").alias("digest"), F.sum("n").alias("size"), F.max("last").alias("keep_id"))

    def texts(self) -> DataFrame:
        out = self.snapshots[0].texts
        for s in self.snapshots[1:]:
            out = out.unionByName(s.texts)
        return out


def deduplicate(docs: DataFrame, batches: int = 2, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Rows are dealt to so many batches by their id, which arrive one after the other: the first makes a snapshot, each later one is
    screened by the filters of all before it. ``digest`` may shorten the SHA-256 that texts are found by; the result is the same.
    """
    scratch = Scratch(docs.sparkSession, "binary_fuse")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    store = Store(scratch, digest)
    for batch in range(batches):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))

    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = scratch.save(docs.select("doc_id", sha.alias("sha"), F.monotonically_increasing_id().alias("row")))
    classes = scratch.save(store.classes())
    # Different texts of one digest: their rows go by text.
    shared = scratch.save(classes.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    clear, rows = classes.withColumn("key", F.col("digest")), rows.withColumn("key", digest(F.col("sha")))
    if not shared.isEmpty():
        by_class = F.concat(F.lit("class "), "class_id")
        texts = store.texts().join(shared, "digest", "left_semi").select("class_id", "digest", "text")
        by_text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), sha.alias("sha")).withColumn("digest", digest(F.col("sha"))).join(texts, ["digest", "text"])
        by_text = scratch.save(by_text.select("doc_id", "sha", (-1 - F.monotonically_increasing_id()).alias("row"), by_class.alias("key")))
        rows = rows.join(shared.withColumnRenamed("digest", "key"), "key", "left_anti").unionByName(by_text)
        ambiguous = shared.withColumn("by_text", F.lit(True))
        clear = classes.join(ambiguous, "digest", "left").withColumn("key", F.when(F.col("by_text"), by_class).otherwise(F.col("digest")))

    several = clear.filter("size > 1").select("key", "size", "keep_id")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tops = several.select(F.col("key").alias("of"), "keep_id")
    last = rows.join(tops, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("key").agg(F.max("row").alias("keep_row"))
    several = scratch.save(several.join(last, "key"))
    heavy = F.broadcast(several.filter(F.col("size") * HEAVY > total))
    light = several.filter(F.col("size") * HEAVY <= total)
    met = rows.join(heavy, "key").unionByName(rows.join(heavy, "key", "left_anti").join(light, "key", "left"), allowMissingColumns=True)
    alone = F.col("size").isNull()
    return met.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
