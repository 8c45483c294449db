"""Nearest neighbours by cosine: exact, block against block, and approximate, by an inverted file with residual product quantisation.

Both take ``vectors(chunk_id, embedding)`` and ``probes(rule_name, probe)`` and return rule_name, chunk_id, similarity, neighbor_rank.
Vectors and probes that are null or empty, or hold null, NaN or infinite values, take no part, and neither does a pair of different
widths; a vector of zeros is similar to nothing (0). Similarities are rounded to six digits, ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapline.operators.vectors import doubles, dot, norm
from gapline.sources.shared import new_folder

#: Probes, and numbers of theirs, that are sent to the tasks; more of them meet the vectors by a shuffle.
PROBES, PROBE_NUMBERS = 4096, 1 << 22
#: Numbers of the vectors of a shard; rows of a block.
SHARD, ROWS = 1 << 24, 4096
#: Lists of the inverted file by the square root of the rows, and at most; parts of a code; rows that the model is fitted on.
LISTS_BY_ROOT, LISTS, PARTS, FIT_ROWS = 16, 5000, 16, 100_000
#: Share of all rows that a probe looks at, and those that it compares in full, by neighbours wanted and at least.
SHARE, SHORTLIST, LEAST_SHORTLIST = 0.17, 10, 100
#: Rows that a probe looks at, by neighbours wanted, where that is more than the share.
LEAST_ROWS = 20
CENTROIDS = 256
#: Indexed vectors whose neighbours are looked for when an index is made, about, and neighbours of each.
MEASURED, MEASURED_NEIGHBOURS = 200, 10

BLOCK = "ids array<string>, width int, data binary"
FOUND = "rule_name string, chunk_id string, similarity double"


def matrices(batch: pa.RecordBatch, name: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of unit length) of a batch, a matrix for each width."""
    column = batch.column(vector)
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(width)])[:-1]
    ids = np.array(batch.column(name).to_pylist(), object)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        m = flat[start[rows][:, None] + np.arange(w)]
        fine = np.isfinite(m).all(axis=1)
        m = m[fine]
        length = np.sqrt((m * m).sum(axis=1))
        yield ids[rows[fine]], m / np.where(length == 0, 1, length)[:, None]


class Nearest:
    """The k best of each probe of a block, over any number of blocks of vectors."""

    def __init__(self, names: np.ndarray, probes: np.ndarray, k: int, threshold: float):
        self.names, self.probes, self.k = names, probes, k
        self.least = np.full(len(names), float(threshold))
        self.best: list[list[tuple[float, str]]] = [[] for _ in names]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), ROWS):
            part = ids[at : at + ROWS]
            # One matrix product for all pairs of the two blocks.
            similar = np.round(self.probes @ vectors[at : at + ROWS].T, 6) + 0.0
            for p in np.flatnonzero((similar >= self.least[:, None]).any(axis=1)).tolist():
                row = similar[p]
                edge = self.least[p] if len(row) <= self.k else max(self.least[p], np.partition(row, len(row) - self.k)[len(row) - self.k])
                near = np.flatnonzero(row >= edge)
                self.best[p] = sorted([*self.best[p], *zip((-row[near]).tolist(), part[near].tolist(), strict=True)])[: self.k]
                if len(self.best[p]) == self.k:
                    self.least[p] = -self.best[p][-1][0]

    def rows(self) -> pa.RecordBatch:
        found = [(n, i, -s) for n, best in zip(self.names.tolist(), self.best, strict=True) for s, i in best]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["rule_name", "chunk_id", "similarity"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("rule_name").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def semantic_candidates(vectors: DataFrame, probes: DataFrame, k: int, threshold: float) -> DataFrame:
    """For each probe the k most similar vectors above a threshold, exact.

    A task multiplies a block of probes with a block of vectors and keeps k rows of each probe; those are merged by probe. Up to
    :data:`PROBES` probes are sent to the tasks, and the vectors stay where they are. More of them are packed into blocks and go to
    every shard of the vectors: the shuffle holds the vectors once, and the probes once for each shard.
    """
    vectors, probes = vectors.select(F.col("chunk_id").cast("string").alias("id"), "embedding"), probes.select(F.col("rule_name").cast("string").alias("id"), F.col("probe").alias("embedding"))
    count, numbers = probes.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    if count <= PROBES and numbers <= PROBE_NUMBERS:
        sent = list(matrices(pa.RecordBatch.from_pandas(probes.toPandas(), pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float64()))])), "id", "embedding"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = {m.shape[1]: Nearest(ids, m, k, threshold) for ids, m in sent}
            for batch in batches:
                for ids, m in matrices(batch, "id", "embedding"):
                    if m.shape[1] in asked:
                        asked[m.shape[1]].add(ids, m)
            for found in asked.values():
                yield found.rows()

        return ranked(vectors.mapInArrow(run, FOUND), k)
    return ranked(_sharded(vectors, probes, k, threshold), k)


def _sharded(vectors: DataFrame, probes: DataFrame, k: int, threshold: float) -> DataFrame:
    numbers = vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    shards = int(max(1, -(-numbers // SHARD), vectors.sparkSession.sparkContext.defaultParallelism))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for ids, m in matrices(batch.slice(at, ROWS), "id", "embedding"):
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.string())), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["ids", "width", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["shard"] != now:
                    now, held = row["shard"], []
                ids, m = np.array(row["ids"], object), np.frombuffer(row["data"]).reshape(len(row["ids"]), row["width"])
                if not row["asks"]:
                    held.append((ids, m))
                    continue
                asked = Nearest(ids, m, k, threshold)
                for others, block in held:
                    if block.shape[1] == row["width"]:
                        asked.add(others, block)
                yield asked.rows()

    dealt = vectors.mapInArrow(pack, BLOCK).select(F.pmod(F.xxhash64("data"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "*")
    asked = probes.mapInArrow(pack, BLOCK).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "*")
    return dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(run, FOUND)


def neighbor_preservation(before: DataFrame, after: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of each probe's k nearest that stay its k nearest; 1 if there are no more than k vectors.

    ``probes(rule_name, chunk_id)`` names the vectors that are asked for.
    """

    def near(vectors: DataFrame) -> DataFrame:
        asked = probes.join(vectors.select("chunk_id", F.col("embedding").alias("probe")), "chunk_id").select("rule_name", "probe")
        return semantic_candidates(vectors, asked, k, -2.0).select("rule_name", "chunk_id")

    a, b = near(before), near(after).withColumn("kept", F.lit(1))
    return a.join(b, ["rule_name", "chunk_id"], "left").agg(F.round(F.count("kept") / F.count("*"), 6).alias("preservation"))


# Approximate search.


@dataclass(frozen=True)
class Model:
    """Centres of the lists, and for each part of a residual its centroids."""

    cells: np.ndarray
    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.cells.shape[1]

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows in parts of equal width, the last one filled up with zeros."""
        parts, _, width = self.books.shape
        full = np.zeros((len(rows), parts * width))
        full[:, : rows.shape[1]] = rows
        return full.reshape(len(rows), parts, width)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row of unit length, and the code of what its centre leaves."""
        cell = nearest_centre(rows, self.cells)
        parts = self.split(rows - self.cells[cell])
        return cell, np.stack([nearest_centre(parts[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(rows[at : at + ROWS] @ centres.T - half).argmax(axis=1) for at in range(0, max(1, len(rows)), ROWS)])


def centroids(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7, on_sphere: bool = False) -> np.ndarray:
    """k-means of a bounded sample; ``on_sphere`` keeps the centres at unit length."""
    rng = np.random.default_rng(seed)
    found = rows[rng.choice(len(rows), k, replace=len(rows) < k)].astype(float)
    for _ in range(rounds):
        at = nearest_centre(rows, found)
        count = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=rows[:, d], minlength=k) for d in range(rows.shape[1])], axis=1)
        size = np.linalg.norm(total, axis=1) if on_sphere else count
        found = np.where((size > 0)[:, None], total / np.where(size > 0, size, 1)[:, None], found)
    return found


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter((F.size("embedding") == dims) & fine)


def fit(vectors: DataFrame, lists: int | None = None, parts: int = PARTS, rows: int = FIT_ROWS) -> Model:
    """Lists and code books, fitted on about ``rows`` vectors of the most frequent width, chosen by a hash of the id."""
    widths = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if widths is None:
        raise ValueError("no vectors to fit an index on")
    dims, total = widths
    some = usable(vectors, dims).filter(F.exists("embedding", lambda x: x != 0))
    if total > rows:
        some = some.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    lists = lists or max(1, min(LISTS, int(LISTS_BY_ROOT * total**0.5), total // 2))
    if not 1 <= lists <= LISTS:
        raise ValueError(f"1 to {LISTS} lists")
    unit = F.transform(doubles(F.col("embedding")), lambda x: x / norm(F.col("embedding")))
    units = some.select(unit.alias("unit"))

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cells": [centroids(np.stack(group["unit"].to_numpy()).reshape(-1, dims), lists, 10, on_sphere=True).tobytes()]})

    # A bounded sample in one task. By angle: plain means of scattered vectors are short, and would draw most vectors to a few lists.
    made = units.groupBy().applyInPandas(centres, "cells binary").first()
    if made is None:
        raise ValueError("no vectors to fit an index on")
    cells = np.frombuffer(made["cells"]).reshape(lists, dims)
    width = -(-dims // parts)
    empty = Model(cells, np.zeros((parts, 1, width)))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array(batch.column("unit").to_pylist(), float).reshape(-1, dims)
            cut = empty.split(m - cells[nearest_centre(m, cells)])
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(m), pa.int32()), pa.array([x.tobytes() for x in cut[:, p]], pa.binary())], ["part", "piece"])

    def book(group: pd.DataFrame) -> pd.DataFrame:
        pieces = np.frombuffer(b"".join(group["piece"])).reshape(-1, width)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "book": [centroids(pieces, CENTROIDS).tobytes()]})

    books = units.select("unit").mapInArrow(residuals, "part int, piece binary").groupBy("part").applyInPandas(book, "part int, book binary").orderBy("part").collect()
    return Model(cells, np.stack([np.frombuffer(r["book"]).reshape(CENTROIDS, width) for r in books]))


class Index:
    """An inverted file on disk: ``rows`` in a folder for each list, ``sizes`` of the lists, what was ``measured``, and the ``model``, written last."""

    def __init__(self, spark: SparkSession, path: str, model: Model | None = None):
        self.spark, self.path = spark, path
        if model is None:
            row = spark.read.parquet(f"{path}/model").first()
            model = Model(np.frombuffer(row["cells"]).reshape(row["lists"], row["dims"]), np.frombuffer(row["books"]).reshape(row["parts"], CENTROIDS, -1))
        self.model = model
        self.rows = spark.read.schema("chunk_id string, embedding array<float>, code binary, cell int").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
        self.sizes = np.zeros(len(model.cells), np.int64)
        for cell, n in spark.read.parquet(f"{path}/sizes").collect():  # one row for each list, 5000 at most
            self.sizes[cell] = n

    @classmethod
    def write(cls, vectors: DataFrame, path: str, model: Model | None = None) -> Index:
        """Index every usable vector. AQE deals out the rows by list and splits lists that are too large for one file."""
        spark, vectors = vectors.sparkSession, vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        model = model or fit(vectors)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, unit in matrices(batch.set_column(0, "chunk_id", pa.array(np.arange(batch.num_rows))), "chunk_id", "embedding"):
                    if unit.shape[1] == model.dims and len(ids):
                        kept = batch.take(pa.array(ids.astype(np.int64)))
                        cell, code = model.encode(unit)
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], ["chunk_id", "embedding", "code", "cell"])

        coded = vectors.mapInArrow(encode, "chunk_id string, embedding array<float>, code binary, cell int")
        coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        needs = cls(spark, path, model).measure(vectors)
        spark.createDataFrame(needs, "share double, rank long").coalesce(1).write.mode("overwrite").parquet(f"{path}/measured")
        parts = (len(model.cells), model.dims, len(model.books), np.ascontiguousarray(model.cells).tobytes(), np.ascontiguousarray(model.books).tobytes())
        spark.createDataFrame([parts], "lists int, dims int, parts int, cells binary, books binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return cls(spark, path)

    def measure(self, vectors: DataFrame) -> list[tuple[float, int]]:
        """What it takes to find each exact neighbour of some indexed vectors: share of the rows to open, and rank by estimate among all rows.

        The neighbours are those of brute force over all vectors; a vector is no neighbour of its own here.
        """
        some = usable(vectors, self.model.dims).filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(min(1, MEASURED / max(1, self.sizes.sum())) * (1 << 30)))
        local = some.select("chunk_id", doubles(F.col("embedding")).alias("embedding")).dropDuplicates(["chunk_id"]).collect()
        if not local:
            return []
        asked = self.spark.createDataFrame(local, "rule_name string, probe array<double>")
        exact = semantic_candidates(vectors, asked, MEASURED_NEIGHBOURS + 1, -2.0).filter("rule_name <> chunk_id")
        # At most eleven rows for each probe: a bounded side.
        near = self.rows.select("chunk_id", "cell", "code").join(F.broadcast(exact.select("rule_name", "chunk_id")), "chunk_id").dropDuplicates(["rule_name", "chunk_id"]).collect()
        at = {r["chunk_id"]: n for n, r in enumerate(local)}
        m = np.array([r["embedding"] for r in local], float)
        length = np.sqrt((m * m).sum(axis=1))
        unit = m / np.where(length == 0, 1, length)[:, None]
        model = self.model
        tables, to_centre = np.einsum("pmd,mcd->mpc", model.split(unit), model.books), unit @ model.cells.T

        def estimates(p: int, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
            return to_centre[p, cell] + sum(table[p][code[:, part]] for part, table in enumerate(tables))

        probe = np.array([at[r["rule_name"]] for r in near], int)
        cell = np.array([r["cell"] for r in near], int)
        code = np.frombuffer(b"".join(r["code"] for r in near), np.uint8).reshape(len(near), -1)
        wanted = {p: np.flatnonzero(probe == p) for p in np.unique(probe).tolist()}
        least = {p: estimates(p, cell[rows], code[rows]) + 1e-9 for p, rows in wanted.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            above = np.zeros(len(near), np.int64)
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cells), -1)
                for p, rows in wanted.items():
                    above[rows] += len(cells) - np.searchsorted(np.sort(estimates(p, cells, codes)), least[p], "right")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(near))), pa.array(above)], ["n", "above"])

        above = np.zeros(len(near), np.int64)
        for n, total in self.rows.select("cell", "code").mapInArrow(count, "n long, above long").groupBy("n").agg(F.sum("above")).collect():
            above[n] = total
        order = np.argsort(-(unit @ model.cells.T - (model.cells**2).sum(axis=1) / 2), axis=1, kind="stable")
        upto = np.empty(order.shape)
        np.put_along_axis(upto, order, np.cumsum(self.sizes[order], axis=1), axis=1)
        # Neighbours with equal estimates come in order of their ids.
        return [(float(min(1.0, (upto[p, c] + 0.5) / self.sizes.sum())), int(a) + MEASURED_NEIGHBOURS + 1) for p, c, a in zip(probe.tolist(), cell.tolist(), above.tolist(), strict=True)]

    def reach(self, recall: float) -> tuple[float, int]:
        """Share of the rows to open and length of the short list that found ``recall`` of the measured neighbours; all rows if nothing was measured."""
        rows = self.spark.read.parquet(f"{self.path}/measured").collect()  # at most eleven for each measured vector
        if not rows:
            return 1.0, int(self.sizes.sum())
        # Each of the two may lose half of what may be lost.
        share, rank = (np.quantile([r[c] for r in rows], (1 + recall) / 2, method="higher") for c in ("share", "rank"))
        return float(share), int(rank)

    def lists_of(self, unit: np.ndarray, share: float, least: int = 0) -> list[np.ndarray]:
        """Of each probe the nearest lists, as many as hold ``share`` of all rows or ``least`` rows; at least one that is not empty."""
        order = np.argsort(-(unit @ self.model.cells.T - (self.model.cells**2).sum(axis=1) / 2), axis=1, kind="stable")
        upto = np.cumsum(self.sizes[order], axis=1)
        last = np.maximum((upto <= max(least, share * self.sizes.sum())).sum(axis=1), (upto == 0).sum(axis=1) + 1)
        return [o[:n] for o, n in zip(order, last.tolist(), strict=True)]

    def search(self, probes: DataFrame, k: int, share: float = SHARE, recall: float | None = None) -> DataFrame:
        """Approximate top-k of each probe.

        A probe reads the codes of its nearest lists only, whose folders are all that the scan opens; distance tables of the probe's
        parts to the centroids give an estimate for each code, and the best estimates are compared in full. Probes come in
        blocks of :data:`PROBES`; more than one block is written block by block.

        With ``recall``, the rows to open and the short list are those that found this share of the exact neighbours (up to
        :data:`MEASURED_NEIGHBOURS` of a vector) when the index was made, in place of ``share`` and the usual length.
        """
        short = usual = max(SHORTLIST * k, LEAST_SHORTLIST)
        if recall is not None:
            share, rank = self.reach(recall)
            short = max(usual, -(-rank * k // MEASURED_NEIGHBOURS))
        size = max(1, PROBES * usual // short)
        names = probes.select(F.col("rule_name").cast("string").alias("id"), F.col("probe").cast("array<double>").alias("embedding"))
        block, out = [], None
        schema = pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float64()))])
        for row in names.toLocalIterator():
            block.append(row.asDict())
            if len(block) == size:
                out = out or new_folder(self.spark, "search")
                self._search(pa.RecordBatch.from_pylist(block, schema), k, share, short).write.mode("append").parquet(out)
                block = []
        last = self._search(pa.RecordBatch.from_pylist(block, schema), k, share, short)
        if out is None:
            return last
        last.write.mode("append").parquet(out)
        return self.spark.read.schema(last.schema).parquet(out)

    def _search(self, block: pa.RecordBatch, k: int, share: float, short: int) -> DataFrame:
        model, names, unit = self.model, np.zeros(0, object), np.zeros((0, self.model.dims))
        for ids, m in matrices(block, "id", "embedding"):
            if m.shape[1] == model.dims:
                names, unit = ids, m
        asked: dict[int, list[int]] = {}
        for p, lists in enumerate(self.lists_of(unit, share, LEAST_ROWS * k)):
            for cell in lists.tolist():
                asked.setdefault(cell, []).append(p)

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = np.einsum("pmd,mcd->mpc", model.split(unit), model.books)
            to_centre = unit @ model.cells.T
            best: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
            held: dict[int, int] = {}

            def cut(p: int) -> None:
                score, ids, cell = (np.concatenate(x) for x in zip(*best[p], strict=True))
                if len(score) > short:
                    edge = -np.partition(-score, short - 1)[short - 1]
                    above, ties = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
                    keep = np.concatenate([above, ties[np.argsort(ids[ties])][: short - len(above)]])
                    score, ids, cell = score[keep], ids[keep], cell[keep]
                best[p], held[p] = [(score, ids, cell)], len(score)

            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = batch.column("cell").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cells), -1)
                ids = np.array(batch.column("chunk_id").to_pylist(), object)
                for cell in np.unique(cells).tolist():
                    rows = np.flatnonzero(cells == cell)
                    ps = np.array(asked.get(cell, []), int)
                    for at in range(0, len(ps), 64):
                        some = ps[at : at + 64]
                        score = np.repeat(to_centre[some, cell][:, None], len(rows), axis=1)
                        for part, table in enumerate(tables):
                            score += table[some][:, code[rows, part]]
                        for p, s in zip(some.tolist(), score, strict=True):
                            best.setdefault(p, []).append((s, ids[rows], cells[rows]))
                            held[p] = held.get(p, 0) + len(rows)
                            if held[p] > 8 * short:
                                cut(p)
            for p in best:
                cut(p)
                score, found, cell = best[p][0]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(score), pa.int32()), pa.array(found.tolist(), pa.string()), pa.array(cell, pa.int32()), pa.array(score)], ["p", "chunk_id", "cell", "estimate"])

        opened = self.rows.filter(F.col("cell").isin(sorted(asked)))
        estimates = opened.select("chunk_id", "cell", "code").mapInArrow(estimate, "p int, chunk_id string, cell int, estimate double")
        rank = F.row_number().over(W.partitionBy("p").orderBy(F.desc("estimate"), "chunk_id"))
        # At most PROBES times the short list: a bounded side.
        shortlist = estimates.withColumn("n", rank).filter(F.col("n") <= short).select("p", "chunk_id", "cell").distinct()
        local = [(p, n, u.tolist()) for p, (n, u) in enumerate(zip(names.tolist(), unit, strict=True))]
        shortlist = shortlist.join(F.broadcast(self.spark.createDataFrame(local, "p int, rule_name string, probe array<double>")), "p")
        near = opened.select("chunk_id", "cell", "embedding").join(F.broadcast(shortlist), ["cell", "chunk_id"])
        similar = F.round(dot(F.col("embedding"), F.col("probe")) / norm(F.col("embedding")), 6)
        return ranked(near.select("rule_name", "chunk_id", similar.alias("similarity")), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hits = found.select("rule_name", "chunk_id", F.lit(1).alias("hit"))
    return exact.select("rule_name", "chunk_id").join(hits, ["rule_name", "chunk_id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"), F.count("*").alias("exact"))
