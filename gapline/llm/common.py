"""Pieces that several operators share: shared scratch tables, connected components, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        # One machine: driver and executors see the same folders.
        configured = tempfile.mkdtemp(prefix="gapline-")
        spark.conf.set("spark.checkpoint.dir", configured)
        return configured
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        return self.load(*self.write(df))

    def write(self, df: DataFrame) -> tuple[str, object]:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return path, df.schema

    def load(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, path: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        target = jvm.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that only a few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def local_forest(edges: DataFrame, of: str = "long") -> DataFrame:
    """Contract each partition's edges (hi, lo) to stars around the smallest node: same components, fewer edges."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for batch in batches:
            for a, b in zip(batch["hi"].tolist(), batch["lo"].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    low, high = (a, b) if a < b else (b, a)
                    parent[high] = low
                    parent.setdefault(low, low)
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for k in range(0, len(pairs), 50_000):
            yield pd.DataFrame(pairs[k : k + 50_000], columns=["hi", "lo"])

    return edges.select("hi", "lo").mapInPandas(contract, f"hi {of}, lo {of}")


def connected_components(edges: DataFrame, scratch: Scratch, of: str = "long") -> DataFrame:
    """Distributed union-find over ``edges(hi, lo)``: rows (node, root) for every node that has an edge.

    Each task first joins its own edges to stars; then large-star and small-star rounds hook every node to the
    smallest neighbour until nothing changes (a number of rounds logarithmic in the longest path). Each round is
    written to the shared folder. ``root`` is the smallest node of the component.
    """
    ordered = edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).filter("hi <> lo")
    path, schema = scratch.write(local_forest(ordered, of).distinct())
    seen = None
    while True:
        stars = scratch.load(path, schema)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == seen:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = tuple(now)
        # Minima are tables of their own: both sides of a join then come from plain exchanges, which Spark can split where
        # one node has a large part of all edges.
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = scratch.write(both.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("m")).select("of", F.least("of", "m").alias("m")))
        large = stars.join(scratch.load(*least), F.col("lo") == F.col("of")).select("hi", F.col("m").alias("lo")).filter("hi <> lo")
        large = scratch.write(large.unionByName(stars).distinct())
        edges = scratch.load(*large)
        low = scratch.write(edges.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("m")))
        lows = scratch.load(*low)
        small = edges.join(lows, F.col("hi") == F.col("of"))
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lows.select(F.col("of").alias("hi"), F.col("m").alias("lo")))
        later, _ = scratch.write(local_forest(small.filter("hi <> lo"), of).distinct())
        for old in (path, least[0], large[0], low[0]):
            scratch.drop(old)
        path = later
