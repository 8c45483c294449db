"""Writing and maintaining partitioned tables on plain files."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.fold import let


def write_partitioned(rows: DataFrame, path: str, partition: str, cluster: list[str], mode: str = "append", files: int = 1, curve: bool = False) -> None:
    """Append to a partitioned table, sorted by the cluster columns inside each file (so that statistics prune).

    ``files`` spreads each partition value over that many tasks: with one, a day of all data would be one task's work. With ``curve``, rows
    are dealt out and sorted by their place on a curve over all cluster columns, so that filters on any of them skip files and row groups.
    """
    if curve:
        keyed = rows.withColumn("_z", curve_key(rows, cluster))
        keyed = keyed.repartitionByRange(partition, "_z").sortWithinPartitions(partition, "_z").drop("_z")
        keyed.write.partitionBy(partition).mode(mode).parquet(path)
        return
    salt = [F.pmod(F.xxhash64(*cluster), F.lit(files))] if files > 1 and cluster else []
    rows.repartition(partition, *salt).sortWithinPartitions(partition, *cluster).write.partitionBy(partition).mode(mode).parquet(path)


def overwrite_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace only the partitions that ``rows`` holds: a repeated run changes nothing."""
    rows.repartition(*partitions).write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows by a fixed schema; lines that don't fit are kept in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def insert_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def quarantine_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and errors with an id from ``uri``, ``error_class`` and ``error_message``; rows with an error_class are errors."""
    error_id = F.substring(F.sha2(F.concat_ws(":", "uri", "error_class", "error_message"), 256), 1, 16)
    return rows.filter("error_class is null"), rows.filter("error_class is not null").withColumn("error_id", error_id)


RUNS = "run_id string, source_type string, status string, rows_written bigint, errors bigint, bytes bigint, seconds double, tokens_per_chunk double"


def log_run(spark: SparkSession, path: str, run_id: str, source_type: str, status: str, rows_written: int = 0, errors: int = 0, size: int = 0, seconds: float = 0.0, tokens: int = 0) -> None:
    """Append the row of one run to the log."""
    row = (run_id, source_type, status, rows_written, errors, size, seconds, tokens / rows_written if rows_written else 0.0)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)


def run_logged(rows: DataFrame, path: str, log_path: str, run_id: str, source_type: str) -> None:
    """Write rows and log the run; counters are observed while writing, failures are logged as ``failed`` and raised."""
    import time

    from pyspark.sql import Observation

    spark, began, seen = rows.sparkSession, time.time(), Observation()
    counted = rows.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text_content")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.greatest(F.lit(1), F.floor(F.length("text_content") / 4))), F.lit(0)).alias("tokens"))
    try:
        counted.write.mode("append").parquet(path)
    except Exception:
        log_run(spark, log_path, run_id, source_type, "failed", seconds=time.time() - began)
        raise
    got = seen.get
    log_run(spark, log_path, run_id, source_type, "completed", got["n"], 0, got["bytes"], time.time() - began, got["tokens"])


def export_report_csv(rows: DataFrame, path: str, order: str) -> None:
    """One CSV file with a header, for reports of a few rows."""
    rows.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_sorted_parquet(rows: DataFrame, path: str, order: list[str], clustered: bool = False) -> None:
    """Globally sorted: ranges of the keys, each sorted. With ``clustered``, in the order of a curve that keeps all keys together."""
    if clustered:
        rows.withColumn("_z", curve_key(rows, order)).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
    else:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _stepped(table: Column, value: Column, step: int, place: Column) -> Column:
    return F.when((place + step <= F.size(table)) & (F.get(table, place + step - 1) <= value), place + step).otherwise(place)


def curve_key(rows: DataFrame, columns: list[str], bits: int = 8, sample: int = 20_000) -> Column:
    """A row's place on a Z-order curve: the interleaved bits of its columns' places among ``2 ** bits`` ranges of equal weight.

    Files and row groups in this order hold a small range of every column, where a plain sort narrows the first column only. The ranges
    come from about ``sample`` rows, chosen by a hash; they decide where a row lies, never whether. Nulls come first.
    """
    if not 1 <= len(columns) * bits <= 63:
        raise ValueError("one to 63 bits in all")
    total = max(1, rows.count())
    chosen = rows.select(*columns).filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)))
    seen = chosen.limit(2 * sample).toPandas()  # a bounded sample: skewed hashes (equal rows) are cut
    places = []
    for c in columns:
        values = sorted(seen[c].dropna().tolist())
        cuts = sorted({values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)}) if values else []
        kind = rows.schema[c].dataType
        place = F.lit(0)
        if cuts:
            # Binary search, as an expression of ``bits`` steps over the array of cuts.
            table = F.array(*[F.lit(x).cast(kind) for x in cuts])
            for bit in reversed(range(bits)):
                place = let(place, partial(_stepped, table, F.col(c), 1 << bit))
        places.append(F.coalesce(place, F.lit(0)).cast("long"))

    def interleaved(at: Column) -> Column:
        key = F.lit(0).cast("long")
        for bit in range(bits):
            for n in range(len(columns)):
                key = key.bitwiseOR(F.shiftleft(F.shiftright(F.get(at, F.lit(n)), bit).bitwiseAND(F.lit(1).cast("long")), bit * len(columns) + n))
        return key

    return let(F.array(*places), interleaved)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, column_count) of each table."""
    made = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        made = one if made is None else made.unionByName(one)
    return made
