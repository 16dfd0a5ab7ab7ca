"""Tables of the engine: bars, features, scores, decision log and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.groups import durable, keep_last, path_exists


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars kept as one file per code, the code being the six-digit file stem."""
    df = spark.read.parquet(folder)
    code = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{6})\.parquet$", 1)
    return df.select(code.alias("code"), *[F.col(c) for c in df.columns if c != "code"]).filter(F.col("code") != "")


def read_benchmark(indexes: DataFrame, index_code: str) -> DataFrame:
    """One index from the table of index levels (S2); the filter reaches the scan."""
    return indexes.filter(F.col("index_code") == index_code).select("date", "close")


def write_panel(df: DataFrame, path: str, date: str = "date") -> None:
    """Panel partitioned by year, one task per year and code range (S3).

    The year alone would send a whole year to one task; code spreads it.
    """
    (
        df.withColumn("year", F.year(date))
        .repartitionByRange(F.col("year"), F.col("code"))
        .sortWithinPartitions("code", date)
        .write.mode("overwrite").partitionBy("year").parquet(path)
    )


def read_panel(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Panel by year; the year filter prunes partitions (S3)."""
    df = spark.read.parquet(path)
    return (df if years is None else df.filter(F.col("year").isin(*years))).drop("year")


def merge_bars(stored: DataFrame, fetched: DataFrame, *seq: str) -> DataFrame:
    """Stored and fetched bars; the fetched row wins per (code, date) (S8), the last by
    ``seq`` where it was fetched more than once."""
    return upsert(stored, fetched, ["code", "date"], *seq)


def request_start(universe: DataFrame, stored: DataFrame, wanted: str) -> DataFrame:
    """First date to request per code (S8): the day after the last stored one, or the
    wanted start when nothing is stored or the leading history is missing."""
    spans = stored.groupBy("code").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    start = F.lit(wanted).cast("date")
    df = universe.select("code").join(spans, "code", "left")
    tail = F.date_add("_hi", 1)
    return df.select(
        "code", F.when(F.col("_lo").isNull() | (F.col("_lo") > start), start).otherwise(tail).alias("start")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *seq: str) -> DataFrame:
    """Existing and incoming rows; the incoming one wins per key (S9), the last by ``seq``
    where a key comes in more than once. ``seq`` may be columns of ``incoming`` alone."""
    newest = keep_last(incoming, keys, *seq) if seq else incoming
    newest = newest.select(*existing.columns).withColumn("_seq", F.lit(1))
    return keep_last(existing.withColumn("_seq", F.lit(0)).unionByName(newest), keys, "_seq").drop("_seq")


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], seq: Sequence[str], partition: str, by: Column
) -> None:
    """Upsert into a stored table, rewriting only the partitions that ``incoming`` touches.

    ``by`` derives the column ``partition`` from key columns, so a key never changes its
    partition. The touched partitions are read, merged and put in place by a dynamic
    overwrite; files of all others stay as they are. Running it again changes nothing.
    """
    delta = durable(incoming.withColumn(partition, by))
    touched = [r[0] for r in delta.select(partition).distinct().collect()]  # as many as partitions
    if not touched:
        return
    if not path_exists(spark, path):
        keep_last(delta, keys, *seq).drop(*seq).write.partitionBy(partition).parquet(path)
        return
    stored = spark.read.parquet(path)
    hit = stored.filter(F.col(partition).isin([t for t in touched if t is not None]) | F.lit(None in touched) & F.col(partition).isNull())
    # Written aside first: the files being replaced are those being read.
    merged = durable(upsert(hit, delta, keys, *seq))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_ledger(df: DataFrame, path: str, date: str = "date") -> None:
    """Replace the days present in ``df`` and keep the others (S10, ST5)."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(date).parquet(path)
    )


def write_statistics(df: DataFrame, path: str) -> None:
    """Small statistics table as CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temp views for ad-hoc SQL over stored tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def check_contract(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Columns of an input table in contract order, or an error."""
    require_columns(df, *required)
    return df.select(*required)
