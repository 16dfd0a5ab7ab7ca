"""Streaming bars: tick aggregation, idempotent ingest, duplicate suppression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.groups import durable, keep_first, keep_last, new_path, path_exists


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


# Digits of a tick's number beside its microsecond: (ts, seq) as one decimal keeps the buffers
# of min_by and max_by fixed in width, and the partial aggregate hashed.
SEQ_DIGITS = 19


def tick_order(ts: str = "ts", seq: str = "seq") -> Column:
    return (F.unix_micros(ts).cast("decimal(38,0)") * F.lit(str(10**SEQ_DIGITS)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(seq)


def tumbling_bars(ticks: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """OHLCV per code and window, each emitted once the watermark passes its end; ticks of a
    window that is closed are dropped (ST2, ``late_ticks`` sets them aside).

    ``ticks``: ``code, ts, seq, price, quantity``; ``seq`` orders ticks of one instant. The
    partial aggregate runs before the shuffle, so a hot code costs one row per task and
    window, and state holds open windows only.
    """
    order = tick_order()
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "code")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"),
            F.sum(F.col("price") * F.col("quantity")).alias("amount"),
        )
        .select(F.col("w.start").alias("start"), "code", "open", "high", "low", "close", "volume", "amount")
    )


def sliding_mean(ticks: DataFrame, length: str = "3 days", slide: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Mean price per code over sliding windows, each emitted once it is closed (ST2)."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide).alias("w"), "code")
        .agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("ticks"))
        .select(F.col("w.start").alias("start"), "code", "mean_price", "ticks")
    )


def late_ticks(path: str, length: str = "1 day", late: str = "2 hours") -> Callable[[DataFrame, int], None]:
    """A batch writer that sets aside ticks whose window was closed when they came (ST2).

    Keeps the newest instant of every batch under ``path/marks``; the bound of a batch is the
    newest of those before it. Late ticks go to ``path/late``. A repeated batch replaces its
    own folders and reads only earlier marks, so it decides alike.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = durable(batch)
        marks = f"{path}/marks"
        if path_exists(spark, marks):
            seen = spark.read.option("basePath", marks).parquet(f"{marks}/batch=*").filter(F.col("batch") < number)
            bound = seen.agg(F.max("ts")).first()[0]
            if bound is not None:
                closed = F.window("ts", length).end <= F.lit(bound) - F.expr(f"INTERVAL {late}")
                batch.filter(closed).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max("ts").alias("ts")).filter("ts is not null").write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return write


def set_aside(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ticks that ``late_ticks`` set aside so far."""
    if not path_exists(spark, f"{path}/late"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/late/batch=*")


def first_arrivals(path: str, keys: Sequence[str], seq: Sequence[str], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the first event of every key for good: a rerun of a day, even
    a year later, adds nothing (ST5).

    The ledger under ``path`` is partitioned by the day of the event, which is part of its
    key. A batch meets only the stored keys of its own days, by a pruned scan and an anti
    join; ``seq`` orders events of one key inside a batch. A repeated batch looks past its
    own rows and replaces them.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = durable(keep_first(batch.withColumn("_day", F.to_date(ts)), ["_day", *keys], *seq))
        if path_exists(spark, path):
            days = [r[0] for r in fresh.select("_day").distinct().collect()]  # as many as calendar days
            stored = spark.read.parquet(path).filter(F.col("_day").isin(days) & (F.col("_batch") < number))
            fresh = durable(fresh.join(stored.select("_day", *keys), ["_day", *keys], "left_anti"))
        (
            fresh.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("_day", "_batch").parquet(path)
        )

    return write


def deliver(parts: Sequence[DataFrame], start: Callable[[DataFrame], None], files: str) -> None:
    """Land each part in ``files`` and process what has arrived, one after the other."""
    for part in parts:
        part.write.mode("append").parquet(files)
        start(file_stream(part.sparkSession, files, part.schema))


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None
) -> StreamingQuery:
    """Process everything available and stop; the finished query has the progress of its batches."""
    spark = stream.sparkSession
    place = checkpoint or new_path(spark)
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", place)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch replaces its own folder, so a repeated batch does not double rows."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def table_of(stream: DataFrame) -> DataFrame:
    """Result of a stream, run over what is available, as a stored table."""
    spark = stream.sparkSession
    path = new_path(spark)
    run_available(stream, batch_writer(path))
    df = spark.read.schema(stream.schema).parquet(path)
    return df.select(*stream.columns)


def emitted(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that the stream ``build(landing)`` emits over a sequence of deliveries: every
    delivery is a run of the same query, which goes on from its checkpoint."""
    spark = parts[0].sparkSession
    files, out, state = (new_path(spark) for _ in range(3))
    deliver(parts, lambda stream: run_available(build(stream), batch_writer(out), checkpoint=state), files)
    shape = build(file_stream(spark, files, parts[0].schema))
    return spark.read.schema(shape.schema).parquet(f"{out}/batch=*").select(*shape.columns)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append arrivals to a log, one folder per batch (ST1).

    Writing a batch again overwrites the same folder, so the log is exact after a restart.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    run_available(stream, write, checkpoint=checkpoint)


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """Current bars of an ingest log: the latest arrival wins per (code, date) (ST1, S8)."""
    log = spark.read.parquet(path)
    return keep_last(log, ["code", "date"], "batch").drop("batch")
