"""Shared pieces of the operators: work tables, spread numbering, hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.groups import write_table

U64 = np.uint64
WORD_BREAKS = b" \t\n\x0b\x0c\r"  # the white space that separates words: x20 and x09-x0D


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local
    master uses the warehouse; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the work folder, removed when the application ends."""
    path = f"{work_folder(spark)}/llm-{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the work folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def swept(df: DataFrame) -> DataFrame:
    """``saved``, and the shuffle files of the job are removed as soon as it has ended."""
    spark = df.sparkSession
    path = new_path(spark)
    write_table(df, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``saved`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """0-based position inside each group of ``keys`` without bringing a group into one task:
    a range partitioning on (keys, order), positions inside each slice, offsets of slices.

    Rows that tie in (keys, order) must be interchangeable. The written copy pins the sampled
    bounds, so both reads see the same slices.
    """
    n = buckets(df.sparkSession)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = saved(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
        .sortWithinPartitions(*keys, *order)
    )
    counts = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # (keys, slice) pairs: at most one per slice more than there are keys.
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    return (
        ranged.withColumn("_at", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_at") + F.col("_before")).cast("long"))
        .drop("_slice", "_at", "_before")
    )


# --- hashing of byte ranges, whole batches at a time ---------------------------------------

# The finalizer of MurmurHash3 (64 bit) and an odd multiplier.
MIX_1, MIX_2, MIX_SHIFT = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 33
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values; returns a new array."""
    s = U64(MIX_SHIFT)
    x = x ^ (x >> s)
    x *= U64(MIX_1)
    x ^= x >> s
    x *= U64(MIX_2)
    x ^= x >> s
    return x


def power(e: int, base: int = BASE) -> np.uint64:
    return U64(pow(base, e, 1 << 64))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive codes, built by doubling: the name of 2h codes comes from
    the names of h codes at offset 0 and h. Unmixed; position i names codes[i:i+n]."""
    if len(codes) < n:
        return np.empty(0, U64)
    level, size, parts, left = codes, 1, [], n
    while True:
        if n & size:
            parts.append((size, level))
            left -= size
        if not left:
            break
        level = level[:-size] * power(size) + level[size:]
        size *= 2
    out, got = None, 0
    for size, level in reversed(parts):
        here = level[got : got + len(codes) - n + 1]
        out = here.copy() if out is None else out * power(size) + here
        got += size
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    if size < width:
        rest = width - size
        x = pick(x[:-rest], x[rest:])
    return x


class RangeHashes:
    """Hashes of byte ranges of one buffer; equal ranges agree wherever they stand.

    Running sums in powers of an odd base; the base has an inverse modulo 2**64, which moves
    every range to the origin.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _power_table(BASE, n + 1)[:n], out=self.total[1:])
        self.inverse = _power_table(pow(BASE, -1, 1 << 64), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        value = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mixed(value + (ends - starts).astype(U64) * U64(MIX_2) + U64(salt))


def word_ranges(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``breaks`` (a table of 256 flags)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line break after every text, and where each text starts (and the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


_TABLES: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have)
        _TABLES[base] = have
    return have


def text_slices(ids: Iterable, texts: Iterable[bytes], size: int, most: int | None = None):
    """Groups of whole texts of about ``size`` bytes, ``most`` texts at most: (ids, texts)."""
    got, some_ids, some = 0, [], []
    for i, t in zip(ids, texts, strict=True):
        some_ids.append(i)
        some.append(t)
        got += len(t)
        if got >= size or len(some) == most:
            yield some_ids, some
            got, some_ids, some = 0, [], []
    if some:
        yield some_ids, some


# --- connected components -------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); the component is its smallest node.

    Alternating rounds: every node takes the least label around it, then the label of its
    label. A hub is a group-by key with map-side combining, never a collected list.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("least"))
        )
        nearer = labels.join(around, "node").select(
            "node", "component", F.least("component", "least").alias("nearer")
        )
        far = labels.select(F.col("node").alias("nearer"), F.col("component").alias("further"))
        after = saved(
            nearer.join(far, "nearer").select(
                "node", F.least("nearer", "further").alias("component"), (F.least("nearer", "further") < F.col("component")).alias("moved")
            )
        )
        done = after.filter("moved").isEmpty()
        discard(labels)
        labels = after.drop("moved")
        labels.work_path = after.work_path
        if done:
            discard(both)
            return labels
