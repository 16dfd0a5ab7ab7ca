"""Per-group statistics, ranks and order statistics that hold for any group size.

A date holds one row per instrument, so the group size grows with the universe. No primitive
brings a group into one task, and each has one form at every size:

* statistics are partial aggregates, one row per group, joined back;
* quantiles are selected by counts in bins, narrowed to a few values that are counted one by one;
* ranks are counted in slices of about ``SLICE_ROWS`` rows, cut at approximate quantiles; a
  value that fills a slice is a slice of its own, ranked by its count alone. A group of fewer
  rows is one slice.

The primitives evaluate their input several times; ``stored`` makes that cheap.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import col

# Rows of one group that a task sorts, and the most slices of a group.
SLICE_ROWS, MOST_SLICES = 1_000_000, 200
# Files of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
# Accuracy of approximate quantiles: ranks are off by at most n / ACCURACY.
ACCURACY = 10_000
SALTS = 64
# Bins of one pass of a quantile, passes at most, and the values (and share of values) that a
# bracket may hold when it is counted value by value.
BINS, PASSES, FEW = 64, 4, 256
_MOST = 1.7976931348623157e308
_ENDS = (("n", F.count), ("lo", F.min), ("hi", F.max))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table in the shared folder and reading it back.

    The copy survives lost executors and, unlike a cached or checkpointed RDD, gives the
    optimizer file sizes and column pruning.
    """
    path = new_path(df.sparkSession)
    write_table(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet files; the shuffle files of the job go as soon as it has ended.

    Otherwise they stay until the driver happens to collect garbage, and a chain of jobs holds the
    shuffles of all on disk. ``DataFrameWriter`` does not heed the setting, an INSERT does.
    """
    spark, view = df.sparkSession, f"written_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    try:
        with _shuffles_removed(spark):
            spark.sql(f"INSERT OVERWRITE DIRECTORY '{place}' USING parquet SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers, _writers_lock = [], threading.Lock()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The first of the writers at work turns the setting on, the last one restores it."""
    with _writers_lock:
        _writers.append(spark.conf.get(_CLEANUP, "false") if not _writers else _writers[0])
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writers_lock:
            before = _writers.pop()
            if not _writers:
                spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a stored table; written unless it is one just as it was read or ``cheap``."""
    return df if getattr(df, "stored_at", None) else durable(df)


def cheap(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, row by row from the stored ``source`` and tables of the calendar: read again, not stored."""
    if getattr(source, "stored_at", None):
        df.stored_at = source.stored_at
    return df


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``durable`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checked(df: DataFrame) -> DataFrame:
    """A table stored and, where its files are small, marked for broadcast."""
    table = stored(df)
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster; the session's warehouse
    only for a local master where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/panelmill-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Attach aggregates of each group to its rows."""
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return df.join(checked(table), list(keys), "left")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based position inside each group; ``order`` must be total inside a group. An empty
    ``keys`` numbers the whole table. Rows are range partitioned on (keys, order), so a value
    that many rows share is spread as well."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The written copy pins the sampled range bounds: both reads below see the same slices.
    ranged = durable(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    counts = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(checked(offsets), [*keys, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_slice", "_local", "_before")
    )


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    averages: Mapping[str, str],
    numbers: Mapping[str, str] | None = None,
    counts: Mapping[str, str] | None = None,
    unique: Sequence[str] = ("code",),
) -> DataFrame:
    """Attach ranks of columns inside each group, ascending.

    ``averages`` maps an output to the column whose average-tie rank it is, ``numbers`` to the
    column whose 1-based position it is, ties by ``unique``, and ``counts`` to the column whose
    values it counts; ``unique`` tells the rows of a group apart. NULL values have no rank.
    """
    numbers, counts = numbers or {}, counts or {}
    values = list(dict.fromkeys([*averages.values(), *numbers.values()]))
    sizes = checked(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(v).alias(out) for out, v in counts.items()]))
    rows = df.join(sizes, list(keys), "left") if counts else df
    # Only groups of more than a slice have cut points; the others meet an empty table.
    large = F.broadcast(durable(sizes.filter(F.col("_rows") > SLICE_ROWS).select(*keys)))
    cuts = checked(df.join(large, list(keys), "left_semi").groupBy(*keys).agg(*[_cut_points(v).alias(f"_cuts{i}") for i, v in enumerate(values)]))
    rows = rows.drop("_rows").join(cuts, list(keys), "left")
    for i, v in enumerate(values):
        rows = rows.withColumn(f"_slice{i}", _slice_of(F.col(v), F.col(f"_cuts{i}")))
    held = checked(_slice_sizes(rows.filter(F.col("_cuts0").isNotNull()), keys, len(values)))
    lone = [not held.filter(F.exists(F.map_keys("_held"), _is_lone(i))).isEmpty() for i in range(len(values))]
    rows = rows.drop(*[f"_cuts{i}" for i in range(len(values))]).join(held, list(keys), "left")
    for i, _ in enumerate(values):
        place = F.struct(F.lit(i).alias("i"), F.col(f"_slice{i}").alias("s"))
        rows = rows.withColumn(f"_held{i}", F.try_element_at("_held", place))
    rows = rows.drop("_held")
    # Rows that need no order are spread: those of a lone value, and those without one.
    salt = F.pmod(F.hash(*unique), F.lit(SALTS))
    for i, v in enumerate(values):
        free = F.col(v).isNull() | (F.col(f"_slice{i}") % 2 == 1)
        rows = rows.withColumn(f"_part{i}", F.coalesce(f"_slice{i}", F.lit(-1)) * SALTS + F.when(free, salt).otherwise(0))
    for out, v in numbers.items():
        i = values.index(v)
        place = F.row_number().over(Window.partitionBy(*keys, f"_part{i}").orderBy(v, *unique))
        placed = F.when(F.col(v).isNotNull(), place + F.coalesce(F.col(f"_held{i}.below"), F.lit(0)))
        if not lone[i]:
            rows = rows.withColumn(out, placed)
            continue
        # Rows of a value that fills slices are numbered by ``unique`` alone, spread over tasks.
        alone = F.coalesce(F.col(f"_slice{i}") % 2 == 1, F.lit(False))
        rest = rows.filter(~alone).withColumn(out, placed)
        tied = with_row_number(rows.filter(alone), [*keys, v], [F.col(u) for u in unique], out)
        rows = rest.unionByName(tied.withColumn(out, F.col(out) + F.col(f"_held{i}.below")).select(*rest.columns))
    for out, v in averages.items():
        i = values.index(v)
        held, alone = F.col(f"_held{i}"), F.col(f"_slice{i}") % 2 == 1
        # Both ends of a run of ties come from one pass; a partition per value would be one a row.
        place = Window.partitionBy(*keys, f"_part{i}").orderBy(v)
        first, last = F.rank().over(place), F.count(F.lit(1)).over(place.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rank = F.when(alone, (held.n + 1) / 2.0).otherwise((first + last) / 2.0) + F.coalesce(held.below, F.lit(0))
        rows = rows.withColumn(out, F.when(F.col(v).isNotNull(), rank))
    return rows.drop(*[f"{name}{i}" for i in range(len(values)) for name in ("_slice", "_held", "_part")])


def _is_lone(column: int):
    return lambda place: (place["i"] == column) & (place["s"] % 2 == 1)


def _slice_sizes(rows: DataFrame, keys: Sequence[str], columns: int) -> DataFrame:
    """One row per group: a map from (column, slice) to its size and the rows below it; at most
    2 MOST_SLICES entries a column."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_slice{i}").alias("s")) for i in range(columns)]))
    sizes = rows.select(*keys, each.alias("e")).filter("e.s is not null").groupBy(*keys, "e").agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy(*keys).agg(F.collect_list(F.struct("e", "n")).alias("_all"))
    below = "aggregate(filter(_all, y -> y.e.i = x.e.i AND y.e.s < x.e.s), 0L, (t, y) -> t + y.n)"
    return lists.select(*keys, F.expr(f"map_from_entries(transform(_all, x -> struct(x.e, struct({below} AS below, x.n AS n))))").alias("_held"))


def _slice_of(value: Column, cuts: Column) -> Column:
    """Even between two cuts, odd on a cut."""
    under = F.size(F.filter(cuts, lambda cut: cut < value))
    place = F.when(cuts.isNull(), 0).otherwise(under * 2 + F.array_contains(cuts, value).cast("int"))
    return F.when(value.isNotNull(), place)


def _cut_points(value: str) -> Column:
    """Values that cut a group into slices of about SLICE_ROWS rows."""
    n = F.least(F.lit(MOST_SLICES), F.ceil(F.count(value) / SLICE_ROWS)).cast("int")
    points = F.percentile_approx(value, [k / MOST_SLICES for k in range(1, MOST_SLICES)], F.lit(ACCURACY))
    picked = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get(points, (k * MOST_SLICES / n).cast("int") - 1))
    return F.when(n > 1, F.array_sort(F.array_distinct(picked))).otherwise(F.slice(points, 1, 0))


def with_quantiles(
    df: DataFrame, keys: Sequence[str], quantiles: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Attach exact linearly interpolated quantiles: output -> (column, q)."""
    return df.join(checked(quantile_table(df, keys, quantiles)), list(keys), "left")


def quantile_table(df: DataFrame, keys: Sequence[str], quantiles: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``keys`` and the quantiles, one stored row per group.

    The values between a group's least and greatest are counted in BINS equal bins; the bins that
    hold the two wanted positions, cut to the values in them, are the next bracket, until a bracket
    holds few values. Those are counted one by one. Bins keep the order of the values, so the
    result is exact for any values; a badly placed bin only leaves more of them to count.
    """
    outs, wanted = list(quantiles), list(quantiles.values())
    columns = list(dict.fromkeys(v for v, _ in wanted))
    q = F.element_at(F.array(*[F.lit(float(q)) for _, q in wanted]), F.col("i") + 1)
    at = (F.col("n") - 1) * q
    low, high = F.floor(at), F.ceil(at)
    ends = df.groupBy(*keys).agg(*[f(v).cast("double").alias(f"_{n}{j}") for j, v in enumerate(columns) for n, f in _ENDS])
    facts = [x for i, (v, _) in enumerate(wanted) for x in (F.lit(i), *[F.col(f"_{n}{columns.index(v)}") for n, _ in _ENDS])]
    # n: values of the group, m: those in the bracket from lo to hi, below: those under it.
    start = ends.select(*keys, F.stack(F.lit(len(outs)), *facts).alias("i", "n", "lo", "hi")).filter("n > 0")
    brackets = stored(start.select(*keys, "i", "n", F.col("n").alias("m"), F.lit(0.0).alias("below"), "lo", "hi"))
    wide = (F.col("m") > FEW + F.col("n") / FEW) & (F.col("lo") < F.col("hi"))
    # Halves, so that the width of any two finite ends is finite.
    least, most = F.greatest("lo", F.lit(-_MOST)) / 2, F.least("hi", F.lit(_MOST)) / 2
    scaled = F.when(wide, F.try_divide(F.lit(float(BINS)), most - least))

    def cells(brackets: DataFrame) -> DataFrame:
        """The values inside their brackets: ``keys, i, v, from, scale``. The brackets of a group
        are one row, so a row of ``df`` meets a table of the calendar once."""
        names = ("lo", "hi", "from", "scale")
        facts = brackets.withColumns({"from": least, "scale": scaled})
        row = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"_{c}{i}") for i in range(len(outs)) for c in names]
        met = df.select(*keys, *columns).join(checked(facts.groupBy(*keys).agg(*row)), list(keys))
        parts = []
        for i, (v, _) in enumerate(wanted):
            x = F.col(v).cast("double")
            parts += [F.lit(i), F.when((x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")), x), F.col(f"_from{i}"), F.col(f"_scale{i}")]
        return met.select(*keys, F.stack(F.lit(len(outs)), *parts).alias("i", "v", "from", "scale")).filter("v is not null")

    for _ in range(PASSES):
        if brackets.filter(wide).isEmpty():
            break
        place = F.greatest(F.least((F.col("v") / 2 - F.col("from")) * F.col("scale"), F.lit(float(BINS))), F.lit(-1.0))
        counted = cells(brackets).groupBy(*keys, "i", F.floor(place).cast("int").alias("bin")).agg(
            F.count(F.lit(1)).cast("double").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        counted = counted.join(checked(brackets).select(*keys, "i", "n", "below"), [*keys, "i"])
        upto = Window.partitionBy(*keys, "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("end", F.col("below") + F.sum("m").over(upto)).withColumn("start", F.col("end") - F.col("m"))
        held = placed.filter(((F.col("start") <= low) & (low < F.col("end"))) | ((F.col("start") <= high) & (high < F.col("end"))))
        brackets = stored(
            held.groupBy(*keys, "i").agg(
                F.max("n").alias("n"), F.sum("m").alias("m"), F.min("start").alias("below"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
            )
        )
    counted = cells(brackets).groupBy(*keys, "i", "v").agg(F.count(F.lit(1)).alias("m"))
    counted = counted.join(checked(brackets).select(*keys, "i", "n", "below"), [*keys, "i"])
    upto = Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("end", F.col("below") + F.sum("m").over(upto))

    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("end") - F.col("m") <= k) & (k < F.col("end")), F.col("v")))

    lo, hi = value_at(low), value_at(high)
    picks = placed.groupBy(*keys, "i").agg((lo + (hi - lo) * F.max(at - low)).alias("x"))
    return durable(picks.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(out) for i, out in enumerate(outs)]))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "_rank"
) -> DataFrame:
    """First n rows per group. Spark turns the filter into a group limit that each map
    task applies before the shuffle, so a hot group ships n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def keep_last(df: DataFrame, keys: Sequence[str], *seq: Column | str) -> DataFrame:
    """One row per key: the last by ``seq``."""
    order = [col(s).desc_nulls_last() for s in seq]
    return top_per_group(df, keys, order, 1).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], *seq: Column | str) -> DataFrame:
    """One row per key: the first by ``seq``."""
    return top_per_group(df, keys, [col(s).asc_nulls_last() for s in seq], 1).drop("_rank")
