"""Market data derived from trade, order and supplier tables.

Each supplier is an instrument, each line item a trade, each ISO week a session. Unit
prices are compressed to ``100 + price / 1000`` so that weekly returns stay in the range
of listed equities and compounded curves keep their precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Shares outstanding of every instrument. A power of two keeps turnover, and the ties in
# its rolling means, exact.
SHARES = 1024.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad_code(key: Column | str) -> Column:
    """Zero-fill to six characters without truncating longer codes."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def week(ts: Column | str) -> Column:
    """Monday of the week, by date arithmetic (no time zone conversion per row)."""
    day = F.col(ts).cast("date")
    return F.date_sub(day, F.weekday(day))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, date, price, quantity, amount and a total order inside a week."""
    return trades_of(table(spark, sf_dir, "lineitem"))


# A trade's place in its week as two longs, joined to one decimal of 38 digits: microseconds and
# the leading digits of the order above its last LOW_ORDER digits, the line and the part. It keeps the
# buffers of min_by and max_by fixed in width, so they stay in the hash aggregate and combine
# before the shuffle. Orders may have 12 digits, lines 2 and parts 11.
LOW_ORDER, LINE_DIGITS, PART_DIGITS = 5, 2, 11
LOW_DIGITS = LOW_ORDER + LINE_DIGITS + PART_DIGITS


def trades_of(lines: DataFrame) -> DataFrame:
    """Trades of order lines; a line without quantity has no price."""
    since = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(week("l_shipdate").cast("timestamp"))
    order, head = F.col("l_orderkey").cast("long"), 10**LOW_ORDER
    high = since * F.lit(10**7) + F.floor(order / head)
    low = ((order % head) * F.lit(10**LINE_DIGITS) + F.col("l_linenumber")) * F.lit(10**PART_DIGITS) + F.col("l_partkey")
    seq = (high.cast("decimal(19,0)") * F.lit(10**LOW_DIGITS).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")
    return lines.select(
        F.col("l_suppkey").alias("supplier"),
        week("l_shipdate").alias("date"),
        (F.lit(100.0) + F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")) / 1000.0).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        seq.alias("seq"),
    )


def bars_from_trades(ticks: DataFrame, key: str = "code") -> DataFrame:
    """OHLCV bars (S15): one partial aggregate and one shuffle on (key, date). Prices come
    from the trades that have one."""
    priced = F.when(F.col("price").isNotNull(), F.col("seq"))
    return ticks.groupBy(key, "date").agg(
        F.min_by("price", priced).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", priced).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").alias("amount"),
        (F.sum("quantity") / SHARES).alias("turnover"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars; lines are grouped by the integer key and the code is padded after."""
    df = bars_from_trades(trades(spark, sf_dir), "supplier")
    return df.withColumn("supplier", pad_code("supplier")).withColumnRenamed("supplier", "code")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with at least one trade, from the ship date column alone."""
    return table(spark, sf_dir, "lineitem").select(week("l_shipdate").alias("date")).distinct()


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly index level: ``1000 + mean order value / 1000``. One row per session."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(week("o_orderdate").alias("date"))
        .agg((F.lit(1000.0) + F.avg("o_totalprice") / 1000.0).alias("close"))
    )


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named index levels, one per order priority: ``index_code, date, close``."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("index_code"), week("o_orderdate").alias("date"))
        .agg((F.lit(1000.0) + F.avg("o_totalprice") / 1000.0).alias("close"))
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, industry, sector from supplier, nation and region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("sector")
    )
    # nation and region are fixed-size dimensions (25 and 5 rows).
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(
        F.broadcast(places), supplier.s_nationkey == places.n_nationkey, "left"
    ).select(
        pad_code("s_suppkey").alias("code"),
        F.col("s_name").alias("name"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
    )


def market_caps(panel: DataFrame) -> DataFrame:
    """Point-in-time capitalisation: price times cumulative traded volume."""
    run = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn("market_cap", F.col("close") * F.sum("volume").over(run))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly figures per code, usable 30 days after the month end."""
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            pad_code("l_suppkey").alias("code"),
            F.date_trunc("month", "l_shipdate").cast("date").alias("month"),
        )
        .agg(
            F.sum("l_extendedprice").alias("gross"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        )
    )
    w = Window.partitionBy("code").orderBy("month")
    return monthly.select(
        "code",
        F.date_add(F.last_day("month"), 30).alias("available_date"),
        (F.col("net") / F.col("gross")).alias("roe"),
        (F.col("net") / F.lag("net").over(w) - 1).alias("profit_growth"),
        (F.col("gross") / F.lag("gross").over(w) - 1).alias("revenue_growth"),
    )
