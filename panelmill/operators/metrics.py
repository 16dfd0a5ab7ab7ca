"""Performance metrics of equity curves, one set per scenario key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.groups import top_per_group
from .risk import series, with_drawdown, with_returns

ANNUAL = 252


def curve_metrics(curve: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Annual return and volatility, Sharpe, deepest drawdown, win rate (K1)."""
    df = with_drawdown(with_returns(curve, "equity", "_r", keys), "equity", keys)
    std = F.stddev_pop("_r")
    growth = F.max_by("equity", "date") / F.min_by("equity", "date")
    return df.groupBy(*keys).agg(
        (F.pow(growth, F.lit(float(ANNUAL)) / F.count("_r")) - 1).alias("annual_return"),
        (std * math.sqrt(ANNUAL)).alias("annual_volatility"),
        F.when(std > 0, F.avg("_r") / std * math.sqrt(ANNUAL)).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))).alias("win_rate"),
    )


def paired_curves(curve: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Inner join on date with both one-session returns."""
    both = curve.select(*keys, "date", "equity").join(
        F.broadcast(benchmark.select("date", "benchmark")), "date"
    )
    return with_returns(with_returns(both, "equity", "r", keys), "benchmark", "b", keys)


def benchmark_metrics(curve: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Benchmark return, beta, alpha, information ratio (K2, K8)."""
    df = paired_curves(curve, benchmark, keys)
    var = F.var_pop("b")
    beta = F.when(var > 0, F.covar_pop("r", "b") / var).otherwise(0.0)
    growth = F.max_by("benchmark", "date") / F.min_by("benchmark", "date")
    active = F.col("r") - F.col("b")
    spread = F.stddev_pop(active)
    df = df.groupBy(*keys).agg(
        (F.pow(growth, F.lit(float(ANNUAL)) / F.count("b")) - 1).alias("benchmark_return"),
        beta.alias("beta"),
        F.avg("r").alias("_r"),
        F.avg("b").alias("_b"),
        F.when(spread > 0, F.avg(active) / spread * math.sqrt(ANNUAL)).alias("information_ratio"),
        F.count(F.lit(1)).alias("observations"),
    )
    return df.withColumn("alpha", (F.col("_r") - F.col("beta") * F.col("_b")) * ANNUAL).drop("_r", "_b")


def full_metrics(curve: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """K1 and K2 side by side, with the excess return."""
    df = curve_metrics(curve, keys).join(benchmark_metrics(curve, benchmark, keys), list(keys))
    return df.withColumn("excess_return", F.col("annual_return") - F.col("benchmark_return"))


def period_returns(
    curve: DataFrame, benchmark: DataFrame, unit: str = "month", keys: Sequence[str] = ("scenario",)
) -> DataFrame:
    """First-to-last return inside each calendar year or month (K3)."""
    label = F.date_format("date", "yyyy" if unit == "year" else "yyyy-MM")
    df = curve.select(*keys, "date", "equity").join(F.broadcast(benchmark.select("date", "benchmark")), "date")

    def inside(c: str):
        return F.max_by(c, "date") / F.min_by(c, "date") - 1

    df = df.groupBy(*keys, label.alias(unit)).agg(
        inside("equity").alias("strategy_return"), inside("benchmark").alias("benchmark_return")
    )
    return df.withColumn("excess_return", F.col("strategy_return") - F.col("benchmark_return"))


def drawdown_periods(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ()) -> DataFrame:
    """Every peak-to-recovery drawdown (K5): an equal or higher value starts a new peak."""
    w = series(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = curve.withColumns(
        {
            "_i": F.row_number().over(w),
            "_peak": F.coalesce(F.col(value) >= F.max(value).over(before), F.lit(True)),
        }
    )
    df = df.withColumn("_g", F.sum(F.col("_peak").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = df.groupBy(*keys, "_g").agg(
        F.min("date").alias("peak_date"),
        F.min("_i").alias("_from"),
        F.max("_i").alias("_to"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("date", F.struct(F.col(value), F.col("_i"))).alias("trough_date"),
        (F.min(value) / F.min_by(value, "_i") - 1).alias("drawdown"),
    )
    order = Window.partitionBy(*keys).orderBy("_g")
    groups = groups.withColumns(
        {"recovery_date": F.lead("peak_date").over(order), "_back": F.lead("_from").over(order)}
    )
    return groups.filter(F.col("_n") > 1).select(
        *keys, "peak_date", "trough_date", "recovery_date", "drawdown",
        (F.coalesce("_back", "_to") - F.col("_from")).alias("duration_days"),
    )


def worst_holding_periods(
    curve: DataFrame, bars: int = 20, limit: int = 5, keys: Sequence[str] = ("scenario",)
) -> DataFrame:
    """The n worst k-bar holding windows per scenario (K6)."""
    if bars < 1 or limit < 1:
        raise ValueError("bars and limit must be at least 1")
    w = series(keys)
    df = curve.select(
        *keys, F.lag("date", bars).over(w).alias("start_date"), F.col("date").alias("end_date"),
        F.lit(bars).alias("holding_days"), (ratio("equity", F.lag("equity", bars).over(w)) - 1).alias("return"),
    ).filter(F.col("return").isNotNull())
    return top_per_group(df, list(keys), [F.col("return"), F.col("end_date")], limit).drop("_rank")


def pnl_decomposition(curve: DataFrame, market: DataFrame, factor: DataFrame) -> DataFrame:
    """Daily profit split in market, factor and selection (K7).

    ``market``: ``date, market_return``; ``factor``: ``date, factor_return``.
    """
    prior = F.lag("equity").over(series())
    df = curve.select("date", "equity", prior.alias("_prior"))
    df = df.join(F.broadcast(market), "date", "left").join(F.broadcast(factor), "date", "left")

    def effect(name: str):
        return F.coalesce(F.col("_prior") * F.coalesce(name, F.lit(0.0)), F.lit(0.0))

    df = df.select(
        "date",
        F.coalesce(F.col("equity") - F.col("_prior"), F.lit(0.0)).alias("portfolio_pnl"),
        effect("market_return").alias("market_effect"),
        effect("factor_return").alias("factor_effect"),
    )
    return df.withColumn(
        "selection_effect", F.col("portfolio_pnl") - F.col("market_effect") - F.col("factor_effect")
    )


def benchmark_comparison(
    curve: DataFrame, indexes: DataFrame, expected: Sequence[str]
) -> DataFrame:
    """Strategy against named indexes; a missing index stays ``unavailable`` (K8).

    ``curve``: ``date, equity``; ``indexes``: ``index_code, date, close``.
    """
    spark = curve.sparkSession
    names = spark.createDataFrame([(n,) for n in expected], "benchmark string")
    keys = ("index_code",)
    common = curve.select("date", "equity").join(indexes, "date")
    w = Window.partitionBy("index_code").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    scaled = common.withColumn(
        "benchmark", F.first("equity").over(w) * F.col("close") / F.first("close").over(w)
    )
    rel = with_returns(with_returns(scaled, "equity", "r", keys), "benchmark", "b", keys)
    rel = with_drawdown(rel, "benchmark", keys)
    var, active = F.var_pop("b"), F.col("r") - F.col("b")
    std, spread = F.stddev_pop("b"), F.stddev_pop(active)
    growth = F.max_by("benchmark", "date") / F.min_by("benchmark", "date")
    stats = rel.groupBy("index_code").agg(
        (F.pow(growth, F.lit(float(ANNUAL)) / F.count("b")) - 1).alias("return"),
        F.when(std > 0, F.avg("b") / std * math.sqrt(ANNUAL)).alias("sharpe"),
        F.min("drawdown").alias("drawdown"),
        F.when(var > 0, F.covar_pop("r", "b") / var).otherwise(0.0).alias("beta"),
        F.avg("r").alias("_r"),
        F.avg("b").alias("_b"),
        F.when(spread > 0, F.avg(active) / spread * math.sqrt(ANNUAL)).alias("information_ratio"),
        F.count(F.lit(1)).alias("observations"),
    ).filter(F.col("observations") >= 2)
    df = F.broadcast(names).join(stats, F.col("benchmark") == F.col("index_code"), "left")
    return df.select(
        "benchmark",
        F.when(F.col("index_code").isNull(), "unavailable").otherwise("available").alias("status"),
        "return", "sharpe", "drawdown",
        ((F.col("_r") - F.col("beta") * F.col("_b")) * ANNUAL).alias("alpha"),
        "beta", "information_ratio",
        F.coalesce("observations", F.lit(0)).alias("observations"),
    )


def walk_forward_table(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Equity and rebased benchmark with their returns, gaps as 0 (K9)."""
    w = series()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = curve.join(F.broadcast(benchmark.select("date", "close")), "date")
    df = df.withColumn(
        "benchmark", F.first("equity").over(whole) * F.col("close") / F.first("close").over(whole)
    )

    def change(c: str):
        return F.coalesce(ratio(c, F.lag(c).over(w)) - 1, F.lit(0.0))

    return df.withColumns(
        {"portfolio_return": change("equity"), "benchmark_return": change("benchmark")}
    ).drop("close")


def compare_portfolios(metrics: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """One row per named portfolio over the same metrics (P10)."""
    frames = [df.select(F.lit(name).alias("portfolio"), *columns) for name, df in metrics.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
