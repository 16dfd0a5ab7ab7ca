"""Predictive statistics of factors: IC, spreads, stability, importance."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, require_columns, safe_corr
from ..functions.groups import discard, durable, with_ranks

# Values ranked at once: factors are ranked together as long as they have no more.
RANKED_AT_ONCE = 10_000_000


def daily_ic(
    panel: DataFrame,
    factors: Sequence[str],
    target: str,
    min_names: int = 1,
    quantile: float = 0.2,
) -> DataFrame:
    """``date, factor, ic, rank_ic, spread, observations`` (A1, A5).

    A long panel serves several factors, so they are ranked together; a large panel's are ranked in
    turns, as a turn's shuffles are gone when the next begins. ``spread`` is the mean target of the
    top ceil(n q) names minus that of the bottom ones, ties by code.
    """
    require_columns(panel, "date", "code", target, *factors)
    names = [target, *factors]
    own = None if getattr(panel, "stored_at", None) else durable(panel.select("date", "code", *names))
    known = (panel if own is None else own).filter(F.col(target).isNotNull())
    count = known.count()
    turn = max(1, min(len(factors), RANKED_AT_ONCE // max(1, count)))
    if turn == len(factors):
        return _daily_ic(known, list(factors), target, min_names, quantile)
    parts = [durable(_daily_ic(known, list(factors[i : i + turn]), target, min_names, quantile)) for i in range(0, len(factors), turn)]
    if own is not None:
        discard(own)
    return functools.reduce(DataFrame.unionByName, parts)


def _daily_ic(known: DataFrame, factors: Sequence[str], target: str, min_names: int, quantile: float) -> DataFrame:
    # Factors travel as small numbers: their names would be compared in every sort.
    keys, names = ["date", "_f"], F.array(*[F.lit(f) for f in factors])
    pairs = [x for i, f in enumerate(factors) for x in (F.lit(i), F.col(f).cast("double"))]
    long = known.select("date", "code", target, F.stack(F.lit(len(factors)), *pairs).alias("_f", "value")).filter("value is not null")
    df = with_ranks(long, keys, {"_rx": "value", "_ry": target}, {"_pos": "value"}, {"_n": "value"})
    size = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(quantile)))
    top = F.avg(F.when(F.col("_pos") > F.col("_n") - size, F.col(target)))
    bottom = F.avg(F.when(F.col("_pos") <= size, F.col(target)))
    return (
        df.groupBy(*keys)
        .agg(
            safe_corr("value", target).alias("ic"),
            safe_corr("_rx", "_ry").alias("rank_ic"),
            (top - bottom).alias("spread"),
            F.count(F.lit(1)).alias("observations"),
        )
        .filter(F.col("observations") >= min_names)
        .select("date", F.element_at(names, F.col("_f") + 1).alias("factor"), "ic", "rank_ic", "spread", "observations")
    )


def ic_summary(daily: DataFrame, min_samples: int = 2) -> DataFrame:
    """Mean, sample deviation, ICIR, t-stat and counts per factor (A2)."""
    table = daily.groupBy("factor").agg(
        F.count("ic").alias("samples"),
        F.avg("ic").alias("_mean"),
        F.stddev_samp("ic").alias("_std"),
        F.avg("rank_ic").alias("_rank"),
    )
    enough = F.col("samples") >= min_samples
    mean, std = F.when(enough, F.col("_mean")), F.when(enough, F.col("_std"))
    icir = F.when(std > 0, mean / std)
    return table.select(
        "factor",
        mean.alias("ic_mean"),
        std.alias("ic_std"),
        F.when(enough, F.col("_rank")).alias("rank_ic_mean"),
        icir.alias("icir"),
        (icir * F.sqrt(F.col("samples"))).alias("t_stat"),
        "samples",
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
    )


def spread_summary(daily: DataFrame) -> DataFrame:
    """Mean top-minus-bottom return and share of positive dates (A5)."""
    usable = daily.filter(F.col("observations") >= 2)
    return usable.groupBy("factor").agg(
        F.avg("spread").alias("average_return"),
        F.avg((F.col("spread") > 0).cast("double")).alias("win_rate"),
    )


def factor_analysis(daily: DataFrame, cover: DataFrame, min_samples: int = 2) -> DataFrame:
    """IC summary, coverage and spreads side by side, one row per factor."""
    return (
        ic_summary(daily, min_samples)
        .join(cover.select("factor", "coverage_pct", "nan_ratio", "valid_samples"), "factor", "left")
        .join(spread_summary(daily), "factor", "left")
    )


def yearly_ic(daily: DataFrame) -> DataFrame:
    """Mean IC per factor and calendar year (A4)."""
    return daily.groupBy("factor", F.year("date").alias("year")).agg(
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.count(F.lit(1)).alias("observations"),
    )


def evaluated_only(daily: DataFrame, min_names: int) -> DataFrame:
    """Dates with a defined IC and a large enough cross-section."""
    return daily.filter((F.col("observations") >= min_names) & F.col("ic").isNotNull())


def professional_summary(
    daily: DataFrame, horizon: int = 20, min_names: int = 20, min_samples: int = 20
) -> DataFrame:
    """Summary with annualised spread and yearly sign stability (A3, A4)."""
    used = evaluated_only(daily, min_names)
    base = ic_summary(used, min_samples)
    spread = used.groupBy("factor").agg(F.avg("spread").alias("_spread"))
    direction = base.select("factor", F.signum("ic_mean").alias("_dir"))
    stable = (
        yearly_ic(used)
        .join(direction, "factor")
        .groupBy("factor")
        .agg(F.avg((F.signum("ic_mean") == F.col("_dir")).cast("double")).alias("_agree"), F.first("_dir").alias("_dir"))
        .select("factor", F.when(F.col("_dir") != 0, F.col("_agree")).alias("stability"))
    )
    m = F.when(F.col("status") == "ok", F.col("_spread"))
    annual = F.when(m > -1, F.pow(1 + m, F.lit(252.0 / horizon)) - 1)
    return (
        base.join(spread, "factor", "left")
        .join(stable, "factor", "left")
        .withColumn("annualized_long_short_return", annual)
        .drop("_spread")
    )


def prediction_ic(
    predictions: DataFrame, prediction: str, label: str, min_names: int = 5
) -> DataFrame:
    """One row: mean daily IC and rank IC of a model and the dates counted."""
    panel = predictions.select("date", "code", F.col(prediction).alias("prediction"), F.col(label).alias("_label"))
    daily = evaluated_only(daily_ic(panel, ["prediction"], "_label"), min_names)
    return daily.agg(
        F.avg("ic").alias("prediction_ic"),
        F.avg("rank_ic").alias("prediction_rank_ic"),
        F.count(F.lit(1)).alias("prediction_observations"),
    )


def group_exposure(holdings: DataFrame, group: str = "industry") -> DataFrame:
    """Weight per date and group."""
    return holdings.groupBy("date", group).agg(F.sum("weight").alias("portfolio_weight"))


def equal_weight_shares(members: DataFrame, group: str = "industry") -> DataFrame:
    """Share of eligible names per date and group."""
    counts = members.groupBy("date", group).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("date").agg(F.sum("_n").alias("_all"))
    return counts.join(totals, "date").select(
        "date", group, ratio("_n", "_all").alias("benchmark_weight")
    )


def active_exposure(portfolio: DataFrame, benchmark: DataFrame, group: str = "industry") -> DataFrame:
    """Full outer join of both sides, gaps are 0."""
    df = portfolio.join(benchmark, ["date", group], "full_outer").select(
        "date", group,
        F.coalesce("portfolio_weight", F.lit(0.0)).alias("portfolio_weight"),
        F.coalesce("benchmark_weight", F.lit(0.0)).alias("benchmark_weight"),
    )
    return df.withColumn("active_weight", F.col("portfolio_weight") - F.col("benchmark_weight"))


def mean_importance(importances: DataFrame) -> DataFrame:
    """Average importance of each feature over the refits."""
    return importances.groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("refits")
    )
