"""Prediction-error analysis and strategy diagnosis over completed decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import with_row_number

SUCCESS = ("true_positive", "true_negative")


def confusion(score: Column, result: Column) -> Column:
    """Class of a prediction by the signs of score and return."""
    return (
        F.when((score >= 0) & (result >= 0), "true_positive")
        .when((score >= 0) & (result < 0), "false_positive")
        .when((score < 0) & (result < 0), "true_negative")
        .otherwise("false_negative")
    )


def volatility_bucket(v: Column) -> Column:
    """low below 15 %, normal below 25 %, else high."""
    return F.when(v.isNull(), "unknown").when(v < 0.15, "low").when(v < 0.25, "normal").otherwise("high")


def factor_states(scores: Column | str) -> Column:
    """Map factor -> positive / negative."""
    valid = F.map_filter(scores, lambda _, v: v.isNotNull())
    return F.transform_values(valid, lambda _, v: F.when(v >= 0, "positive").otherwise("negative"))


def completed(log: DataFrame) -> DataFrame:
    """Completed decisions with class, volatility bucket and factor states."""
    df = log.filter(F.col("model_score").isNotNull() & F.col("future_return").isNotNull())
    return df.withColumns(
        {
            "classification": confusion(F.col("model_score"), F.col("future_return")),
            "volatility_bucket": volatility_bucket(F.col("market_volatility")),
            "factor_states": factor_states("factor_scores"),
            **{c: F.coalesce(c, F.lit("Unknown")) for c in ("strategy", "market_regime", "industry")},
        }
    )


def with_score_bucket(trades: DataFrame, most: int = 5) -> DataFrame:
    """Quantile bucket Q1..Q5 of the score by first rank.

    The rank spans the whole log, so it comes from the spread row number. Edges are the
    linearly interpolated quantiles of 1..n, evaluated in doubles; a rank on an edge
    belongs to the lower bucket.
    """
    totals = trades.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("model_score").alias("_u"))
    order = [F.col("model_score"), F.col("date"), F.col("symbol"), F.col("strategy")]
    df = with_row_number(trades, [], order, "_r").join(F.broadcast(totals))
    q = F.least(F.lit(most), F.col("_u"), F.col("_n"))
    bucket = F.lit(most)
    for k in range(most - 1, 0, -1):
        at = (F.col("_n") - 1) * ((F.lit(float(k)) / q * 100) / 100)
        lo = F.floor(at)
        f = at - lo
        lower, upper = lo + 1, F.least(lo + 2, F.col("_n"))
        edge = F.when(f >= 0.5, upper - (upper - lower) * (1 - f)).otherwise(lower + (upper - lower) * f)
        bucket = F.when((F.lit(k) < q) & (F.col("_r") <= edge), F.lit(k)).otherwise(F.least(bucket, q))
    name = F.when(q < 2, F.lit("Q1")).otherwise(F.concat(F.lit("Q"), bucket.cast("int").cast("string")))
    return df.withColumn("prediction_score_bucket", name).drop("_r", "_n", "_u")


def condition_summary(trades: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``kind, condition`` with counts, returns, bias and accuracy.

    All conditions come from one pass: each row is stacked once per condition.
    """
    pairs = ", ".join(f"'{kind}', {column}" for kind, column in conditions.items())
    rows = trades.selectExpr(
        "future_return", "prediction_error", "classification", f"stack({len(conditions)}, {pairs}) AS (kind, condition)"
    )
    hit = F.col("classification").isin(*SUCCESS).cast("double")
    return rows.groupBy("kind", "condition").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("future_return").alias("average_return"),
        F.avg("prediction_error").alias("prediction_bias"),
        F.avg(hit).alias("accuracy"),
        F.count(F.when(F.col("classification") == "false_positive", 1)).alias("false_positive"),
        F.count(F.when(F.col("classification") == "false_negative", 1)).alias("false_negative"),
    )


def factor_state_failures(trades: DataFrame) -> DataFrame:
    """Failure rate per factor and state."""
    rows = trades.select(
        "classification", "future_return", "prediction_error", F.explode("factor_states").alias("factor", "factor_state")
    )
    failed = F.col("classification").isin("false_positive", "false_negative").cast("double")
    return rows.groupBy("factor", "factor_state").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("future_return").alias("average_return"),
        F.avg(failed).alias("failure_rate"),
        F.avg("prediction_error").alias("prediction_bias"),
    )


def regime_extremes(regimes: DataFrame, minimum: int, best: bool, n: int = 5) -> DataFrame:
    """Best or worst regimes with enough evidence."""
    order = F.col("average_return").desc() if best else F.col("average_return").asc()
    return regimes.filter(F.col("observations") >= minimum).orderBy(order, "condition").limit(n)


def worst_factor_states(failures: DataFrame, minimum: int, n: int = 10) -> DataFrame:
    """Factor states that fail most often."""
    return (
        failures.filter(F.col("observations") >= minimum)
        .orderBy(F.desc("failure_rate"), F.desc("observations"), "factor", "factor_state").limit(n)
    )


def recommendations(
    regimes: DataFrame, failures: DataFrame, trades: DataFrame, minimum: int = 5
) -> DataFrame:
    """``area, recommendation, evidence`` from the three rules, or one fallback row."""
    worst = regime_extremes(regimes, minimum, best=False).filter(F.col("average_return") < 0)
    by_regime = worst.select(
        F.lit("market_regime").alias("area"),
        F.format_string("Review or reduce exposure during %s conditions.", F.col("condition")).alias("recommendation"),
        F.format_string("%d trades; average return %.2f%%", F.col("observations"), F.col("average_return") * 100).alias("evidence"),
    )
    bad = worst_factor_states(failures, minimum).filter(F.col("failure_rate") > 0.5)
    by_factor = bad.select(
        F.lit("factor").alias("area"),
        F.format_string("Review or downweight %s when its state is %s.", F.col("factor"), F.col("factor_state")).alias("recommendation"),
        F.format_string("failure rate %.1f%% across %d trades", F.col("failure_rate") * 100, F.col("observations")).alias("evidence"),
    )
    bias = trades.agg(F.avg("prediction_error").alias("b")).filter(F.abs("b") >= 0.002)
    by_bias = bias.select(
        F.lit("calibration").alias("area"),
        F.format_string("Apply a %s return-calibration review.", F.when(F.col("b") < 0, "downward").otherwise("upward")).alias("recommendation"),
        F.format_string("mean prediction error %.3f%%", F.col("b") * 100).alias("evidence"),
    )
    found = by_regime.unionByName(by_factor).unionByName(by_bias)
    none = found.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 0).select(
        F.lit("evidence").alias("area"),
        F.lit("No adjustment recommended: available completed-trade evidence is inconclusive.").alias("recommendation"),
        F.lit(f"minimum observation threshold is {minimum}").alias("evidence"),
    )
    return found.unionByName(none)
