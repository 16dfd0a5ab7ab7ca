"""Attribution of completed trades and of portfolio returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .joins import carry_basket
from .metrics import drawdown_periods


def matured(log: DataFrame) -> DataFrame:
    """Decisions with a realised return."""
    return log.filter(F.col("future_return").isNotNull() & F.col("model_score").isNotNull()).withColumns(
        {
            "prediction_error": F.coalesce("prediction_error", F.col("future_return") - F.col("model_score")),
            "industry": F.coalesce("industry", F.lit("Unknown")),
        }
    )


def with_market_return(trades: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Index return between entry and exit, 0 where a level is missing."""
    index = benchmark.select("date", "close")
    start = F.broadcast(index.select("date", F.col("close").alias("_in")))
    end = F.broadcast(index.select(F.col("date").alias("_out_date"), F.col("close").alias("_out")))
    df = trades.withColumn("_out_date", F.coalesce("exit_date", "date"))
    df = df.join(start, "date", "left").join(end, "_out_date", "left")
    return df.withColumn(
        "market_return", F.coalesce(ratio("_out", "_in") - 1, F.lit(0.0))
    ).drop("_in", "_out", "_out_date")


def reviewed(log: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Completed trades with effective weights over the whole log (T5).

    The total is a one-row aggregate joined back, so no task sees the whole log.
    """
    df = with_market_return(matured(log), benchmark)
    total = df.agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    df = df.join(F.broadcast(total))
    weight = F.when(F.col("_w") > 0, F.coalesce("weight", F.lit(0.0)) / F.col("_w")).otherwise(1.0 / F.col("_n"))
    df = df.withColumn("effective_weight", weight).drop("_w", "_n")
    return df.withColumns(
        {
            "weighted_return": F.col("effective_weight") * F.col("future_return"),
            "excess_return": F.col("future_return") - F.col("market_return"),
        }
    )


def review_summary(trades: DataFrame) -> DataFrame:
    """One row of totals (T5)."""
    w = F.col("effective_weight")
    hit = (F.signum("model_score") == F.signum("future_return")).cast("double")
    return trades.agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("weighted_return").alias("total_return"),
        F.sum(w * F.col("market_return")).alias("market_return"),
        F.sum(w * F.col("excess_return")).alias("excess_return"),
        F.sum(w * F.col("prediction_error")).alias("prediction_error"),
        F.avg(hit).alias("model_accuracy"),
        F.avg("prediction_error").alias("prediction_bias"),
    )


def factor_contribution(trades: DataFrame) -> DataFrame:
    """Score x return x weight per factor."""
    rows = trades.select("future_return", "effective_weight", F.explode("factor_scores").alias("factor_name", "score"))
    rows = rows.filter(F.col("score").isNotNull())
    return rows.groupBy("factor_name").agg(
        F.avg("score").alias("average_score"),
        F.avg("future_return").alias("average_return"),
        F.sum(F.col("score") * F.col("future_return") * F.col("effective_weight")).alias("contribution"),
        F.count(F.lit(1)).alias("observations"),
    )


def group_review(trades: DataFrame, by: str) -> DataFrame:
    """Counts, returns and errors by industry or another column."""
    return trades.groupBy(by).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.avg("future_return").alias("average_return"),
        F.sum("weighted_return").alias("contribution"),
        F.avg("prediction_error").alias("prediction_error"),
    )


def monthly_review(trades: DataFrame) -> DataFrame:
    """The same by calendar month of entry."""
    df = trades.withColumn("month", F.date_format("date", "yyyy-MM"))
    return group_review(df, "month").withColumnRenamed("contribution", "total_return")


def market_review(trades: DataFrame) -> DataFrame:
    """Weighted portfolio, market and excess return."""
    w = F.col("effective_weight")
    return trades.agg(
        F.sum(w * F.col("market_return")).alias("market_return"),
        F.sum("weighted_return").alias("portfolio_return"),
        F.sum(w * F.col("excess_return")).alias("excess_return"),
    )


def trade_equity(trades: DataFrame) -> DataFrame:
    """Compounded weighted return per entry date."""
    daily = trades.groupBy("date").agg(F.sum("weighted_return").alias("_r"))
    run = F.exp(F.sum(F.log(1 + F.col("_r"))).over(Window.orderBy("date")))
    return daily.select("date", run.alias("equity"))


def trade_drawdowns(trades: DataFrame) -> DataFrame:
    return drawdown_periods(trade_equity(trades))


def return_attribution(
    curve: DataFrame, benchmark: DataFrame, holdings: DataFrame, prices: DataFrame
) -> DataFrame:
    """Daily market, industry, selection and timing parts of the return.

    ``curve``: ``date, equity``; ``benchmark``: ``date, benchmark``; ``holdings``: ``date,
    code, industry, weight``; ``prices``: ``code, date, close``. Industry weights of the
    benchmark are the equal-weight shares of the local universe.
    """
    w = Window.orderBy("date")
    both = curve.select("date", "equity").join(F.broadcast(benchmark.select("date", "benchmark")), "date")
    daily = both.select(
        "date",
        (ratio("equity", F.lag("equity").over(w)) - 1).alias("portfolio_return"),
        (ratio("benchmark", F.lag("benchmark").over(w)) - 1).alias("benchmark_return"),
    ).filter(F.col("portfolio_return").isNotNull() & F.col("benchmark_return").isNotNull())
    by_code = Window.partitionBy("code").orderBy("date")
    stocks = prices.select(
        "date", "code", (ratio("close", F.lag("close").over(by_code)) - 1).alias("stock_return")
    ).filter(F.col("stock_return").isNotNull())
    held = carry_basket(holdings, daily.select("date")).select("date", "code", "industry", "weight")
    merged = held.join(stocks, ["date", "code"])
    industry = merged.groupBy("date", "industry").agg(
        F.sum("weight").alias("_pw"), F.avg("stock_return").alias("_ir"),
        F.sum(F.col("weight") * F.col("stock_return")).alias("_wr"),
    )
    market = stocks.groupBy("date").agg(F.avg("stock_return").alias("_mr"), F.count(F.lit(1)).alias("_all"))
    # Industry of a code as first held; names never held count in the market only.
    labels = holdings.groupBy("code").agg(F.min_by("industry", "date").alias("industry"))
    sizes = stocks.join(labels, "code").groupBy("date", "industry").agg(F.count(F.lit(1)).alias("_size"))
    parts = (
        industry.join(F.broadcast(market), "date")
        .join(sizes, ["date", "industry"], "left")
        .groupBy("date")
        .agg(
            F.sum(
                (F.col("_pw") - F.coalesce(ratio("_size", "_all"), F.lit(0.0))) * (F.col("_ir") - F.col("_mr"))
            ).alias("industry_allocation"),
            F.sum(F.col("_wr") - F.col("_pw") * F.col("_ir")).alias("stock_selection"),
        )
    )
    beta = daily.agg(
        F.when(F.var_pop("benchmark_return") > 0,
               F.covar_pop("portfolio_return", "benchmark_return") / F.var_pop("benchmark_return"))
        .otherwise(0.0).alias("_beta")
    )
    df = daily.join(parts, "date", "left").fillna(0.0, ["industry_allocation", "stock_selection"])
    df = df.join(F.broadcast(beta)).withColumn("market_beta", F.col("_beta") * F.col("benchmark_return")).drop("_beta")
    return df.withColumn(
        "factor_timing",
        F.col("portfolio_return") - F.col("market_beta") - F.col("industry_allocation") - F.col("stock_selection"),
    )


def attribution_summary(daily: DataFrame) -> DataFrame:
    """Component sums; the first four add up to the last."""
    names = {
        "market_beta_contribution": "market_beta",
        "industry_allocation_contribution": "industry_allocation",
        "stock_selection_contribution": "stock_selection",
        "factor_timing_contribution": "factor_timing",
        "portfolio_simple_return": "portfolio_return",
    }
    sums = daily.agg(F.lit(1).alias("_k"), *[F.sum(c).alias(n) for n, c in names.items()])
    return sums.unpivot(["_k"], list(names), "component", "contribution").drop("_k")
