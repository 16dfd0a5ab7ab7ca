"""Trade-decision log: snapshots, explanations, realised outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join

LOG_KEYS = ("date", "symbol", "strategy")


def scores_to_json(scores: Column | str) -> Column:
    """Map to canonical JSON text: no gaps, keys in order."""
    m = F.map_filter(scores, lambda _, v: v.isNotNull() & ~F.isnan(v))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def scores_from_json(text: Column | str) -> Column:
    """Canonical JSON text to map; unreadable text is an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    m = F.coalesce(F.from_json(text, "map<string,double>"), empty)
    return F.map_filter(m, lambda _, v: v.isNotNull())


def leading_factors(scores: Column | str, empty: str) -> Column:
    """``name=+0.123`` of the three largest absolute scores, ties by name."""
    keyed = F.transform(
        F.map_entries(F.map_filter(scores, lambda _, v: v.isNotNull())),
        lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("key"), e["value"].alias("value")),
    )
    top = F.slice(F.array_sort(keyed), 1, 3)
    text = F.array_join(F.transform(top, lambda e: F.format_string("%s=%+.3f", e["key"], e["value"])), ", ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def explanation(scores: Column, regime: Column, regime_exposure: Column, weight: Column) -> Column:
    """Evidence-only rationale of a purchase (T4)."""
    return F.concat(
        F.lit("Buy because the security ranked in the selected composite-score set; factor contribution: "),
        leading_factors(scores, "no valid factor components"),
        F.lit("; regime adjustment: "), regime, F.lit(" exposure "), _percent(regime_exposure),
        F.lit("; risk adjustment: final target exposure "), _percent(weight), F.lit("."),
    )


def backfilled_reason(scores: Column, regime: Column, weight: Column) -> Column:
    """Rationale for decisions recorded without one (T4)."""
    return F.concat(
        F.lit("Buy decision explanation backfilled from v3.0 snapshot; factor contribution: "),
        leading_factors(scores, "unavailable"),
        F.lit("; regime adjustment: "), regime,
        F.lit("; risk adjustment: recorded target weight "), _percent(F.coalesce(weight, F.lit(0.0))), F.lit("."),
    )


def with_reasons(log: DataFrame) -> DataFrame:
    """Fill absent reasons from the stored scores, regime and weight."""
    absent = F.col("decision_reason").isNull() | F.col("decision_reason").isin("", "Unknown", "Not recorded")
    filled = backfilled_reason(F.col("factor_scores"), F.col("market_regime"), F.col("weight"))
    return log.withColumn("decision_reason", F.when(absent, filled).otherwise(F.col("decision_reason")))


def build_decisions(
    holdings: DataFrame, signals: DataFrame, lines: DataFrame, regimes: DataFrame, prices: DataFrame, strategy: str
) -> DataFrame:
    """Decision rows of every holding.

    ``holdings``: ``date (entry), signal_date, code, weight, industry, exposure``;
    ``signals``: ``date, code, composite_score, factor_scores``; ``lines``: calibrated
    ``signal_date, intercept, slope``; ``regimes``: ``date, state, exposure, volatility``.
    The exit is the next entry; regime is the last one known at the signal.
    """
    entries = holdings.select("date", "signal_date").distinct()
    w = Window.orderBy("date")
    entries = entries.withColumn("exit_date", F.lead("date").over(w))
    known = regimes.select(
        F.col("date").alias("_rd"), F.col("state").alias("_state"), F.col("exposure").alias("_re"), F.col("volatility").alias("_vol")
    )
    entries = asof_join(entries, known, [], "signal_date", "_rd", ["_state", "_re", "_vol"])
    entries = entries.join(F.broadcast(lines.select("signal_date", "intercept", "slope")), "signal_date", "left")
    df = holdings.join(F.broadcast(entries.drop("signal_date")), "date")
    score = signals.select(F.col("date").alias("signal_date"), "code", "composite_score", "factor_scores")
    df = df.join(score, ["signal_date", "code"])
    opens = prices.filter(F.col("open") > 0)
    df = df.join(opens.select("code", "date", F.col("open").alias("entry_price")), ["code", "date"], "left")
    df = df.join(
        opens.select("code", F.col("date").alias("exit_date"), F.col("open").alias("exit_price")), ["code", "exit_date"], "left"
    )
    regime = F.coalesce("_state", F.lit("sideways"))
    prediction = F.col("intercept") + F.col("slope") * F.col("composite_score")
    return df.select(
        "date", F.col("code").alias("symbol"), F.lit(strategy).alias("strategy"),
        F.coalesce(prediction, F.lit(0.0)).alias("model_score"), "factor_scores", "industry",
        regime.alias("market_regime"), "entry_price", "exit_price", "exit_date", "weight",
        F.col("_vol").alias("market_volatility"),
        explanation(F.col("factor_scores"), regime, F.coalesce("_re", F.lit(0.70)), F.col("exposure")).alias("decision_reason"),
        F.lit(None).cast("double").alias("future_return"),
        F.lit(None).cast("double").alias("prediction_error"),
    )


def fill_exits(log: DataFrame, prices: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Look up exit prices that are still open; known ones stay."""
    pending = F.col("exit_price").isNull() & F.col("exit_date").isNotNull()
    if as_of is not None:
        pending = pending & (F.col("exit_date") <= as_of)
    lookup = prices.select(
        F.col("code").alias("symbol"), F.col("date").alias("exit_date"), F.col("close").alias("_resolved")
    )
    df = log.join(lookup, ["symbol", "exit_date"], "left")
    return df.withColumn(
        "exit_price", F.when(pending, F.col("_resolved")).otherwise(F.col("exit_price"))
    ).select(*log.columns)


def realize(log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Return and prediction error of decisions whose exit is known."""
    ready = (F.col("entry_price") > 0) & (F.col("exit_price") > 0)
    if as_of is not None:
        ready = ready & F.coalesce(F.col("exit_date") <= as_of, F.lit(False))
    result = F.col("exit_price") / F.col("entry_price") - 1
    return log.withColumns(
        {
            "future_return": F.when(ready, result).otherwise(F.col("future_return")),
            "prediction_error": F.when(ready, result - F.col("model_score")).otherwise(F.col("prediction_error")),
        }
    )
