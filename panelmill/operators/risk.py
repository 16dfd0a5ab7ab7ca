"""Market regimes, exposures and drawdowns, computed for every date of a series.

The inputs are date series (an index, an equity curve per scenario): one row per session,
so a window over a whole series is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .joins import asof_join

ANNUAL = math.sqrt(252)


@dataclass(frozen=True)
class RegimeSettings:
    """Thresholds and exposures of the four-state regime."""

    trend_window: int = 200
    volatility_window: int = 20
    high_volatility_threshold: float = 0.30
    bull_breadth_threshold: float = 0.55
    bear_breadth_threshold: float = 0.45
    bull_exposure: float = 1.0
    sideways_exposure: float = 0.7
    bear_exposure: float = 0.4
    high_volatility_exposure: float = 0.5


@dataclass(frozen=True)
class RiskSettings:
    """Exposure control of the basic portfolio."""

    benchmark_ma_window: int = 200
    normal_exposure: float = 1.0
    bear_exposure: float = 0.5
    volatility_target: float = 0.20
    volatility_lookback: int = 60
    max_position: float = 0.10


@dataclass(frozen=True)
class AdvancedRiskSettings:
    """Regime, volatility and drawdown control."""

    bull_exposure: float = 1.0
    neutral_exposure: float = 0.7
    bear_exposure: float = 0.4
    volatility_target: float = 0.15
    volatility_lookback: int = 60
    drawdown_warning: float = 0.10
    drawdown_critical: float = 0.20
    warning_scale: float = 0.7
    critical_scale: float = 0.5
    max_position: float = 0.10


def series(keys: Sequence[str] = ()) -> WindowSpec:
    """Window over one date series, or one per key."""
    return Window.partitionBy(*keys).orderBy("date")


def moving(agg, x: str, n: int, w: WindowSpec) -> Column:
    """Full-window moving aggregate on a series."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def with_returns(curve: DataFrame, value: str, out: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    return curve.withColumn(out, ratio(value, F.lag(value).over(series(keys))) - 1)


def trailing_volatility(curve: DataFrame, value: str, lookback: int, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Annualised population deviation of the last returns, 0 with fewer than two."""
    frame = series(keys).rowsBetween(-(lookback - 1), 0)
    df = with_returns(curve, value, "_r", keys)
    vol = F.when(F.count("_r").over(frame) >= 2, F.stddev_pop("_r").over(frame) * ANNUAL)
    return df.withColumn(out, F.coalesce(vol, F.lit(0.0))).drop("_r")


def market_regime(
    benchmark: DataFrame,
    breadth: DataFrame | None = None,
    settings: RegimeSettings = RegimeSettings(),
) -> DataFrame:
    """``date, state, exposure, close, trend, breadth, volatility`` for all dates."""
    s = settings
    df = trailing_volatility(benchmark.select("date", "close"), "close", s.volatility_window, "volatility")
    ma = moving(F.avg, "close", s.trend_window, series())
    df = df.withColumn("trend", F.coalesce(ratio("close", ma) - 1, F.lit(0.0)))
    if breadth is None:
        df = df.withColumn("breadth", F.lit(0.5))
    else:
        seen = breadth.select(F.col("date").alias("_bd"), F.col("breadth"))
        df = asof_join(df, seen, [], "date", "_bd", ["breadth"])
        df = df.withColumn(
            "breadth", F.least(F.greatest(F.coalesce("breadth", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
        )
    bull = (F.col("trend") > 0) & (F.col("breadth") >= s.bull_breadth_threshold)
    bear = (F.col("trend") < 0) & (F.col("breadth") <= s.bear_breadth_threshold)
    wild = F.col("volatility") >= s.high_volatility_threshold
    state = F.when(wild, "high_volatility").when(bull, "bull").when(bear, "bear").otherwise("sideways")
    exposure = (
        F.when(wild, s.high_volatility_exposure)
        .when(bull, s.bull_exposure)
        .when(bear, s.bear_exposure)
        .otherwise(s.sideways_exposure)
    )
    return df.withColumns({"state": state, "exposure": exposure.cast("double")}).select(
        "date", "state", "exposure", "close", "trend", "breadth", "volatility"
    )


def moving_average_regime(
    benchmark: DataFrame, settings: AdvancedRiskSettings = AdvancedRiskSettings()
) -> DataFrame:
    """Bull / Neutral / Bear by the order of close and moving averages (R2)."""
    w = series()
    df = benchmark.select(
        "date", "close", *[moving(F.avg, "close", n, w).alias(f"ma{n}") for n in (20, 60, 120, 200)]
    )
    c, m20, m60, m120, m200 = (F.col(x) for x in ("close", "ma20", "ma60", "ma120", "ma200"))
    bull = (c >= m60) & (c >= m120) & (c >= m200) & (m20 >= m60)
    bear = (c <= m60) & (c <= m120) & (c <= m200) & (m20 <= m60)
    complete = m200.isNotNull()
    state = F.when(complete & bull, "Bull").when(complete & bear, "Bear").otherwise("Neutral")
    exposure = (
        F.when(state == "Bull", settings.bull_exposure)
        .when(state == "Bear", settings.bear_exposure)
        .otherwise(settings.neutral_exposure)
    )
    return df.withColumns({"state": state, "exposure": exposure})


def trend_exposure(benchmark: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Bear exposure while the close is below its long mean, normal in warm-up."""
    ma = moving(F.avg, "close", settings.benchmark_ma_window, series())
    return benchmark.select(
        "date",
        F.when(F.col("close") < ma, settings.bear_exposure)
        .otherwise(settings.normal_exposure)
        .alias("exposure"),
    )


def risk_on(benchmark: DataFrame, window: int = 60) -> DataFrame:
    """Whether the close is above its mean; warm-up counts as off."""
    ma = moving(F.avg, "close", window, series())
    return benchmark.select("date", F.coalesce(F.col("close") > ma, F.lit(False)).alias("risk_on"))


def volatility_scale(volatility: Column, target: float) -> Column:
    """min(1, target / volatility); 1 when there is no volatility yet."""
    return F.when(volatility > target, F.lit(target) / volatility).otherwise(F.lit(1.0))


def with_drawdown(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``drawdown`` from the running peak."""
    peak = F.max(value).over(series(keys).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("drawdown", ratio(value, peak) - 1)


def drawdown_scale(drawdown: Column, s: AdvancedRiskSettings = AdvancedRiskSettings()) -> Column:
    """Step scale at the warning and critical drawdowns."""
    return (
        F.when(drawdown <= -s.drawdown_critical, s.critical_scale)
        .when(drawdown <= -s.drawdown_warning, s.warning_scale)
        .otherwise(1.0)
    )


def risk_decisions(
    benchmark: DataFrame, curve: DataFrame, settings: AdvancedRiskSettings = AdvancedRiskSettings()
) -> DataFrame:
    """Combined exposure regime x volatility x drawdown for every curve date.

    Regime is the last one known on the date; ``curve`` is ``date, equity``.
    """
    df = trailing_volatility(curve, "equity", settings.volatility_lookback, "realized_volatility")
    df = with_drawdown(df)
    regimes = moving_average_regime(benchmark, settings).select(
        F.col("date").alias("_rd"), F.col("state"), F.col("exposure").alias("regime_exposure")
    )
    df = asof_join(df, regimes, [], "date", "_rd", ["state", "regime_exposure"])
    df = df.withColumns(
        {
            "volatility_scale": volatility_scale(F.col("realized_volatility"), settings.volatility_target),
            "drawdown_scale": drawdown_scale(F.col("drawdown"), settings),
            "regime_exposure": F.coalesce("regime_exposure", F.lit(settings.neutral_exposure)),
            "state": F.coalesce("state", F.lit("Neutral")),
        }
    )
    return df.withColumn(
        "exposure", F.col("regime_exposure") * F.col("volatility_scale") * F.col("drawdown_scale")
    )


def capped_weights(
    targets: DataFrame, exposure: Column, max_position: float = 0.10
) -> DataFrame:
    """Cap each weight, then scale by the exposure (P5)."""
    w = F.least(F.greatest(F.col("weight"), F.lit(0.0)), F.lit(max_position)) * exposure
    return targets.withColumn("weight", w)
