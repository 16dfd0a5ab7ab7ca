"""Target portfolios for all dates at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, require_columns
from ..functions.groups import stored, top_per_group, with_ranks
from .cross_section import top_n


@dataclass(frozen=True)
class PortfolioConstraints:
    """Limits of the industry-neutral builder."""

    max_industry_weight: float = 0.25
    min_industry_count: int = 5
    max_stock_weight: float = 0.10

    def __post_init__(self) -> None:
        if not (0 < self.max_industry_weight <= 1 and 0 < self.max_stock_weight <= 1):
            raise ValueError("weight limits must be in (0, 1]")
        if self.min_industry_count < 1:
            raise ValueError("a basket needs at least one industry")


@dataclass(frozen=True)
class AllocationSettings:
    """Limits and regime-dependent cash of the allocator."""

    max_stock_weight: float = 0.10
    max_industry_weight: float = 0.25
    top_n: int = 20
    cash_by_regime: dict[str, float] = field(
        default_factory=lambda: {"bull": 0.0, "sideways": 0.30, "bear": 0.60, "high_volatility": 0.50}
    )

    def __post_init__(self) -> None:
        if not (0 < self.max_stock_weight <= 1 and 0 < self.max_industry_weight <= 1):
            raise ValueError("weight limits must be in (0, 1]")
        if self.top_n < 1:
            raise ValueError("nothing can be allocated to fewer than one name")
        if any(not 0 <= v <= 1 for v in self.cash_by_regime.values()):
            raise ValueError("a cash share lies between 0 and 1")


def equal_weight(scores: DataFrame, n: int = 20, score: str = "composite_score") -> DataFrame:
    """Top n per date with equal weights (P1); the count runs over at most n rows."""
    best = top_n(scores, n, score)
    return best.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))


def industry_neutral(
    scores: DataFrame,
    n: int = 20,
    limits: PortfolioConstraints = PortfolioConstraints(),
    score: str = "composite_score",
) -> DataFrame:
    """Even selection over the strongest industries.

    Industries are ordered by their leader. The first ``max(min count, ceil(1 / cap))``
    enter, more follow until n names are available. Taking candidates by (rank in
    industry, industry order) deals the n places round-robin. No industry can place more
    than n names, so a group limit drops the rest before the shuffle.
    """
    valid = scores.filter(F.col(score).isNotNull())
    sizes = valid.groupBy("date", "industry").agg(F.count(F.lit(1)).alias("_size"))
    ranked = top_per_group(
        valid, ["date", "industry"], [F.col(score).desc(), F.col("code")], n, "industry_rank"
    )
    lead_order = Window.partitionBy("date").orderBy(F.col(score).desc(), "industry")
    before = lead_order.rowsBetween(Window.unboundedPreceding, -1)
    need = max(limits.min_industry_count, math.ceil(1 / limits.max_industry_weight))
    leaders = (
        ranked.filter(F.col("industry_rank") == 1)
        .join(sizes, ["date", "industry"])
        .withColumns(
            {
                "_lr": F.row_number().over(lead_order),
                "_before": F.coalesce(F.sum("_size").over(before), F.lit(0)),
            }
        )
    )
    chosen = leaders.filter(
        (F.col("_lr") <= min(n, need)) | ((F.col("_lr") <= n) & (F.col("_before") < n))
    ).select("date", "industry", "_lr")
    dealt = top_per_group(
        ranked.join(chosen, ["date", "industry"]), ["date"],
        [F.col("industry_rank"), F.col("_lr")], n, "_place",
    )
    # Every chosen industry places its leader, so the places show how many were chosen.
    industries = F.max("_lr").over(Window.partitionBy("date"))
    names = F.count(F.lit(1)).over(Window.partitionBy("date", "industry"))
    share = F.least(1.0 / industries, F.lit(limits.max_industry_weight))
    return dealt.withColumn(
        "weight", F.least(share / names, F.lit(limits.max_stock_weight))
    ).select("date", "code", "industry", "weight", score, "industry_rank")


def allocate(
    candidates: DataFrame,
    settings: AllocationSettings = AllocationSettings(),
    keys: tuple[str, ...] = ("date",),
) -> DataFrame:
    """Quality-weighted allocation under cash, industry and stock limits.

    ``candidates``: ``keys, code, score, model_prediction, industry, risk, regime``.
    Ranks run over the whole section; everything after the cut runs over at most n rows.
    """
    require_columns(candidates, *keys, "code", "score", "model_prediction", "industry", "risk", "regime")
    s, candidates = settings, stored(candidates)
    df = candidates.filter(F.col("score").isNotNull()).withColumns(
        {
            "industry": F.coalesce("industry", F.lit("Unknown")),
            "regime": F.coalesce("regime", F.lit("sideways")),
            "risk": F.least(F.greatest(F.coalesce("risk", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)),
        }
    )
    counts = {"_scores": "score", "_models": "model_prediction"}
    df = with_ranks(df, keys, {"_sr": "score", "_mr": "model_prediction"}, counts=counts)
    by_score, by_model = F.col("_sr") / F.col("_scores"), ratio("_mr", "_models")
    blended = 0.5 * by_score + 0.5 * F.coalesce(by_model, F.lit(0.5))
    df = df.withColumn("quality", F.when(F.col("_models") > 0, blended).otherwise(by_score))
    regimes = most_frequent(candidates, "regime", keys)
    best = top_per_group(
        df.drop("regime"), keys, [F.col("quality").desc(), F.col("code")], s.top_n
    ).join(regimes, list(keys))
    day, group = Window.partitionBy(*keys), Window.partitionBy(*keys, "industry")
    cash = F.lit(s.cash_by_regime["sideways"])
    for state, value in s.cash_by_regime.items():
        cash = F.when(F.col("regime") == state, F.lit(value)).otherwise(cash)
    best = best.withColumn("_raw", F.greatest(F.col("quality"), F.lit(0.0)) * (1 - F.col("risk")))
    best = best.withColumn("_raw", F.when(F.sum("_raw").over(day) > 0, F.col("_raw")).otherwise(1.0))
    best = best.withColumn("_w", F.col("_raw") / F.sum("_raw").over(day) * (1 - cash))
    total = F.sum("_w").over(group)
    scale = F.when(total > s.max_industry_weight, F.lit(s.max_industry_weight) / total).otherwise(1.0)
    best = best.withColumn("weight", F.least(F.col("_w") * scale, F.lit(s.max_stock_weight)))
    return best.filter(F.col("weight") > 0).select(
        *keys, "code", "weight", "industry",
        F.col("model_prediction").alias("model_score"), F.col("risk").alias("risk_score"), "regime",
    )


def most_frequent(df: DataFrame, column: str, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """``keys, column``: the most frequent value per key, ties by name."""
    known = df.withColumn(column, F.coalesce(column, F.lit("sideways")))
    counts = known.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return top_per_group(counts, keys, [F.col("_n").desc(), F.col(column)], 1).select(*keys, column)


def cash_weight(holdings: DataFrame) -> DataFrame:
    """Uninvested share per date."""
    invested = F.sum("weight")
    return holdings.groupBy("date").agg(
        invested.alias("invested"),
        F.least(F.greatest(1 - invested, F.lit(0.0)), F.lit(1.0)).alias("cash"),
    )


def turnover(holdings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Half the absolute weight change to the previous basket, per rebalance.

    Each weight counts + in its own basket and - in the next one; one aggregate on
    (basket, code) replaces the full outer join of consecutive baskets.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    baskets = holdings.select(*keys, "date").distinct().withColumn("_p", F.row_number().over(order))
    numbered = holdings.join(F.broadcast(baskets), [*keys, "date"]).select(*keys, "_p", "code", "weight")
    moved = numbered.withColumns({"_p": F.col("_p") + 1, "weight": -F.col("weight")})
    change = numbered.unionByName(moved).groupBy(*keys, "_p", "code").agg(F.sum("weight").alias("_d"))
    per = change.groupBy(*keys, "_p").agg((F.sum(F.abs("_d")) * 0.5).alias("turnover"))
    return baskets.join(per, [*keys, "_p"]).select(*keys, "date", "turnover")


def next_business_day(date: Column) -> Column:
    """Next weekday after a date."""
    day = F.dayofweek(date)
    return F.date_add(date, F.when(day == 6, 3).when(day == 7, 2).otherwise(1))


def next_session_plan(scores: DataFrame, n: int = 20, score: str = "composite_score") -> DataFrame:
    """Equal-weight orders from the latest snapshot for the next business day."""
    last = scores.agg(F.max("date").alias("date"))
    snapshot = scores.join(F.broadcast(last), "date")
    return equal_weight(snapshot, n, score).select(
        F.col("date").alias("signal_date"),
        next_business_day(F.col("date")).alias("execution_date"),
        "code",
        "weight",
    )


def capped_top_n(
    scores: DataFrame,
    exposure: DataFrame,
    n: int = 20,
    max_single: float = 0.10,
    on: float = 1.0,
    off: float = 0.5,
    score: str = "prediction",
) -> DataFrame:
    """Top n with min(max single, exposure / n) each (P9); ``exposure`` is date, risk_on."""
    best = top_n(scores, n, score).join(F.broadcast(exposure), "date")
    count = F.count(F.lit(1)).over(Window.partitionBy("date"))
    level = F.when(F.col("risk_on"), on).otherwise(off)
    return best.withColumn("weight", F.least(F.lit(max_single), level / count)).select(
        "date", "code", "weight", "risk_on"
    )


# Order execution rules.
LOT_SIZE = 100
COMMISSION_RATE = 0.0003
STAMP_TAX_RATE = 0.0005
MINIMUM_COMMISSION = 5.0
BASE_SLIPPAGE = 0.001
LOW_LIQUIDITY_AMOUNT = 5_000_000.0
LOW_LIQUIDITY_MULTIPLIER = 2.0
LIMIT_RATIO = 0.10


def tradeability(bars: DataFrame) -> DataFrame:
    """Add ``can_buy, can_sell`` (D14). Optional flags: suspended, is_limit_up/down."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in bars.columns else F.lit(False)

    change = F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close") - 1).otherwise(
        F.when(F.col("prev_close").isNotNull(), 0.0)
    )
    base = (
        ~flag("suspended")
        & ~F.coalesce(F.col("volume") <= 0, F.lit(False))
        & F.coalesce(F.col("open") > 0, F.lit(False))
    )
    up = flag("is_limit_up") | F.coalesce(change >= LIMIT_RATIO - 1e-12, F.lit(False))
    down = flag("is_limit_down") | F.coalesce(change <= -LIMIT_RATIO + 1e-12, F.lit(False))
    return bars.withColumns({"can_buy": base & ~up, "can_sell": base & ~down})


def execution_costs(orders: DataFrame) -> DataFrame:
    """Fill price, lots, commission and tax of proposed trades.

    ``orders``: ``side`` (buy or sell), ``open, amount, quantity``.
    """
    thin = F.col("amount").isNull() | (F.col("amount") < LOW_LIQUIDITY_AMOUNT)
    slip = F.lit(BASE_SLIPPAGE) * F.when(thin, LOW_LIQUIDITY_MULTIPLIER).otherwise(1.0)
    df = orders.withColumn("slippage", slip)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    df = df.withColumns(
        {
            "fill_price": F.col("open") * (1 + sign * F.col("slippage")),
            "filled": F.floor(F.col("quantity") / LOT_SIZE) * LOT_SIZE,
        }
    )
    notional = F.col("filled") * F.col("fill_price")
    df = df.withColumn("notional", notional)
    return df.withColumns(
        {
            "commission": F.when(
                F.col("filled") > 0, F.greatest(F.col("notional") * COMMISSION_RATE, F.lit(MINIMUM_COMMISSION))
            ).otherwise(0.0),
            "tax": F.when(F.col("side") == "sell", F.col("notional") * STAMP_TAX_RATE).otherwise(0.0),
        }
    )


def sellable_quantity(fills: DataFrame) -> DataFrame:
    """Shares acquired before each fill date (B11): a running total per code over dates.

    ``fills``: ``code, date, quantity`` (negative for sales). Days are aggregated first.
    """
    daily = fills.groupBy("code", "date").agg(F.sum("quantity").alias("net"))
    past = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("sellable", F.coalesce(F.sum("net").over(past), F.lit(0.0)))


def target_shares(targets: DataFrame, equity: Column, price: str = "price", lot: int = LOT_SIZE) -> DataFrame:
    """Whole lots affordable at each weight."""
    lots = F.floor(F.col("weight") * equity / (F.col(price) * lot))
    return targets.withColumn("shares", F.greatest(lots * lot, F.lit(0)))
