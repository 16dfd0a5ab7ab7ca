"""Portfolio returns from target weights, without a per-day loop.

Selling everything and buying the new weights at each rebalance makes every period
proportional to its starting cash. With entry opens o0, marks p and costs,

    in-period factor = 1 - W + k1 * sum(w p / o0)
    period factor    = 1 - W + k2 * sum(w o1 / o0)

so the sums are grouped aggregates over held names, and the equity is a running product of
period factors over one small row per rebalance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chains import first_position, on_chain, positions_bitmap
from ..functions.columns import ratio, require_columns
from ..functions.groups import durable
from .joins import asof_join, fill_sessions

ANNUAL = 252


@dataclass(frozen=True)
class TradingCosts:
    """Proportional costs."""

    commission: float = 0.0003
    stamp_tax: float = 0.0005
    slippage: float = 0.001


def _cost_factors(costs: TradingCosts, scale) -> tuple:
    c, t, s = (F.lit(x) * scale for x in (costs.commission, costs.stamp_tax, costs.slippage))
    buy = 1.0 / ((1 + c) * (1 + s))
    keep = (1 - s) * (1 - c - t)
    return buy, keep


def basket_table(
    holdings: DataFrame, keys: Sequence[str] = ("scenario",), calendar: DataFrame | None = None
) -> DataFrame:
    """One row per rebalance: ``keys, p, entry_date, next_date`` (NULL for the last).

    With a calendar, an empty basket p = 0 covers the sessions before the first entry.
    """
    w = Window.partitionBy(*keys).orderBy("entry_date")
    starts = holdings.select(*keys, F.col("date").alias("entry_date")).distinct()
    table = starts.withColumns(
        {"p": F.row_number().over(w), "next_date": F.lead("entry_date").over(w)}
    )
    if calendar is None:
        return table
    first = calendar.agg(F.min("date").alias("_first"))
    ahead = table.filter(F.col("p") == 1).join(F.broadcast(first), F.col("_first") < F.col("entry_date"))
    return table.unionByName(
        ahead.select(
            *keys, F.lit(0).alias("p"), F.col("_first").alias("entry_date"),
            F.col("entry_date").alias("next_date"),
        )
    )


def period_sums(
    holdings: DataFrame,
    prices: DataFrame,
    keys: Sequence[str] = ("scenario",),
    from_start: bool = False,
    calendar: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Weighted price relatives of every held session.

    ``holdings``: ``keys, date (entry), code, weight``; ``prices``: ``code, date, open, close``.
    ``calendar`` lists the sessions; without it they come from all prices.
    Returns days ``keys, p, date, entry_date, invested, marked`` and exits
    ``keys, p, invested, sold``. A target without an open on its entry date stays in cash;
    a name without a bar is marked, and sold, at its last known close.
    """
    require_columns(holdings, *keys, "date", "code", "weight")
    require_columns(prices, "code", "date", "open", "close")
    # Holdings are read four times below and the sums twice; both are small tables. Prices
    # shrink to the names ever held before they are stored.
    holdings = durable(holdings)
    calendar = durable(calendar if calendar is not None else prices.select("date").distinct())
    ever = holdings.select("code").distinct()
    prices = durable(prices.select("code", "date", "open", "close").join(ever, "code", "left_semi"))
    baskets = basket_table(holdings, keys, calendar if from_start else None)
    # (basket, session) pairs: the calendar rows in [entry, next], next included for the sale.
    span = F.broadcast(baskets).join(
        calendar,
        (F.col("date") >= F.col("entry_date"))
        & (F.col("next_date").isNull() | (F.col("date") <= F.col("next_date"))),
    )
    held = holdings.select(*keys, F.col("date").alias("entry_date"), "code", "weight").filter(
        F.col("weight") > 0
    )
    legs = held.join(F.broadcast(span), [*keys, "entry_date"])
    marks = fill_sessions(prices, calendar)
    priced = legs.join(marks, ["code", "date"])
    own = Window.partitionBy(*keys, "p", "code")
    entry = F.max(
        F.when((F.col("date") == F.col("entry_date")) & F.col("traded") & (F.col("open") > 0), F.col("open"))
    )
    priced = priced.withColumn("_o0", entry.over(own)).filter(F.col("_o0").isNotNull())
    leaving = F.col("date") == F.col("next_date")
    sums = durable(
        priced.groupBy(*keys, "p", "date").agg(
            F.sum("weight").alias("invested"),
            F.sum(F.col("weight") * F.col("close") / F.col("_o0")).alias("marked"),
            F.sum(F.col("weight") * F.col("open") / F.col("_o0")).alias("sold"),
        )
    )
    days = (
        span.filter(F.col("next_date").isNull() | ~leaving)
        .join(sums.select(*keys, "p", "date", "invested", "marked"), [*keys, "p", "date"], "left")
        .fillna(0.0, ["invested", "marked"])
    )
    exits = (
        span.filter(leaving)
        .join(sums.select(*keys, "p", "date", "invested", "sold"), [*keys, "p", "date"], "left")
        .fillna(0.0, ["invested", "sold"])
        .select(*keys, "p", "invested", "sold")
    )
    return days, exits


def equity_curve(
    holdings: DataFrame,
    prices: DataFrame,
    costs: TradingCosts = TradingCosts(),
    initial: float = 100_000.0,
    keys: Sequence[str] = ("scenario",),
    cost_scales: DataFrame | None = None,
    from_start: bool = False,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """``keys, date, p, equity`` (B1), from the first entry or the first session on.

    ``cost_scales`` (``keys, cost_scale``) multiplies all costs per scenario.
    """
    days, exits = period_sums(holdings, prices, keys, from_start, calendar)
    scale = F.lit(1.0)
    if cost_scales is not None:
        days = days.join(F.broadcast(cost_scales), list(keys))
        exits = exits.join(F.broadcast(cost_scales), list(keys))
        scale = F.col("cost_scale")
    buy, keep = _cost_factors(costs, scale)
    done = exits.select(
        *keys, (F.col("p") + 1).alias("p"),
        F.log(1 - F.col("invested") + F.col("sold") * buy * keep).alias("_lf"),
    )
    w = Window.partitionBy(*keys).orderBy("p")
    carried = done.withColumn("_carry", F.exp(F.sum("_lf").over(w))).select(*keys, "p", "_carry")
    factor = 1 - F.col("invested") + F.col("marked") * buy
    return (
        days.join(F.broadcast(carried), [*keys, "p"], "left")
        .withColumn("equity", F.lit(initial) * F.coalesce("_carry", F.lit(1.0)) * factor)
        .select(*keys, "date", "p", "equity")
    )


def trading_costs(
    holdings: DataFrame,
    prices: DataFrame,
    costs: TradingCosts = TradingCosts(),
    initial: float = 100_000.0,
    keys: Sequence[str] = ("scenario",),
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Cost paid around each basket: at its entry and at its sale."""
    days, exits = period_sums(holdings, prices, keys, calendar=calendar)
    buy, keep = _cost_factors(costs, F.lit(1.0))
    baskets = days.groupBy(*keys, "p").agg(
        F.min("entry_date").alias("date"), F.max("invested").alias("invested")
    )
    done = exits.withColumn("_lf", F.log(1 - F.col("invested") + F.col("sold") * buy * keep))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    table = baskets.join(done.select(*keys, "p", "sold", "_lf"), [*keys, "p"], "left")
    cash = F.lit(initial) * F.exp(F.coalesce(F.sum("_lf").over(w), F.lit(0.0)))
    table = table.withColumn("cash", cash)
    return table.select(
        *keys, "date",
        (F.col("cash") * F.col("invested") * (1 - buy)).alias("buy_cost"),
        (F.col("cash") * F.coalesce("sold", F.lit(0.0)) * buy * (1 - keep)).alias("sell_cost"),
    )


def controlled_equity(
    holdings: DataFrame,
    prices: DataFrame,
    exposures: DataFrame,
    volatility_target: float,
    lookback: int = 60,
    drawdown_steps: Sequence[tuple[float, float]] = (),
    costs: TradingCosts = TradingCosts(),
    initial: float = 100_000.0,
    keys: Sequence[str] = ("scenario",),
    from_start: bool = False,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Equity whose exposure reacts to its own volatility and drawdown (B2).

    ``exposures``: ``entry_date, base_exposure`` known before the entry. The sums over
    names are the same as in ``equity_curve``; only the feedback is a recursion, folded per
    scenario over one row per session. ``drawdown_steps`` are (drawdown, scale), deepest
    first.
    """
    days, exits = period_sums(holdings, prices, keys, from_start, calendar)
    table = days.join(
        exits.select(*keys, "p", F.col("sold")), [*keys, "p"], "left"
    ).join(F.broadcast(exposures), "entry_date", "left")
    table = table.select(
        *keys, "p", "date", "entry_date", "invested", "marked", "sold",
        F.coalesce("base_exposure", F.lit(1.0)).alias("base_exposure"),
    )
    buy = 1.0 / ((1 + costs.commission) * (1 + costs.slippage))
    keep = (1 - costs.slippage) * (1 - costs.commission - costs.stamp_tax)
    steps = tuple(drawdown_steps)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "date"], kind="stable")
        cash, curve, used = initial, [], []
        for _, rows in pdf.groupby("p", sort=True):
            exposure = rows["base_exposure"].iloc[0] * _feedback(curve)
            invested = exposure * rows["invested"].to_numpy()
            marked = exposure * rows["marked"].to_numpy()
            values = cash * (1 - invested + marked * buy)
            curve.extend(values)
            used.extend([exposure] * len(rows))
            sold = rows["sold"].iloc[0]
            if pd.notna(sold):
                cash *= 1 - invested[0] + exposure * sold * buy * keep
        out = pdf[[*keys, "date", "p"]].copy()
        out["equity"], out["exposure"] = curve, used
        return out

    def _feedback(curve: list) -> float:
        if not curve:
            return 1.0
        equity = np.asarray(curve)
        scale = 1.0
        returns = (equity[1:] / equity[:-1] - 1)[-lookback:]
        if len(returns) >= 2:
            volatility = returns.std() * np.sqrt(ANNUAL)
            if volatility > 0:
                scale = min(1.0, volatility_target / volatility)
        drawdown = equity[-1] / equity.max() - 1
        for level, step in steps:
            if drawdown <= -level:
                return scale * step
        return scale

    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", date date, p int, equity double, exposure double"
    return table.groupBy(*keys).applyInPandas(fold, schema)


def successors(holdings: DataFrame, prices: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """``keys, p, entry_date, succ``: the first later plan at which each basket can be sold.

    A basket can be sold where every name that it bought has a positive open. The plans at
    which a name trades are one bitmap per name; the bitmaps of a basket's names are combined
    by a bitwise aggregate, and the first bit after the basket is its successor. Rows are
    holdings, never pairs of baskets. NULL: no later plan can trade.
    """
    baskets = durable(basket_table(holdings, keys).select(*keys, F.col("p").cast("long").alias("p"), "entry_date"))
    opens = prices.filter(F.col("open") > 0).select("code", F.col("date").alias("entry_date"))
    names = holdings.filter(F.col("weight") > 0).select(*keys, F.col("date").alias("entry_date"), "code").distinct()
    # Opens on the plan days of each scenario, for names that it ever holds.
    held = names.select(*keys, "code").distinct()
    traded = durable(
        opens.join(baskets, "entry_date").join(held, [*keys, "code"], "left_semi").select(*keys, "code", "p")
    )
    bought = durable(names.join(baskets, [*keys, "entry_date"]).join(traded, [*keys, "code", "p"]).select(*keys, "code", "p"))
    bitmaps = positions_bitmap(traded, [*keys, "code"], "p")
    size = bought.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("_names"))
    together = (
        bought.join(bitmaps, [*keys, "code"])
        .groupBy(*keys, "p", "_block")
        .agg(F.bitmap_and_agg("_bits").alias("_bits"), F.count(F.lit(1)).alias("_have"))
        .join(size, [*keys, "p"])
        # A name without a single open in a block leaves it without a common plan.
        .filter(F.col("_have") == F.col("_names"))
    )
    ends = baskets.groupBy(*keys).agg(F.max("p").alias("_last"))
    free = first_position(F.col("_bits"), F.col("_block"), F.col("p") + 1, F.col("_last"))
    ready = together.join(ends, list(keys)).select(*keys, "p", free.alias("succ")).groupBy(*keys, "p").agg(F.min("succ").alias("succ"))
    # A basket that bought nothing hands over at once.
    plan = baskets.join(size, [*keys, "p"], "left").join(ready, [*keys, "p"], "left")
    return plan.select(
        *keys, "p", "entry_date", F.when(F.col("_names").isNotNull(), F.col("succ")).otherwise(F.col("p") + 1).alias("succ")
    )


def executed_baskets(
    holdings: DataFrame, prices: DataFrame, keys: Sequence[str] = ("scenario",)
) -> DataFrame:
    """Holdings of the rebalances that can trade.

    A rebalance waits when a name of the basket in force has no positive open that day;
    the next planned one replaces it. The baskets in force are the chain of successors from
    the first plan on, found by pointer jumping.
    """
    holdings = durable(holdings)
    plan = durable(successors(holdings, prices, keys))
    kept = on_chain(plan, keys, "p", "succ").join(plan.drop("succ"), [*keys, "p"])
    return holdings.join(kept.select(*keys, F.col("entry_date").alias("date")), [*keys, "date"], "left_semi")


def constant_weight_nav(
    targets: DataFrame,
    returns: DataFrame,
    costs: TradingCosts = TradingCosts(),
) -> DataFrame:
    """NAV with weights held constant between rebalances (B4): ``date, ret, cost, nav``.

    ``targets``: ``date, code, weight``; ``returns``: ``date, code, ret_1``. A session earns
    the basket set strictly before it, then pays for its own weight changes.
    """
    calendar = returns.select("date").distinct()
    starts = targets.select(F.col("date").alias("basket_date")).distinct()
    in_force = asof_join(calendar, starts, [], "date", "basket_date", ["basket_date"], strict=True)
    basket = targets.select(F.col("date").alias("basket_date"), "code", "weight")
    legs = F.broadcast(in_force.filter(F.col("basket_date").isNotNull())).join(basket, "basket_date")
    earned = (
        legs.join(returns, ["date", "code"])
        .groupBy("date")
        .agg(F.sum(F.col("weight") * F.coalesce("ret_1", F.lit(0.0))).alias("ret"))
    )
    cost = rebalance_costs(targets, costs)
    w = Window.orderBy("date")
    table = (
        calendar.join(earned, "date", "left").join(cost, "date", "left").fillna(0.0, ["ret", "cost"])
    )
    step = F.log(1 + F.col("ret")) + F.log(1 - F.col("cost"))
    return table.withColumn("nav", F.exp(F.sum(step).over(w)))


def rebalance_costs(targets: DataFrame, costs: TradingCosts = TradingCosts()) -> DataFrame:
    """Share of NAV paid at each rebalance for weights bought and sold."""
    order = Window.orderBy("date")
    baskets = targets.select("date").distinct().withColumn("_p", F.row_number().over(order))
    numbered = targets.join(F.broadcast(baskets), "date").select("_p", "code", "weight")
    moved = numbered.withColumns({"_p": F.col("_p") + 1, "weight": -F.col("weight")})
    change = numbered.unionByName(moved).groupBy("_p", "code").agg(F.sum("weight").alias("_d"))
    buy = F.sum(F.greatest(F.col("_d"), F.lit(0.0)))
    sell = F.sum(F.greatest(-F.col("_d"), F.lit(0.0)))
    per = change.groupBy("_p").agg(
        ((buy + sell) * (costs.commission + costs.slippage) + sell * costs.stamp_tax).alias("cost")
    )
    return baskets.join(per, "_p").select("date", "cost")


def rebased(curve: DataFrame, value: str, initial: float, out: str = "benchmark") -> DataFrame:
    """Series scaled to start at ``initial``."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve.select("date", (F.lit(initial) * ratio(value, F.first(value).over(w))).alias(out))


def account_value(positions: DataFrame, marks: DataFrame, cash: float) -> DataFrame:
    """Marked account per date (B9): ``date, market_value, equity, daily_return``.

    ``positions``: ``date, code, quantity``; ``marks`` carry the last price per code.
    """
    valued = asof_join(positions, marks, ["code"], "date", "price_date", ["price"])
    daily = valued.groupBy("date").agg(
        F.sum(F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("market_value")
    )
    equity = F.col("market_value") + F.lit(cash)
    w = Window.orderBy("date")
    return daily.withColumn("equity", equity).withColumn(
        "daily_return", F.coalesce(ratio("equity", F.lag("equity").over(w)) - 1, F.lit(0.0))
    )
