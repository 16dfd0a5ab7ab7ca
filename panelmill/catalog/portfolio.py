"""Target portfolios, regimes, returns and performance metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.groups import durable
from ..operators import construct as pc
from ..operators import cross_section as xs
from ..operators import factor_stats as fs
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import returns as rt
from ..operators import risk as rk
from ..operators import timeseries as ts
from ..sources import market
from .cross import RULE, score_table, scores, scoring_panel
from .joins import at_signals, equal_baskets
from .kit import ask, cte, query
from .stats import event_labels, events_of

QUERIES: dict = {}
SQL: dict = {}
INITIAL = 100_000.0


# ---------------------------------------------------------------- target weights


@query(QUERIES, "equal_weight_targets")
def equal_weight_targets(spark, sf_dir):
    return equal_baskets(spark, sf_dir)


SQL["equal_weight_targets"] = ask(
    "baskets", "SELECT * FROM baskets", "date signal_date code r:weight r:composite_score"
)


def industry_targets(spark, sf_dir, table=None):
    chosen, _ = at_signals(spark, sf_dir, table)
    members = market.universe(spark, sf_dir).select("code", "industry")
    return pc.industry_neutral(chosen.join(members, "code", "left").fillna("Unknown", ["industry"]))


@query(QUERIES, "industry_neutral_targets")
def industry_neutral_targets(spark, sf_dir):
    return industry_targets(spark, sf_dir)


cte("signal_scores", "SELECT i.*, e.entry_date FROM industry_scores i JOIN events e ON e.signal_date = i.date", "industry_scores", "events")
cte(
    "leaders",
    """SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC, industry) AS lr,
       coalesce(sum(size) OVER (PARTITION BY date ORDER BY composite_score DESC, industry
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM (SELECT *, count(*) OVER (PARTITION BY date, industry) AS size FROM signal_scores) WHERE industry_rank = 1""",
    "signal_scores",
)
cte(
    "industry_targets",
    """SELECT date, code, industry, composite_score, industry_rank, entry_date,
       least(least(1.0 / max(lr) OVER (PARTITION BY date), 0.25) / count(*) OVER (PARTITION BY date, industry), 0.10) AS weight
       FROM (SELECT s.*, l.lr, row_number() OVER (PARTITION BY s.date ORDER BY s.industry_rank, l.lr) AS place
             FROM signal_scores s JOIN leaders l ON s.date = l.date AND s.industry = l.industry
             WHERE l.lr <= 5 OR (l.lr <= 20 AND l.before < 20)) WHERE place <= 20""",
    "signal_scores", "leaders",
)
SQL["industry_neutral_targets"] = ask(
    "industry_targets", "SELECT * FROM industry_targets",
    "date code industry r:weight r:composite_score i:industry_rank",
)


@query(QUERIES, "industry_exposure")
def industry_exposure(spark, sf_dir):
    table = score_table(spark, sf_dir)
    held = industry_targets(spark, sf_dir, table)
    chosen, _ = at_signals(spark, sf_dir, table)
    members = market.universe(spark, sf_dir).select("code", "industry")
    eligible = chosen.filter(F.col("composite_score").isNotNull()).join(members, "code")
    return fs.active_exposure(fs.group_exposure(held), fs.equal_weight_shares(eligible))


SQL["industry_exposure"] = ask(
    "industry_targets signal_scores",
    """SELECT date, industry, coalesce(p, 0) AS portfolio_weight, coalesce(b, 0) AS benchmark_weight,
       coalesce(p, 0) - coalesce(b, 0) AS active_weight
       FROM (SELECT date, industry, sum(weight) AS p FROM industry_targets GROUP BY 1, 2)
       FULL JOIN (SELECT date, industry, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY date) AS b
                  FROM signal_scores GROUP BY date, industry) USING (date, industry)""",
    "date industry r:portfolio_weight r:benchmark_weight r:active_weight",
)


@query(QUERIES, "sector_weight_sums")
def sector_weight_sums(spark, sf_dir):
    members = market.universe(spark, sf_dir).select("code", "sector")
    return fs.group_exposure(equal_baskets(spark, sf_dir).join(members, "code"), "sector")


SQL["sector_weight_sums"] = ask(
    "baskets universe",
    "SELECT date, sector, sum(weight) AS portfolio_weight FROM baskets JOIN universe USING (code) GROUP BY 1, 2",
    "date sector r:portfolio_weight",
)


@query(QUERIES, "equal_industry_shares")
def equal_industry_shares(spark, sf_dir):
    members = market.universe(spark, sf_dir).select("code", "industry")
    return fs.equal_weight_shares(market.bars(spark, sf_dir).join(members, "code"))


SQL["equal_industry_shares"] = ask(
    "bars universe",
    """SELECT date, industry, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY date) AS benchmark_weight
       FROM bars JOIN universe USING (code) GROUP BY date, industry""",
    "date industry r:benchmark_weight",
)


@query(QUERIES, "basket_turnover")
def basket_turnover(spark, sf_dir):
    return pc.turnover(durable(equal_baskets(spark, sf_dir)))


SQL["basket_turnover"] = ask(
    "baskets",
    """WITH k AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM baskets)),
       b AS (SELECT k.p, k.date, code, weight FROM baskets JOIN k USING (date))
       SELECT k.date, 0.5 * sum(abs(coalesce(c.weight, 0) - coalesce(o.weight, 0))) AS turnover
       FROM (SELECT p, code FROM b UNION SELECT p + 1, code FROM b) n JOIN k USING (p)
       LEFT JOIN b c ON c.p = n.p AND c.code = n.code LEFT JOIN b o ON o.p = n.p - 1 AND o.code = n.code
       GROUP BY k.date""",
    "date r:turnover",
)


@query(QUERIES, "next_session_plan")
def next_session_plan(spark, sf_dir):
    return pc.next_session_plan(scores(spark, sf_dir))


SQL["next_session_plan"] = ask(
    "scores",
    """SELECT date AS signal_date, CAST(date + INTERVAL 1 DAY AS DATE) AS execution_date, code, 1.0 / count(*) OVER () AS weight
       FROM (SELECT *, row_number() OVER (ORDER BY composite_score DESC, code) AS rk FROM scores
             WHERE date = (SELECT max(date) FROM scores) AND composite_score IS NOT NULL) WHERE rk <= 20""",
    "signal_date execution_date code r:weight",
)


# ---------------------------------------------------------------- regimes and risk


@query(QUERIES, "market_regime")
def market_regime(spark, sf_dir):
    breadth = ts.breadth(market.bars(spark, sf_dir))
    return rk.market_regime(market.benchmark(spark, sf_dir), breadth)


def _ma(n: int) -> str:
    w = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN avg(close) {w} END"


cte(
    "regime_base",
    f"""SELECT *, coalesce(close / ma - 1, 0) AS trend,
        CASE WHEN count(r) OVER v >= 2 THEN stddev_pop(r) OVER v * sqrt(252) ELSE 0 END AS volatility
        FROM (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r, {_ma(200)} AS ma FROM bench)
        WINDOW v AS (ORDER BY date ROWS 19 PRECEDING)""",
    "bench",
)
cte(
    "regime",
    """SELECT date, close, trend, breadth, volatility,
       CASE WHEN volatility >= 0.30 THEN 'high_volatility' WHEN trend > 0 AND breadth >= 0.55 THEN 'bull'
            WHEN trend < 0 AND breadth <= 0.45 THEN 'bear' ELSE 'sideways' END AS state,
       CASE WHEN volatility >= 0.30 THEN 0.5 WHEN trend > 0 AND breadth >= 0.55 THEN 1.0
            WHEN trend < 0 AND breadth <= 0.45 THEN 0.4 ELSE 0.7 END AS exposure
       FROM (SELECT r.*, least(greatest(coalesce(b.breadth, 0.5), 0), 1) AS breadth
             FROM regime_base r ASOF LEFT JOIN breadth b ON r.date >= b.date)""",
    "regime_base", "breadth",
)
SQL["market_regime"] = ask(
    "regime", "SELECT * FROM regime", "date state r:exposure r:close r:trend r:breadth r:volatility"
)


@query(QUERIES, "moving_average_regime")
def moving_average_regime(spark, sf_dir):
    return rk.moving_average_regime(market.benchmark(spark, sf_dir))


cte(
    "ma_regime",
    f"""SELECT *, CASE WHEN ma200 IS NULL THEN 'Neutral'
          WHEN close >= ma60 AND close >= ma120 AND close >= ma200 AND ma20 >= ma60 THEN 'Bull'
          WHEN close <= ma60 AND close <= ma120 AND close <= ma200 AND ma20 <= ma60 THEN 'Bear' ELSE 'Neutral' END AS state
        FROM (SELECT date, close, {_ma(20)} AS ma20, {_ma(60)} AS ma60, {_ma(120)} AS ma120, {_ma(200)} AS ma200 FROM bench)""",
    "bench",
)
_STATE_EXPOSURE = "CASE state WHEN 'Bull' THEN 1.0 WHEN 'Bear' THEN 0.4 ELSE 0.7 END"
SQL["moving_average_regime"] = ask(
    "ma_regime", f"SELECT *, {_STATE_EXPOSURE} AS exposure FROM ma_regime",
    "date r:close r:ma20 r:ma60 r:ma120 r:ma200 state r:exposure",
)


@query(QUERIES, "trend_exposure")
def trend_exposure(spark, sf_dir):
    bench = market.benchmark(spark, sf_dir)
    return rk.trend_exposure(bench).join(rk.risk_on(bench), "date")


cte(
    "trend_exposure",
    f"""SELECT date, CASE WHEN close < ma THEN 0.5 ELSE 1.0 END AS exposure, coalesce(close > m60, false) AS risk_on
        FROM (SELECT date, close, {_ma(200)} AS ma, {_ma(60)} AS m60 FROM bench)""",
    "bench",
)
SQL["trend_exposure"] = ask("trend_exposure", "SELECT * FROM trend_exposure", "date r:exposure risk_on")


@query(QUERIES, "realized_volatility_scale")
def realized_volatility_scale(spark, sf_dir):
    curve = market.benchmark(spark, sf_dir).withColumnRenamed("close", "equity")
    df = rk.trailing_volatility(curve, "equity", 60, "volatility")
    return df.select("date", "volatility", rk.volatility_scale(F.col("volatility"), 0.20).alias("scale"))


cte(
    "vol60",
    """SELECT date, close, CASE WHEN count(r) OVER v >= 2 THEN stddev_pop(r) OVER v * sqrt(252) ELSE 0 END AS volatility
       FROM (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench)
       WINDOW v AS (ORDER BY date ROWS 59 PRECEDING)""",
    "bench",
)
SQL["realized_volatility_scale"] = ask(
    "vol60", "SELECT date, volatility, CASE WHEN volatility > 0.20 THEN 0.20 / volatility ELSE 1 END AS scale FROM vol60",
    "date r:volatility r:scale",
)


@query(QUERIES, "combined_risk_exposure")
def combined_risk_exposure(spark, sf_dir):
    bench = market.benchmark(spark, sf_dir)
    return rk.risk_decisions(bench, bench.withColumnRenamed("close", "equity"))


SQL["combined_risk_exposure"] = ask(
    "vol60 ma_regime",
    f"""SELECT *, regime_exposure * volatility_scale * drawdown_scale AS exposure FROM (
          SELECT date, equity, realized_volatility, drawdown, state, regime_exposure,
            CASE WHEN realized_volatility > 0.15 THEN 0.15 / realized_volatility ELSE 1 END AS volatility_scale,
            CASE WHEN drawdown <= -0.20 THEN 0.5 WHEN drawdown <= -0.10 THEN 0.7 ELSE 1 END AS drawdown_scale
          FROM (SELECT v.date, v.close AS equity, v.volatility AS realized_volatility,
                  v.close / max(v.close) OVER (ORDER BY v.date) - 1 AS drawdown, m.state,
                  {_STATE_EXPOSURE.replace('state', 'm.state', 1)} AS regime_exposure
                FROM vol60 v JOIN ma_regime m USING (date)))""",
    "date r:equity r:realized_volatility r:drawdown state r:regime_exposure r:volatility_scale "
    "r:drawdown_scale r:exposure",
)


@query(QUERIES, "capped_scaled_weights")
def capped_scaled_weights(spark, sf_dir):
    held = durable(equal_baskets(spark, sf_dir, n=8))
    level = rk.trend_exposure(market.benchmark(spark, sf_dir)).withColumnRenamed("date", "_d")
    seen = jn.asof_join(held.select("signal_date").distinct(), level, [], "signal_date", "_d", ["exposure"])
    df = held.join(F.broadcast(seen), "signal_date")
    return rk.capped_weights(df, F.coalesce("exposure", F.lit(1.0))).select("date", "code", "weight")


cte(
    "baskets8",
    """SELECT e.entry_date AS date, e.signal_date, s.code, 1.0 / count(*) OVER (PARTITION BY e.entry_date) AS weight
       FROM events e JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC, code) AS rk
         FROM scores WHERE composite_score IS NOT NULL) s ON s.date = e.signal_date WHERE rk <= 8""",
    "events", "scores",
)
SQL["capped_scaled_weights"] = ask(
    "baskets8 trend_exposure",
    """SELECT b.date, b.code, least(b.weight, 0.10) * coalesce(t.exposure, 1) AS weight
       FROM baskets8 b ASOF LEFT JOIN trend_exposure t ON b.signal_date >= t.date""",
    "date code r:weight",
)


# ---------------------------------------------------------------- candidates and allocation


def candidates(spark, sf_dir):
    """Score, calibrated prediction, industry, risk and regime on each signal date."""
    table = score_table(spark, sf_dir)
    chosen, events = at_signals(spark, sf_dir, table)
    known, _ = event_labels(spark, sf_dir, table)
    fit = lb.calibration(known, events.select(F.col("signal_date")).distinct(), min_obs=10)
    regimes = rk.market_regime(
        market.benchmark(spark, sf_dir), ts.breadth(market.bars(spark, sf_dir))
    ).select(F.col("date").alias("_rd"), "state", F.col("exposure").alias("_e"))
    states = jn.asof_join(fit, regimes, [], "signal_date", "_rd", ["state", "_e"])
    members = market.universe(spark, sf_dir).select("code", "industry")
    df = chosen.filter(F.col("composite_score").isNotNull()).join(
        F.broadcast(states.withColumnRenamed("signal_date", "date")), "date"
    )
    return df.join(members, "code", "left").select(
        "date", "entry_date", "code",
        F.col("composite_score").alias("score"),
        (F.col("intercept") + F.col("slope") * F.col("composite_score")).alias("model_prediction"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"),
        (1 - F.coalesce("_e", F.lit(0.7))).alias("risk"),
        F.coalesce("state", F.lit("sideways")).alias("regime"),
    )


@query(QUERIES, "candidate_ranking")
def candidate_ranking(spark, sf_dir):
    return candidates(spark, sf_dir).drop("entry_date")


cte(
    "calibration10",
    """SELECT signal_date, CASE WHEN count(score) >= 10 AND max(score) > min(score) THEN regr_slope(future_return, score) END AS slope,
       CASE WHEN count(score) >= 10 AND max(score) > min(score) THEN regr_intercept(future_return, score) END AS intercept
       FROM (SELECT e.signal_date, l.score, l.future_return FROM events e LEFT JOIN event_labels l ON l.exit_date < e.signal_date)
       GROUP BY signal_date""",
    "events", "event_labels",
)
cte(
    "candidates",
    """SELECT s.date, s.entry_date, s.code, s.composite_score AS score, c.intercept + c.slope * s.composite_score AS model_prediction,
       s.industry, 1 - coalesce(r.exposure, 0.7) AS risk, coalesce(r.state, 'sideways') AS regime
       FROM signal_scores s JOIN calibration10 c ON c.signal_date = s.date
       ASOF LEFT JOIN regime r ON s.date >= r.date""",
    "signal_scores", "calibration10", "regime",
)
SQL["candidate_ranking"] = ask(
    "candidates", "SELECT * FROM candidates", "date code r:score r:model_prediction industry r:risk regime"
)


@query(QUERIES, "allocator_holdings")
def allocator_holdings(spark, sf_dir):
    return pc.allocate(candidates(spark, sf_dir)).drop("model_score")


def _avg_rank(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) "
        f"+ (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    )


cte(
    "allocation",
    f"""SELECT date, code, least(w * CASE WHEN sum(w) OVER g > 0.25 THEN 0.25 / sum(w) OVER g ELSE 1 END, 0.10) AS weight,
        industry, risk AS risk_score, regime
        FROM (SELECT *, raw / sum(raw) OVER (PARTITION BY date) * (1 - CASE regime WHEN 'bull' THEN 0 WHEN 'bear' THEN 0.6
                WHEN 'high_volatility' THEN 0.5 ELSE 0.3 END) AS w
              FROM (SELECT *, quality * (1 - risk) AS raw, row_number() OVER (PARTITION BY date ORDER BY quality DESC, code) AS rk
                    FROM (SELECT *, CASE WHEN count(model_prediction) OVER (PARTITION BY date) > 0
                            THEN 0.5 * sr + 0.5 * coalesce(mr, 0.5) ELSE sr END AS quality
                          FROM (SELECT *, {_avg_rank('score')} AS sr, {_avg_rank('model_prediction')} AS mr FROM candidates)))
              WHERE rk <= 20)
        WINDOW g AS (PARTITION BY date, industry)""",
    "candidates",
)
SQL["allocator_holdings"] = ask(
    "allocation", "SELECT * FROM allocation", "date code r:weight industry r:risk_score regime"
)


# ---------------------------------------------------------------- execution tables


@query(QUERIES, "tradeability_flags")
def tradeability_flags(spark, sf_dir):
    bars = ts.with_changes(market.bars(spark, sf_dir))
    return pc.tradeability(bars).select("date", "code", "can_buy", "can_sell")


SQL["tradeability_flags"] = ask(
    "changes",
    """SELECT date, code, open > 0 AND volume > 0 AND NOT coalesce(close / prev_close - 1 >= 0.10 - 1e-12, false) AS can_buy,
       open > 0 AND volume > 0 AND NOT coalesce(close / prev_close - 1 <= -0.10 + 1e-12, false) AS can_sell FROM changes""",
    "date code can_buy can_sell",
)


@query(QUERIES, "trade_cost_table")
def trade_cost_table(spark, sf_dir):
    """Every order line as a proposed trade in the weekly bar of its supplier."""
    lines = market.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (100 + F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("open"),
        (F.col("l_extendedprice") * 100).alias("amount"),
        (F.col("l_quantity") * 40).alias("quantity"),
    )
    costs = pc.execution_costs(lines)
    return costs.groupBy("side", "slippage").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("filled").cast("double").alias("filled"),
        F.sum("notional").alias("notional"), F.sum("commission").alias("commission"), F.sum("tax").alias("tax"),
    )


SQL["trade_cost_table"] = ask(
    "",
    """SELECT side, slippage, count(*) AS orders, sum(filled) AS filled, sum(notional) AS notional,
       sum(CASE WHEN filled > 0 THEN greatest(notional * 0.0003, 5) ELSE 0 END) AS commission,
       sum(CASE WHEN side = 'sell' THEN notional * 0.0005 ELSE 0 END) AS tax
       FROM (SELECT *, filled * open * (1 + CASE WHEN side = 'buy' THEN slippage ELSE -slippage END) AS notional
             FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
                     100 + l_extendedprice / l_quantity / 1000 AS open, floor(l_quantity * 40 / 100) * 100 AS filled,
                     CASE WHEN l_extendedprice * 100 < 5000000 THEN 0.002::DOUBLE ELSE 0.001::DOUBLE END AS slippage FROM lineitem))
       GROUP BY side, slippage""",
    "side r:slippage i:orders r:filled r:notional r:commission r:tax",
)


@query(QUERIES, "sellable_quantity")
def sellable_quantity(spark, sf_dir):
    fills = market.trades(spark, sf_dir).select(
        market.pad_code("supplier").alias("code"), "date", "quantity"
    )
    return pc.sellable_quantity(fills)


SQL["sellable_quantity"] = ask(
    "bars",
    """SELECT code, date, volume AS net, coalesce(sum(volume) OVER (PARTITION BY code ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sellable FROM bars""",
    "code date r:net r:sellable",
)


@query(QUERIES, "target_share_lots")
def target_share_lots(spark, sf_dir):
    held = jn.price_at(equal_baskets(spark, sf_dir), market.bars(spark, sf_dir), "date", "open", "price")
    held = held.filter(F.col("price").isNotNull())
    return pc.target_shares(held, F.lit(1_000_000.0)).select("date", "code", "weight", F.col("shares").cast("bigint").alias("shares"))


SQL["target_share_lots"] = ask(
    "baskets bars",
    """SELECT b.date, b.code, b.weight, floor(b.weight * 1000000 / (r.open * 100)) * 100 AS shares
       FROM baskets b JOIN bars r ON r.code = b.code AND r.date = b.date""",
    "date code r:weight i:shares",
)


@query(QUERIES, "account_marks")
def account_marks(spark, sf_dir):
    """Lots bought at each rebalance, marked at the last known close of every session."""
    bars = market.bars(spark, sf_dir)
    held = jn.price_at(equal_baskets(spark, sf_dir), bars, "date", "open", "price").filter("price IS NOT NULL")
    lots = pc.target_shares(held, F.lit(1_000_000.0)).select("date", "code", F.col("shares").alias("quantity"))
    positions = jn.carry_basket(durable(lots), market.calendar(spark, sf_dir)).select("date", "code", "quantity")
    marks = bars.select("code", F.col("date").alias("price_date"), F.col("close").alias("price"))
    return rt.account_value(positions, marks, 1000.0)


SQL["account_marks"] = ask(
    "baskets bars score_days",
    """WITH lots AS (SELECT b.date, b.code, floor(b.weight * 1000000 / (r.open * 100)) * 100 AS quantity
                     FROM baskets b JOIN bars r ON r.code = b.code AND r.date = b.date),
       pos AS (SELECT d.date, l.code, l.quantity FROM score_days d ASOF JOIN (SELECT DISTINCT date FROM lots) k
               ON d.date >= k.date JOIN lots l ON l.date = k.date),
       val AS (SELECT p.date, sum(p.quantity * coalesce(m.close, 0)) AS market_value
               FROM pos p ASOF LEFT JOIN bars m ON m.code = p.code AND p.date >= m.date GROUP BY p.date)
       SELECT date, market_value, market_value + 1000 AS equity,
         coalesce((market_value + 1000) / (lag(market_value) OVER (ORDER BY date) + 1000) - 1, 0) AS daily_return FROM val""",
    "date r:market_value r:equity r:daily_return",
)


# ---------------------------------------------------------------- returns


def _as_scenario(held, name):
    return held.select(F.lit(name).alias("scenario"), "date", "code", "weight")


def baskets_of_two(spark, sf_dir):
    """Equal-weight and industry-neutral holdings as two scenarios."""
    table = score_table(spark, sf_dir)
    equal = _as_scenario(equal_baskets(spark, sf_dir, table=table), "equal_weight")
    entries = F.broadcast(
        events_of(spark, sf_dir).select(F.col("signal_date").alias("date"), "entry_date")
    )
    neutral = industry_targets(spark, sf_dir, table).join(entries, "date")
    neutral = neutral.drop("date").withColumnRenamed("entry_date", "date")
    return equal.unionByName(_as_scenario(neutral, "industry_neutral"))


def prices(spark, sf_dir):
    return market.bars(spark, sf_dir).select("code", "date", "open", "close")


def curves(spark, sf_dir):
    return rt.equity_curve(
        baskets_of_two(spark, sf_dir), prices(spark, sf_dir), initial=INITIAL, from_start=True,
        calendar=market.calendar(spark, sf_dir),
    )


@query(QUERIES, "equity_from_targets")
def equity_from_targets(spark, sf_dir):
    return curves(spark, sf_dir)


cte(
    "two_baskets",
    """SELECT 'equal_weight' AS scenario, date, code, weight FROM baskets
       UNION ALL SELECT 'industry_neutral', entry_date, code, weight FROM industry_targets""",
    "baskets", "industry_targets",
)
_C, _T, _S = 0.0003, 0.0005, 0.001
_K1 = f"(1 / ((1 + {_C}::DOUBLE) * (1 + {_S}::DOUBLE)))"
_KEEP = f"((1 - {_S}::DOUBLE) * (1 - {_C}::DOUBLE - {_T}::DOUBLE))"
cte(
    "basket_spans",
    """SELECT scenario, date AS entry_date, row_number() OVER w AS p, lead(date) OVER w AS next_date
       FROM (SELECT DISTINCT scenario, date FROM two_baskets) WINDOW w AS (PARTITION BY scenario ORDER BY date)""",
    "two_baskets",
)
cte(
    "legs",
    """SELECT s.scenario, s.p, s.entry_date, s.next_date, d.date, d.open, d.close, t.code, t.weight, o.open AS o0
       FROM basket_spans s JOIN two_baskets t ON t.scenario = s.scenario AND t.date = s.entry_date
       JOIN bars o ON o.code = t.code AND o.date = s.entry_date
       JOIN dense d ON d.code = t.code AND d.date >= s.entry_date AND (s.next_date IS NULL OR d.date <= s.next_date)""",
    "basket_spans", "two_baskets", "bars", "dense",
)
cte(
    "exits",
    f"""SELECT scenario, p, sum(weight) AS invested, sum(weight * open / o0) AS sold,
        1 - sum(weight) + sum(weight * open / o0) * {_K1} * {_KEEP} AS factor
        FROM legs WHERE date = next_date GROUP BY 1, 2""",
    "legs",
)
cte(
    "curves",
    f"""SELECT m.scenario, m.date, m.p, {INITIAL} * coalesce(c.carry, 1) * (1 - invested + marked * {_K1}) AS equity
        FROM (SELECT scenario, p, date, sum(weight) AS invested, sum(weight * close / o0) AS marked
              FROM legs WHERE next_date IS NULL OR date < next_date GROUP BY 1, 2, 3) m
        LEFT JOIN (SELECT scenario, p + 1 AS p, exp(sum(ln(factor)) OVER (PARTITION BY scenario ORDER BY p)) AS carry FROM exits) c
          ON c.scenario = m.scenario AND c.p = m.p
        UNION ALL SELECT s.scenario, d.date, 0, {INITIAL} FROM score_days d JOIN (
          SELECT scenario, min(entry_date) AS first FROM basket_spans GROUP BY 1) s ON d.date < s.first""",
    "legs", "exits", "score_days", "basket_spans",
)
SQL["equity_from_targets"] = ask("curves", "SELECT * FROM curves", "scenario date i:p r:equity")


@query(QUERIES, "rebalance_trading_costs")
def rebalance_trading_costs(spark, sf_dir):
    return rt.trading_costs(baskets_of_two(spark, sf_dir), prices(spark, sf_dir), initial=INITIAL, calendar=market.calendar(spark, sf_dir))


SQL["rebalance_trading_costs"] = ask(
    "two_baskets basket_spans exits legs",
    f"""SELECT scenario, entry_date AS date, cash * invested * (1 - {_K1}) AS buy_cost,
        cash * coalesce(sold, 0) * {_K1} * (1 - {_KEEP}) AS sell_cost
        FROM (SELECT b.scenario, b.entry_date, i.invested, x.sold,
                {INITIAL} * exp(coalesce(sum(ln(x.factor)) OVER (PARTITION BY b.scenario ORDER BY b.p
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cash
              FROM basket_spans b JOIN (SELECT scenario, p, sum(weight) AS invested FROM legs WHERE date = entry_date GROUP BY 1, 2) i
                USING (scenario, p) LEFT JOIN exits x USING (scenario, p))""",
    "scenario date r:buy_cost r:sell_cost",
)


@query(QUERIES, "volatility_controlled_equity")
def volatility_controlled_equity(spark, sf_dir):
    held = baskets_of_two(spark, sf_dir)
    events = events_of(spark, sf_dir)
    level = rk.trend_exposure(market.benchmark(spark, sf_dir)).withColumnRenamed("date", "_d")
    known = jn.asof_join(events, level, [], "signal_date", "_d", ["exposure"]).select(
        "entry_date", F.coalesce("exposure", F.lit(1.0)).alias("base_exposure")
    )
    return rt.controlled_equity(
        held, prices(spark, sf_dir), known, volatility_target=0.20, initial=INITIAL, from_start=True,
        calendar=market.calendar(spark, sf_dir),
    )


@query(QUERIES, "drawdown_controlled_equity")
def drawdown_controlled_equity(spark, sf_dir):
    s = rk.AdvancedRiskSettings()
    held = rk.capped_weights(baskets_of_two(spark, sf_dir), F.lit(1.0), s.max_position)
    events = events_of(spark, sf_dir)
    bench = market.benchmark(spark, sf_dir)
    ma = rk.moving_average_regime(bench).select(F.col("date").alias("_d"), "exposure")
    states = rk.market_regime(bench, ts.breadth(market.bars(spark, sf_dir))).select(
        F.col("date").alias("_r"), F.col("exposure").alias("overlay")
    )
    known = jn.asof_join(events, ma, [], "signal_date", "_d", ["exposure"])
    known = jn.asof_join(known, states, [], "signal_date", "_r", ["overlay"]).select(
        "entry_date",
        (F.coalesce("exposure", F.lit(s.neutral_exposure)) * F.coalesce("overlay", F.lit(0.7))).alias("base_exposure"),
    )
    steps = ((s.drawdown_critical, s.critical_scale), (s.drawdown_warning, s.warning_scale))
    return rt.controlled_equity(
        held, prices(spark, sf_dir), known, s.volatility_target, s.volatility_lookback, steps,
        initial=INITIAL, from_start=True, calendar=market.calendar(spark, sf_dir),
    )


@query(QUERIES, "deferred_rebalances")
def deferred_rebalances(spark, sf_dir):
    """Rebalances that could trade: every held name had an open that day."""
    held = baskets_of_two(spark, sf_dir)
    kept = rt.executed_baskets(held, prices(spark, sf_dir))
    return kept.groupBy("scenario", "date").agg(F.count(F.lit(1)).alias("names"))


SQL["deferred_rebalances"] = ask(
    "two_baskets basket_spans bars",
    """WITH RECURSIVE ready AS (
         SELECT t.scenario, a.p, min(t.q) AS succ FROM (
           SELECT a.scenario, a.p, b.p AS q FROM basket_spans a JOIN basket_spans b ON a.scenario = b.scenario AND b.p > a.p
             JOIN two_baskets t ON t.scenario = a.scenario AND t.date = a.entry_date
             JOIN bars o ON o.code = t.code AND o.date = a.entry_date
             LEFT JOIN bars x ON x.code = t.code AND x.date = b.entry_date
           GROUP BY 1, 2, 3 HAVING count(*) = count(x.code)) t JOIN basket_spans a ON a.scenario = t.scenario AND a.p = t.p
         GROUP BY 1, 2),
       chain AS (SELECT scenario, 1::BIGINT AS p FROM (SELECT DISTINCT scenario FROM basket_spans)
                 UNION ALL SELECT c.scenario, r.succ FROM chain c JOIN ready r ON r.scenario = c.scenario AND r.p = c.p)
       SELECT s.scenario, s.entry_date AS date, count(*) AS names FROM chain c JOIN basket_spans s USING (scenario, p)
       JOIN two_baskets t ON t.scenario = s.scenario AND t.date = s.entry_date GROUP BY 1, 2""",
    "scenario date i:names",
)


def rule_targets(spark, sf_dir):
    scored = xs.rule_score(scoring_panel(spark, sf_dir, ()), RULE).select("date", "code", "prediction")
    dates = events_of(spark, sf_dir).select(F.col("signal_date").alias("date"))
    on = rk.risk_on(market.benchmark(spark, sf_dir))
    return pc.capped_top_n(scored.join(F.broadcast(dates), "date"), on)


@query(QUERIES, "risk_switched_targets")
def risk_switched_targets(spark, sf_dir):
    return rule_targets(spark, sf_dir)


cte(
    "rule_targets",
    """SELECT date, code, risk_on, least(0.10, CASE WHEN risk_on THEN 1.0 ELSE 0.5 END / count(*) OVER (PARTITION BY date)) AS weight
       FROM (SELECT r.*, row_number() OVER (PARTITION BY r.date ORDER BY prediction DESC, code) AS rk
             FROM rule r JOIN events e ON e.signal_date = r.date) JOIN trend_exposure USING (date) WHERE rk <= 20""",
    "rule", "events", "trend_exposure",
)
SQL["risk_switched_targets"] = ask("rule_targets", "SELECT * FROM rule_targets", "date code r:weight risk_on")


@query(QUERIES, "constant_weight_nav")
def constant_weight_nav(spark, sf_dir):
    rets = ts.build_factors(market.bars(spark, sf_dir), ["ret_1"])
    return rt.constant_weight_nav(rule_targets(spark, sf_dir).drop("risk_on"), rets)


SQL["constant_weight_nav"] = ask(
    "rule_targets changes score_days",
    f"""WITH k AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM rule_targets)),
       b AS (SELECT k.p, k.date, code, weight FROM rule_targets JOIN k USING (date)),
       c AS (SELECT k.date, sum(greatest(d, 0) + greatest(-d, 0)) * ({_C}::DOUBLE + {_S}::DOUBLE) + sum(greatest(-d, 0)) * {_T}::DOUBLE AS cost
             FROM (SELECT n.p, coalesce(x.weight, 0) - coalesce(o.weight, 0) AS d
                   FROM (SELECT p, code FROM b UNION SELECT p + 1, code FROM b) n
                   LEFT JOIN b x ON x.p = n.p AND x.code = n.code LEFT JOIN b o ON o.p = n.p - 1 AND o.code = n.code) q
             JOIN k USING (p) GROUP BY k.date),
       e AS (SELECT d.date, sum(b.weight * coalesce(r.ret_1, 0)) AS ret FROM score_days d ASOF JOIN k ON d.date > k.date
             JOIN b ON b.p = k.p JOIN changes r ON r.code = b.code AND r.date = d.date GROUP BY d.date)
       SELECT date, coalesce(ret, 0) AS ret, coalesce(cost, 0) AS cost,
         exp(sum(ln(1 + coalesce(ret, 0)) + ln(1 - coalesce(cost, 0))) OVER (ORDER BY date)) AS nav
       FROM score_days LEFT JOIN e USING (date) LEFT JOIN c USING (date)""",
    "date r:ret r:cost r:nav",
)


@query(QUERIES, "rebased_benchmark")
def rebased_benchmark(spark, sf_dir):
    return rt.rebased(market.benchmark(spark, sf_dir), "close", INITIAL)


cte(
    "bench_curve",
    f"SELECT date, {INITIAL} * close / first_value(close) OVER (ORDER BY date) AS benchmark FROM bench",
    "bench",
)
SQL["rebased_benchmark"] = ask("bench_curve", "SELECT * FROM bench_curve", "date r:benchmark")


@query(QUERIES, "holdings_history")
def holdings_history(spark, sf_dir):
    members = market.universe(spark, sf_dir).select("code", "sector")
    level = rk.trend_exposure(market.benchmark(spark, sf_dir)).withColumnRenamed("date", "_d")
    held = durable(equal_baskets(spark, sf_dir)).join(members, "code", "left")
    seen = jn.asof_join(held.select("signal_date").distinct(), level, [], "signal_date", "_d", ["exposure"])
    return held.join(F.broadcast(seen), "signal_date").select(
        "date", "code", "weight", "composite_score", "sector", "exposure"
    )


SQL["holdings_history"] = ask(
    "baskets universe trend_exposure",
    """SELECT b.date, b.code, b.weight, b.composite_score, u.sector, t.exposure FROM baskets b
       LEFT JOIN universe u USING (code) ASOF LEFT JOIN trend_exposure t ON b.signal_date >= t.date""",
    "date code r:weight r:composite_score sector r:exposure",
)


# ---------------------------------------------------------------- metrics


def bench_curve(spark, sf_dir):
    return rt.rebased(market.benchmark(spark, sf_dir), "close", INITIAL)


@query(QUERIES, "performance_metrics")
def performance_metrics(spark, sf_dir):
    return mt.full_metrics(curves(spark, sf_dir), bench_curve(spark, sf_dir))


cte(
    "curve_returns",
    """SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS drawdown
       FROM curves WINDOW w AS (PARTITION BY scenario ORDER BY date)""",
    "curves",
)
cte(
    "paired",
    """SELECT *, equity / lag(equity) OVER w - 1 AS r, benchmark / lag(benchmark) OVER w - 1 AS b
       FROM curves JOIN bench_curve USING (date) WINDOW w AS (PARTITION BY scenario ORDER BY date)""",
    "curves", "bench_curve",
)
SQL["performance_metrics"] = ask(
    "curve_returns paired",
    """SELECT *, annual_return - benchmark_return AS excess_return FROM (
         SELECT scenario, pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(r)) - 1 AS annual_return,
           stddev_pop(r) * sqrt(252) AS annual_volatility, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe,
           min(drawdown) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0 END) AS win_rate
         FROM curve_returns GROUP BY scenario) JOIN (
         SELECT scenario, pow(arg_max(benchmark, date) / arg_min(benchmark, date), 252.0 / count(b)) - 1 AS benchmark_return,
           covar_pop(r, b) / var_pop(b) AS beta, (avg(r) - covar_pop(r, b) / var_pop(b) * avg(b)) * 252 AS alpha,
           avg(r - b) / stddev_pop(r - b) * sqrt(252) AS information_ratio, count(*) AS observations
         FROM paired GROUP BY scenario) USING (scenario)""",
    "scenario r:annual_return r:annual_volatility r:sharpe r:max_drawdown r:win_rate r:benchmark_return "
    "r:beta r:information_ratio i:observations r:alpha r:excess_return",
)

for _unit, _fmt in (("year", "%Y"), ("month", "%Y-%m")):

    def _returns(spark, sf_dir, unit=_unit):
        return mt.period_returns(curves(spark, sf_dir), bench_curve(spark, sf_dir), unit)

    query(QUERIES, f"returns_by_{_unit}")(_returns)
    SQL[f"returns_by_{_unit}"] = ask(
        "paired",
        f"""SELECT scenario, strftime(date, '{_fmt}') AS {_unit}, arg_max(equity, date) / arg_min(equity, date) - 1 AS strategy_return,
            arg_max(benchmark, date) / arg_min(benchmark, date) - 1 AS benchmark_return,
            arg_max(equity, date) / arg_min(equity, date) - arg_max(benchmark, date) / arg_min(benchmark, date) AS excess_return
            FROM paired GROUP BY 1, 2""",
        f"scenario {_unit} r:strategy_return r:benchmark_return r:excess_return",
    )


@query(QUERIES, "drawdown_series")
def drawdown_series(spark, sf_dir):
    return rk.with_drawdown(curves(spark, sf_dir), "equity", ("scenario",)).select("scenario", "date", "drawdown")


SQL["drawdown_series"] = ask("curve_returns", "SELECT * FROM curve_returns", "scenario date r:drawdown")


@query(QUERIES, "drawdown_periods", text=("recovery_date",))
def drawdown_periods(spark, sf_dir):
    return mt.drawdown_periods(curves(spark, sf_dir), keys=("scenario",))


def _dd_sql(source: str, value: str, key: str = "scenario") -> str:
    return f"""SELECT {key}, peak_date, trough_date, recovery_date, drawdown, coalesce(back, last_i) - first_i AS duration_days FROM (
        SELECT *, lead(peak_date) OVER (PARTITION BY {key} ORDER BY g) AS recovery_date, lead(first_i) OVER (PARTITION BY {key} ORDER BY g) AS back
        FROM (SELECT {key}, g, min(date) AS peak_date, min(i) AS first_i, max(i) AS last_i, count(*) AS n,
                arg_min(date, row({value}, i)) AS trough_date, min({value}) / arg_min({value}, i) - 1 AS drawdown
              FROM (SELECT *, sum(CASE WHEN peak THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g
                    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i,
                      coalesce({value} >= max({value}) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS peak
                      FROM {source})) GROUP BY {key}, g)) WHERE n > 1"""


SQL["drawdown_periods"] = ask(
    "curves", _dd_sql("curves", "equity"),
    "scenario peak_date trough_date s:recovery_date r:drawdown i:duration_days",
)


@query(QUERIES, "worst_holding_windows")
def worst_holding_windows(spark, sf_dir):
    return mt.worst_holding_periods(curves(spark, sf_dir))


SQL["worst_holding_windows"] = ask(
    "curves",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY "return", end_date) AS rk FROM (
         SELECT scenario, lag(date, 20) OVER w AS start_date, date AS end_date, 20 AS holding_days,
           equity / lag(equity, 20) OVER w - 1 AS "return" FROM curves WINDOW w AS (PARTITION BY scenario ORDER BY date))
         WHERE "return" IS NOT NULL) WHERE rk <= 5""",
    'scenario start_date end_date i:holding_days r:"return"',
)


@query(QUERIES, "daily_pnl_attribution")
def daily_pnl_attribution(spark, sf_dir):
    curve = curves(spark, sf_dir).filter(F.col("scenario") == "equal_weight").drop("scenario")
    index = ts.market_returns(market.benchmark(spark, sf_dir))
    rets = ts.build_factors(market.bars(spark, sf_dir), ["ret_1"])
    factor = rets.groupBy("date").agg((F.avg("ret_1") * 0.1).alias("factor_return"))
    return mt.pnl_decomposition(curve, index, factor)


SQL["daily_pnl_attribution"] = ask(
    "curves market_ret changes",
    """SELECT *, portfolio_pnl - market_effect - factor_effect AS selection_effect FROM (
         SELECT date, coalesce(equity - prior, 0) AS portfolio_pnl, coalesce(prior * coalesce(market_return, 0), 0) AS market_effect,
           coalesce(prior * coalesce(factor_return, 0), 0) AS factor_effect
         FROM (SELECT date, equity, lag(equity) OVER (ORDER BY date) AS prior FROM curves WHERE scenario = 'equal_weight')
         LEFT JOIN market_ret USING (date)
         LEFT JOIN (SELECT date, avg(ret_1) * 0.1 AS factor_return FROM changes GROUP BY date) USING (date))""",
    "date r:portfolio_pnl r:market_effect r:factor_effect r:selection_effect",
)

INDEXES = ("1-URGENT", "3-MEDIUM", "9-MISSING")


@query(QUERIES, "benchmark_comparison")
def benchmark_comparison(spark, sf_dir):
    curve = curves(spark, sf_dir).filter(F.col("scenario") == "equal_weight")
    return mt.benchmark_comparison(curve, market.benchmarks(spark, sf_dir), INDEXES)


SQL["benchmark_comparison"] = ask(
    "curves benches",
    """WITH rel AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, benchmark / lag(benchmark) OVER w - 1 AS b,
              benchmark / max(benchmark) OVER w - 1 AS dd
            FROM (SELECT index_code, date, equity, first_value(equity) OVER v * close / first_value(close) OVER v AS benchmark
                  FROM curves JOIN benches USING (date) WHERE scenario = 'equal_weight' WINDOW v AS (PARTITION BY index_code ORDER BY date))
            WINDOW w AS (PARTITION BY index_code ORDER BY date))
       SELECT n.benchmark, CASE WHEN s.index_code IS NULL THEN 'unavailable' ELSE 'available' END AS status,
         "return", sharpe, drawdown, alpha, beta, information_ratio, coalesce(observations, 0) AS observations
       FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('9-MISSING')) n(benchmark) LEFT JOIN (
         SELECT index_code, pow(arg_max(benchmark, date) / arg_min(benchmark, date), 252.0 / count(b)) - 1 AS "return",
           avg(b) / stddev_pop(b) * sqrt(252) AS sharpe, min(dd) AS drawdown, covar_pop(r, b) / var_pop(b) AS beta,
           (avg(r) - covar_pop(r, b) / var_pop(b) * avg(b)) * 252 AS alpha,
           avg(r - b) / stddev_pop(r - b) * sqrt(252) AS information_ratio, count(*) AS observations
         FROM rel GROUP BY index_code) s ON s.index_code = n.benchmark""",
    'benchmark status r:"return" r:sharpe r:drawdown r:alpha r:beta r:information_ratio i:observations',
)


@query(QUERIES, "walk_forward_result_table")
def walk_forward_result_table(spark, sf_dir):
    curve = curves(spark, sf_dir).filter(F.col("scenario") == "industry_neutral").select("date", "equity")
    return mt.walk_forward_table(curve, market.benchmark(spark, sf_dir))


SQL["walk_forward_result_table"] = ask(
    "curves bench",
    """SELECT *, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS portfolio_return,
       coalesce(benchmark / lag(benchmark) OVER (ORDER BY date) - 1, 0) AS benchmark_return
       FROM (SELECT date, equity, first_value(equity) OVER (ORDER BY date) * close / first_value(close) OVER (ORDER BY date) AS benchmark
             FROM curves JOIN bench USING (date) WHERE scenario = 'industry_neutral')""",
    "date r:equity r:benchmark r:portfolio_return r:benchmark_return",
)


@query(QUERIES, "portfolio_comparison")
def portfolio_comparison(spark, sf_dir):
    both = mt.full_metrics(curves(spark, sf_dir), bench_curve(spark, sf_dir))
    columns = ("annual_return", "sharpe", "max_drawdown", "alpha", "beta")
    return mt.compare_portfolios(
        {n: both.filter(F.col("scenario") == n) for n in ("equal_weight", "industry_neutral")}, columns
    )


SQL["portfolio_comparison"] = (
    "SELECT scenario AS portfolio, annual_return, sharpe, max_drawdown, alpha, beta FROM ("
    + SQL["performance_metrics"] + ") m"
)
