"""Bars and per-instrument rolling factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..sources import market
from .kit import H, SCORING, ask, code_of, cte, full, query, week_of

QUERIES: dict = {}
SQL: dict = {}


def _factors(*names, bench=False, keep=()):
    def run(spark, sf_dir):
        index = market.benchmark(spark, sf_dir) if bench else None
        return ts.build_factors(market.bars(spark, sf_dir), names, index, keep)

    return run


query(QUERIES, "bars_from_trades")(market.bars)
SQL["bars_from_trades"] = ask(
    "bars", "SELECT * FROM bars", "code date r:open r:high r:low r:close r:volume r:amount r:turnover"
)

query(QUERIES, "momentum_factors")(
    _factors("ret_1", "momentum_5", "momentum_20", "momentum_60", "momentum_120")
)
SQL["momentum_factors"] = ask(
    "changes",
    f"""SELECT date, code, ret_1, close / lag(close, 5) {H} - 1 AS momentum_5,
        close / lag(close, 20) {H} - 1 AS momentum_20, close / lag(close, 60) {H} - 1 AS momentum_60,
        close / lag(close, 120) {H} - 1 AS momentum_120 FROM changes""",
    "date code r:ret_1 r:momentum_5 r:momentum_20 r:momentum_60 r:momentum_120",
)

query(QUERIES, "trend_factors")(_factors("trend_20", "trend_60", "trend_120"))
SQL["trend_factors"] = ask(
    "bars",
    f"""SELECT date, code, close / ({full('avg', 'close', 20)}) - 1 AS trend_20,
        close / ({full('avg', 'close', 60)}) - 1 AS trend_60,
        close / ({full('avg', 'close', 120)}) - 1 AS trend_120 FROM bars""",
    "date code r:trend_20 r:trend_60 r:trend_120",
)

query(QUERIES, "volatility_factors")(
    _factors("volatility_20", "volatility_60", "annual_volatility_20")
)
SQL["volatility_factors"] = ask(
    "changes",
    f"""SELECT date, code, {full('stddev_samp', 'ret_1', 20)} AS volatility_20,
        {full('stddev_samp', 'ret_1', 60)} AS volatility_60,
        ({full('stddev_samp', 'ret_1', 20)}) * sqrt(252) AS annual_volatility_20 FROM changes""",
    "date code r:volatility_20 r:volatility_60 r:annual_volatility_20",
)

query(QUERIES, "liquidity_factors")(
    _factors(
        "liquidity_20", "log_liquidity_20", "volume_ratio_20", "turnover_5", "turnover_20",
        "turnover_ma20", "amount_ma20", "volume_change", "amount_change",
    )
)
SQL["liquidity_factors"] = ask(
    "changes",
    f"""SELECT date, code, {full('avg', 'amount', 20)} AS liquidity_20,
        ln(1 + ({full('avg', 'amount', 20)})) AS log_liquidity_20,
        volume / ({full('avg', 'volume', 20)}) AS volume_ratio_20,
        {full('avg', 'turnover', 5)} AS turnover_5, {full('avg', 'turnover', 20)} AS turnover_20,
        {full('avg', 'turnover', 20)} AS turnover_ma20, {full('avg', 'amount', 20)} AS amount_ma20,
        volume_change, amount_change FROM changes""",
    "date code r:liquidity_20 r:log_liquidity_20 r:volume_ratio_20 r:turnover_5 r:turnover_20 "
    "r:turnover_ma20 r:amount_ma20 r:volume_change r:amount_change",
)

query(QUERIES, "drawdown_factors")(
    _factors("drawdown_60", "drawdown_depth_60", "max_drawdown_60", "max_drawdown_120")
)
SQL["drawdown_factors"] = ask(
    "bars",
    f"""SELECT date, code, close / ({full('max', 'close', 60)}) - 1 AS drawdown_60,
        1 - close / ({full('max', 'close', 60)}) AS drawdown_depth_60,
        close / ({full('max', 'close', 60)}) - 1 AS max_drawdown_60,
        close / ({full('max', 'close', 120)}) - 1 AS max_drawdown_120 FROM bars""",
    "date code r:drawdown_60 r:drawdown_depth_60 r:max_drawdown_60 r:max_drawdown_120",
)

query(QUERIES, "oscillator_factors")(
    _factors("rsi_14", "bollinger_position", "atr_14", "volatility_breakout_20")
)
SQL["oscillator_factors"] = ask(
    "changes",
    f"""SELECT date, code,
        CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14,
        CASE WHEN hi > lo THEN (close - (mean - 2 * std)) / (4 * std) END AS bollinger_position,
        atr_14, close / high_20 - 1 AS volatility_breakout_20
        FROM (SELECT *, {full('avg', 'up', 14)} AS gain, {full('avg', 'down', 14)} AS loss,
            {full('avg', 'close', 20)} AS mean, {full('stddev_pop', 'close', 20)} AS std,
            {full('max', 'close', 20)} AS hi, {full('min', 'close', 20)} AS lo,
            {full('avg', 'tr', 14)} AS atr_14, {full('max', 'high', 20)} AS high_20
          FROM (SELECT *, CASE WHEN ret_1 > 0 THEN ret_1 WHEN ret_1 IS NOT NULL THEN 0 END AS up,
                CASE WHEN ret_1 < 0 THEN -ret_1 WHEN ret_1 IS NOT NULL THEN 0 END AS down,
                greatest(high - low, coalesce(abs(high - prev_close), 0),
                         coalesce(abs(low - prev_close), 0)) AS tr FROM changes))""",
    "date code r:rsi_14 r:bollinger_position r:atr_14 r:volatility_breakout_20",
)


@query(QUERIES, "macd_factors")
def macd_factors(spark, sf_dir):
    return ts.build_factors(
        market.bars(spark, sf_dir), ["macd", "macd_signal", "macd_histogram"]
    )


def _ema_sql(x: str, span: int, w: str) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    fold = f"list_reduce(list({x}) {w}, lambda m, v: m * (1 - {a}) + v * {a})"
    return f"CASE WHEN count({x}) {w} >= {span} THEN {fold} END"


_RUN = "OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
_RUN_SEEN = "OVER (PARTITION BY code, macd IS NULL ORDER BY date ROWS UNBOUNDED PRECEDING)"
cte(
    "macd",
    f"""SELECT date, code, macd, CASE WHEN macd IS NOT NULL THEN {_ema_sql('macd', 9, _RUN_SEEN)} END
        AS macd_signal
        FROM (SELECT date, code, ({_ema_sql('close', 12, _RUN)}) - ({_ema_sql('close', 26, _RUN)}) AS macd
              FROM bars)""",
    "bars",
)
SQL["macd_factors"] = ask(
    "macd",
    "SELECT *, macd - macd_signal AS macd_histogram FROM macd",
    "date code r:macd r:macd_signal r:macd_histogram",
)

cte("market_ret", "SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS market_return FROM bench", "bench")


def _beta_sql(n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(CASE WHEN ret_1 IS NOT NULL AND market_return IS NOT NULL THEN 1 END) {w} = {n} "
        f"AND var_pop(market_return) {w} > 0 "
        f"THEN covar_pop(ret_1, market_return) {w} / var_pop(market_return) {w} END"
    )


query(QUERIES, "market_beta_factors")(_factors("beta_60", "beta_120", bench=True))
SQL["market_beta_factors"] = ask(
    "changes market_ret",
    f"""SELECT date, code, {_beta_sql(60)} AS beta_60, {_beta_sql(120)} AS beta_120
        FROM changes LEFT JOIN market_ret USING (date)""",
    "date code r:beta_60 r:beta_120",
)


@query(QUERIES, "scoring_factor_panel")
def scoring_factor_panel(spark, sf_dir):
    return ts.build_factors(market.bars(spark, sf_dir), ts.SCORING_FACTORS, keep=["close"])


SQL["scoring_factor_panel"] = ask(
    "scoring", "SELECT * FROM scoring", "date code r:close " + " ".join(f"r:{f}" for f in SCORING)
)

cte(
    "research20",
    f"""SELECT s.date, s.code, s.close, s.momentum_5, s.momentum_20, s.momentum_60,
        s.close / lag(s.close, 120) OVER h - 1 AS momentum_120, s.trend_20, s.trend_60,
        s.close / (CASE WHEN count(*) OVER w120 = 120 THEN avg(s.close) OVER w120 END) - 1 AS trend_120,
        s.volatility AS volatility_20,
        CASE WHEN count(s.ret_1) OVER w60 = 60 THEN stddev_samp(s.ret_1) OVER w60 END AS volatility_60,
        CASE WHEN count(*) OVER w14 = 14 THEN avg(x.tr) OVER w14 END AS atr_14,
        CASE WHEN count(s.ret_1) OVER w14 = 14 THEN CASE WHEN avg(x.down) OVER w14 = 0 THEN 100
             ELSE 100 - 100 / (1 + avg(x.up) OVER w14 / avg(x.down) OVER w14) END END AS rsi_14,
        m.macd, CASE WHEN count(*) OVER w5 = 5 THEN avg(x.turnover) OVER w5 END AS turnover_5,
        s.turnover AS turnover_20, x.amount_change,
        s.volume / (CASE WHEN count(*) OVER w20 = 20 THEN avg(s.volume) OVER w20 END) AS volume_ratio,
        CASE WHEN count(b.market_return + s.ret_1) OVER w60 = 60 AND var_pop(b.market_return) OVER w60 > 0
             THEN covar_pop(s.ret_1, b.market_return) OVER w60 / var_pop(b.market_return) OVER w60 END AS beta_60,
        CASE WHEN count(b.market_return + s.ret_1) OVER w120 = 120 AND var_pop(b.market_return) OVER w120 > 0
             THEN covar_pop(s.ret_1, b.market_return) OVER w120 / var_pop(b.market_return) OVER w120 END AS beta_120,
        s.drawdown AS max_drawdown_60,
        s.close / (CASE WHEN count(*) OVER w120 = 120 THEN max(s.close) OVER w120 END) - 1 AS max_drawdown_120
      FROM scoring s JOIN macd m USING (date, code) JOIN (
        SELECT *, CASE WHEN ret_1 > 0 THEN ret_1 WHEN ret_1 IS NOT NULL THEN 0 END AS up,
               CASE WHEN ret_1 < 0 THEN -ret_1 WHEN ret_1 IS NOT NULL THEN 0 END AS down,
               greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0)) AS tr
        FROM changes) x USING (date, code) LEFT JOIN market_ret b USING (date)
      WINDOW h AS (PARTITION BY code ORDER BY date),
        w5 AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING),
        w14 AS (PARTITION BY code ORDER BY date ROWS 13 PRECEDING),
        w20 AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING),
        w60 AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING),
        w120 AS (PARTITION BY code ORDER BY date ROWS 119 PRECEDING)""",
    "scoring", "macd", "changes", "market_ret",
)


@query(QUERIES, "research_factor_panel")
def research_factor_panel(spark, sf_dir):
    return ts.build_factors(
        market.bars(spark, sf_dir), ts.RESEARCH_FACTORS, market.benchmark(spark, sf_dir)
    )


SQL["research_factor_panel"] = ask(
    "research20", "SELECT * FROM research20", "date code " + " ".join(f"r:{f}" for f in ts.RESEARCH_FACTORS)
)


@query(QUERIES, "market_breadth")
def market_breadth(spark, sf_dir):
    return ts.breadth(market.bars(spark, sf_dir))


cte(
    "breadth",
    f"""SELECT date, avg(CAST(above AS DOUBLE)) AS breadth
        FROM (SELECT date, close > ({full('avg', 'close', 20)}) AS above FROM bars)
        WHERE above IS NOT NULL GROUP BY date""",
    "bars",
)
SQL["market_breadth"] = ask("breadth", "SELECT * FROM breadth", "date r:breadth")


@query(QUERIES, "breadth_as_of")
def breadth_as_of(spark, sf_dir):
    return ts.latest_breadth(market.bars(spark, sf_dir), "1999-06-30")


SQL["breadth_as_of"] = ask(
    "bars",
    f"""SELECT coalesce(avg(CAST(above AS DOUBLE)), 0.5) AS breadth FROM (
          SELECT code, arg_max(above, date) AS above FROM (
            SELECT code, date, close > ({full('avg', 'close', 20)}) AS above
            FROM bars WHERE date <= DATE '1999-06-30') WHERE above IS NOT NULL GROUP BY code)""",
    "r:breadth",
)


def _reversal():
    """A user factor: negative of the last session's move, scaled by its volatility."""
    return -F.try_divide(F.col("ret_1"), ts.volatility(20))


@query(QUERIES, "registered_user_factor")
def registered_user_factor(spark, sf_dir):
    ts.register_factor("scaled_reversal", _reversal)
    return ts.build_factors(market.bars(spark, sf_dir), ["scaled_reversal"])


SQL["registered_user_factor"] = ask(
    "changes",
    f"""SELECT date, code, -ret_1 / nullif({full('stddev_samp', 'ret_1', 20)}, 0) AS scaled_reversal
        FROM changes""",
    "date code r:scaled_reversal",
)


# ---------------------------------------------------------------- bars with bad values

DIRTY = (
    "momentum_20", "trend_20", "trend_60", "volatility_20", "volatility_60", "liquidity_20", "volume_ratio_20", "turnover_5",
    "turnover_20", "drawdown_60", "beta_60",
)


def dirty_bars(spark, sf_dir):
    """Bars of trades without quantity, with NaN, infinities and extreme values set by rule."""
    lines = market.table(spark, sf_dir, "lineitem")
    lines = lines.withColumn("l_quantity", F.when(F.col("l_orderkey") % 37 == 0, 0.0).otherwise(F.col("l_quantity")))
    bars = market.bars_from_trades(market.trades_of(lines), "supplier")
    week = (F.datediff("date", F.lit("1992-01-06").cast("date")) / 7).cast("long") + F.col("supplier")
    hit = lambda n: week % n == 0
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    bars = bars.withColumns(
        {
            "close": F.when(hit(97), nan).otherwise(F.col("close")),
            "amount": F.when(hit(101), inf).when(hit(89), F.col("amount") * 1e6).otherwise(F.col("amount")),
            "turnover": F.when(hit(103), nan).otherwise(F.col("turnover")),
            "volume": F.when(hit(107), -inf).otherwise(F.col("volume")),
        }
    )
    return bars.withColumn("supplier", market.pad_code("supplier")).withColumnRenamed("supplier", "code")


@query(QUERIES, "dirty_bar_factors")
def dirty_bar_factors(spark, sf_dir):
    """Rolling factors over bad bars: what is not finite is missing in its own windows only."""
    return ts.build_factors(dirty_bars(spark, sf_dir), DIRTY, market.benchmark(spark, sf_dir))


cte(
    "dirty_bars",
    f"""SELECT code, date, CASE WHEN k % 97 <> 0 THEN close END AS close,
          CASE WHEN k % 101 = 0 THEN NULL WHEN k % 89 = 0 THEN amount * 1e6 ELSE amount END AS amount,
          CASE WHEN k % 103 <> 0 THEN turnover END AS turnover, CASE WHEN k % 107 <> 0 THEN volume END AS volume
        FROM (
          SELECT {code_of('l_suppkey')} AS code, date, (date - DATE '1992-01-06') // 7 + l_suppkey AS k,
            arg_max(price, seq) FILTER (price IS NOT NULL) AS close, sum(quantity) AS volume, sum(amount) AS amount,
            sum(quantity) / 1024 AS turnover
          FROM (SELECT l_suppkey, {week_of('l_shipdate')} AS date, l_extendedprice AS amount,
                  CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_quantity END AS quantity,
                  CASE WHEN l_orderkey % 37 <> 0 THEN 100 + l_extendedprice / l_quantity / 1000 END AS price,
                  row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq
                FROM lineitem)
          GROUP BY l_suppkey, date)""",
)
SQL["dirty_bar_factors"] = ask(
    "dirty_bars market_ret",
    f"""SELECT date, code, close / lag(close, 20) {H} - 1 AS momentum_20,
        close / ({full('avg', 'close', 20)}) - 1 AS trend_20, close / ({full('avg', 'close', 60)}) - 1 AS trend_60,
        {full('stddev_samp', 'ret_1', 20)} AS volatility_20, {full('stddev_samp', 'ret_1', 60)} AS volatility_60,
        {full('avg', 'amount', 20)} AS liquidity_20, volume / ({full('avg', 'volume', 20)}) AS volume_ratio_20,
        {full('avg', 'turnover', 5)} AS turnover_5, {full('avg', 'turnover', 20)} AS turnover_20,
        close / ({full('max', 'close', 60)}) - 1 AS drawdown_60, {_beta_sql(60)} AS beta_60
        FROM (SELECT *, close / lag(close) {H} - 1 AS ret_1 FROM dirty_bars) LEFT JOIN market_ret USING (date)""",
    "date code " + " ".join(f"r:{f}" for f in DIRTY),
)
