"""Point-in-time joins, lookups and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.groups import durable
from ..operators import cross_section as xs
from ..operators import joins as jn
from ..operators.construct import equal_weight
from ..sources import market
from .cross import scores
from .kit import ask, code_of, cte, query
from .stats import events_of

QUERIES: dict = {}
SQL: dict = {}


@query(QUERIES, "fundamentals_table")
def fundamentals_table(spark, sf_dir):
    return market.fundamentals(spark, sf_dir)


cte(
    "fundamentals",
    f"""SELECT code, CAST(last_day(month) + INTERVAL 30 DAY AS DATE) AS available_date, net / gross AS roe,
        net / lag(net) OVER w - 1 AS profit_growth, gross / lag(gross) OVER w - 1 AS revenue_growth
        FROM (SELECT {code_of('l_suppkey')} AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
              sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS net
              FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY code ORDER BY month)""",
)
SQL["fundamentals_table"] = ask(
    "fundamentals", "SELECT * FROM fundamentals", "code available_date r:roe r:profit_growth r:revenue_growth"
)


@query(QUERIES, "quality_factors_as_of")
def quality_factors_as_of(spark, sf_dir):
    panel = market.bars(spark, sf_dir).select("date", "code", "close")
    return jn.asof_join(
        panel, market.fundamentals(spark, sf_dir), ["code"], "date", "available_date",
        ["roe", "profit_growth", "revenue_growth"],
    )


SQL["quality_factors_as_of"] = ask(
    "bars fundamentals",
    """SELECT b.date, b.code, b.close, f.roe, f.profit_growth, f.revenue_growth
       FROM bars b ASOF LEFT JOIN fundamentals f ON b.code = f.code AND b.date >= f.available_date""",
    "date code r:close r:roe r:profit_growth r:revenue_growth",
)


@query(QUERIES, "signal_before_entry")
def signal_before_entry(spark, sf_dir):
    """Last scored date strictly before each order date."""
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("entry_date")).distinct()
    signals = market.bars(spark, sf_dir).select(F.col("date").alias("signal_date")).distinct()
    return jn.asof_join(orders, signals, [], "entry_date", "signal_date", ["signal_date"], strict=True).filter(
        F.col("signal_date").isNotNull()
    )


SQL["signal_before_entry"] = ask(
    "bars",
    """SELECT e.entry_date, s.signal_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS entry_date FROM orders) e
       ASOF JOIN (SELECT DISTINCT date AS signal_date FROM bars) s ON e.entry_date > s.signal_date""",
    "entry_date signal_date",
)

cte(
    "baskets",
    """SELECT e.entry_date AS date, e.signal_date, s.code, s.composite_score, 1.0 / count(*) OVER (PARTITION BY e.entry_date) AS weight
       FROM events e JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC, code) AS rk
         FROM scores WHERE composite_score IS NOT NULL) s ON s.date = e.signal_date WHERE rk <= 20""",
    "events", "scores",
)


def at_signals(spark, sf_dir, table=None):
    """Scores on rebalance dates only, with their entry date."""
    s = table if table is not None else scores(spark, sf_dir)
    events = events_of(spark, sf_dir)
    entries = F.broadcast(events.select(F.col("signal_date").alias("date"), "entry_date"))
    return s.select("date", "code", "composite_score").join(entries, "date"), events


def equal_baskets(spark, sf_dir, n=20, table=None):
    """Equal-weight holdings by entry date."""
    chosen, _ = at_signals(spark, sf_dir, table)
    return equal_weight(chosen, n).select(
        F.col("entry_date").alias("date"), F.col("date").alias("signal_date"), "code", "weight", "composite_score"
    )


@query(QUERIES, "basket_carry_forward")
def basket_carry_forward(spark, sf_dir):
    held = equal_baskets(spark, sf_dir).select("date", "code", "weight")
    return jn.carry_basket(held, market.calendar(spark, sf_dir))


SQL["basket_carry_forward"] = ask(
    "baskets score_days",
    """SELECT d.date, b.date AS basket_date, b.code, b.weight FROM score_days d
       ASOF JOIN (SELECT DISTINCT date FROM baskets) k ON d.date >= k.date JOIN baskets b ON b.date = k.date""",
    "date basket_date code r:weight",
)


@query(QUERIES, "last_known_close")
def last_known_close(spark, sf_dir):
    bars = market.bars(spark, sf_dir).select("code", "date", "open", "close")
    return jn.fill_sessions(bars, market.calendar(spark, sf_dir))


cte(
    "dense",
    """SELECT g.code, g.date, coalesce(b.open, p.close) AS open, p.close, b.code IS NOT NULL AS traded
       FROM (SELECT code, date FROM (SELECT DISTINCT code FROM bars), score_days) g
       ASOF JOIN bars p ON g.code = p.code AND g.date >= p.date
       LEFT JOIN bars b ON b.code = g.code AND b.date = g.date""",
    "bars", "score_days",
)
SQL["last_known_close"] = ask("dense", "SELECT * FROM dense", "code date r:open r:close traded")


@query(QUERIES, "latest_price_as_of")
def latest_price_as_of(spark, sf_dir):
    return jn.latest_per_code(market.bars(spark, sf_dir), "1998-06-30")


SQL["latest_price_as_of"] = ask(
    "bars",
    """SELECT code, arg_max(close, date) AS price, max(date) AS price_date FROM bars
       WHERE date <= DATE '1998-06-30' GROUP BY code""",
    "code r:price price_date",
)


@query(QUERIES, "entry_and_exit_prices")
def entry_and_exit_prices(spark, sf_dir):
    bars = market.bars(spark, sf_dir)
    chosen, events = at_signals(spark, sf_dir)
    best = xs.top_n(chosen, 20).join(
        F.broadcast(events.select(F.col("signal_date").alias("date"), "exit_date")), "date"
    )
    df = best.select("code", F.col("date").alias("signal_date"), "entry_date", "exit_date")
    df = jn.price_at(df, bars, "entry_date", "open", "entry_price")
    return jn.price_at(df, bars, "exit_date", "open", "exit_price").withColumn(
        "exit_date", F.col("exit_date").cast("string")
    )


SQL["entry_and_exit_prices"] = ask(
    "baskets events bars",
    """SELECT b.code, b.signal_date, e.entry_date, e.exit_date, n.open AS entry_price, x.open AS exit_price
       FROM baskets b JOIN events e USING (signal_date)
       LEFT JOIN bars n ON n.code = b.code AND n.date = e.entry_date
       LEFT JOIN bars x ON x.code = b.code AND x.date = e.exit_date""",
    "code signal_date entry_date s:exit_date r:entry_price r:exit_price",
)


@query(QUERIES, "common_sessions")
def common_sessions(spark, sf_dir):
    s = scores(spark, sf_dir).filter(F.col("composite_score").isNotNull())
    return jn.common_sessions(s, market.bars(spark, sf_dir), market.benchmark(spark, sf_dir))


cte(
    "common",
    """SELECT date FROM scores WHERE composite_score IS NOT NULL GROUP BY date HAVING count(*) >= 5
       INTERSECT SELECT date FROM bars GROUP BY date HAVING count(*) >= 5 INTERSECT SELECT date FROM bench""",
    "scores", "bars", "bench",
)
SQL["common_sessions"] = ask("common", "SELECT * FROM common", "date")


@query(QUERIES, "balanced_panel_dates")
def balanced_panel_dates(spark, sf_dir):
    """Dates on which every sector trades (sectors take the place of codes)."""
    members = market.universe(spark, sf_dir).select("code", "sector")
    panel = market.bars(spark, sf_dir).join(members, "code").select("date", F.col("sector").alias("code"))
    return jn.balanced_dates(panel.distinct())


SQL["balanced_panel_dates"] = ask(
    "bars universe",
    """SELECT date FROM bars JOIN universe USING (code) GROUP BY date
       HAVING count(DISTINCT sector) = (SELECT count(DISTINCT sector) FROM bars JOIN universe USING (code))""",
    "date",
)


@query(QUERIES, "duplicate_key_check")
def duplicate_key_check(spark, sf_dir):
    """Order lines whose (order, line) key repeats: a 1:1 join on it would not validate."""
    lines = market.table(spark, sf_dir, "lineitem")
    return jn.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


SQL["duplicate_key_check"] = ask(
    "",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "l_orderkey i:l_linenumber i:n",
)


@query(QUERIES, "validated_left_join")
def validated_left_join(spark, sf_dir):
    """Bars with the newest market cap row of their key."""
    panel = durable(market.bars(spark, sf_dir).select("date", "code", "close", "volume"))
    bars = panel.select("date", "code", "close")
    versions = F.array(F.struct("market_cap", F.lit(1).alias("seq")), F.struct((F.col("market_cap") * 0).alias("market_cap"), F.lit(0).alias("seq")))
    both = market.market_caps(panel).select("date", "code", F.inline(versions).alias("market_cap", "seq"))
    return jn.left_unique(bars, both, ["date", "code"], "seq").drop("seq")


SQL["validated_left_join"] = ask(
    "bars",
    """SELECT date, code, close, close * sum(volume) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)
       AS market_cap FROM bars""",
    "date code r:close r:market_cap",
)


@query(QUERIES, "fallback_for_uncovered_codes")
def fallback_for_uncovered_codes(spark, sf_dir):
    """Industry of codes with trades, and the region for codes without."""
    members = market.universe(spark, sf_dir)
    traded = market.bars(spark, sf_dir).filter(F.col("date") < "1995-06-01").select("code").distinct()
    primary = members.join(traded, "code", "left_semi").select("code", F.col("industry").alias("label"))
    fallback = members.select("code", F.col("sector").alias("label"))
    return jn.covered_by_fallback(primary, fallback)


SQL["fallback_for_uncovered_codes"] = ask(
    "universe bars",
    """SELECT code, CASE WHEN code IN (SELECT code FROM bars WHERE date < DATE '1995-06-01') THEN industry ELSE sector END AS label
       FROM universe""",
    "code label",
)
