"""Decision log, attribution, error analysis and factor weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.groups import discard, durable, new_path
from ..operators import cross_section as xs
from ..operators import decisions as dc
from ..operators import errors as er
from ..operators import factor_stats as fs
from ..operators import labels as lb
from ..operators import review as rv
from ..operators import risk as rk
from ..operators import timeseries as ts
from ..operators import weights as wt
from ..sources import market, store
from .cross import NEUTRAL, WEIGHTS, scoring_panel
from .joins import equal_baskets
from .kit import SCORING, ask, cte, query
from .portfolio import bench_curve, curves, prices
from .stats import HORIZON, daily_ic, event_labels, neutral_labelled

QUERIES: dict = {}
SQL: dict = {}
STRATEGY = "composite"
DIRECTIONS = {f: d for f, (_, d) in WEIGHTS.items()}


def signal_panel(spark, sf_dir):
    """Factors with prices and the return that follows, stored once for the queries that read them for
    several ends."""
    return durable(lb.forward_return(scoring_panel(spark, sf_dir, ("open", "close")), HORIZON))


def signal_table(spark, sf_dir, panel=None):
    """Scores, stored once, and with their standardised factors, read from the stored panel again."""
    z = xs.process_scores(panel if panel is not None else signal_panel(spark, sf_dir), SCORING)
    scored = z.select("date", "code", "open", "close", xs.composite(WEIGHTS).alias("composite_score"), *[f"{f}_z" for f in SCORING])
    return durable(scored.select("date", "code", "open", "close", "composite_score")), scored


def decision_log(spark, sf_dir, panel=None, signals=None):
    signals, factors = signals or signal_table(spark, sf_dir, panel)
    bench, bars = market.benchmark(spark, sf_dir), market.bars(spark, sf_dir)
    known, events = event_labels(spark, sf_dir, signals)
    lines = lb.calibration(known, events.select("signal_date"))
    members = market.universe(spark, sf_dir).select("code", "industry")
    held = equal_baskets(spark, sf_dir, table=signals).drop("composite_score")
    held = durable(held.join(members, "code", "left").withColumn("exposure", F.col("weight")))
    regimes = rk.market_regime(bench, ts.breadth(bars))
    # Maps are made for held names alone: a basket per rebalance, a table of the calendar.
    picked = F.broadcast(held.select(F.col("signal_date").alias("date"), "code").distinct())
    chosen = factors.join(picked, ["date", "code"], "left_semi")
    scored = chosen.select("date", "code", "composite_score", xs.contribution_map(WEIGHTS).alias("factor_scores"))
    return dc.build_decisions(held, scored, lines, regimes, bars, STRATEGY)


def realized_log(spark, sf_dir, panel=None):
    signals = signal_table(spark, sf_dir, panel)
    log = durable(dc.realize(decision_log(spark, sf_dir, signals=signals)))
    discard(signals[0])
    return log


@query(QUERIES, "decision_snapshots", text=("exit_date",))
def decision_snapshots(spark, sf_dir):
    return decision_log(spark, sf_dir).drop(
        "factor_scores", "decision_reason", "future_return", "prediction_error"
    )


_MAP = " UNION ALL ".join(
    f"SELECT date, code, '{f}' AS factor, {f}_z * {w * d} AS score FROM zscored WHERE {f}_z IS NOT NULL"
    for f, (w, d) in WEIGHTS.items()
)
cte("contributions", _MAP, "zscored")
cte(
    "decisions",
    """SELECT h.date, h.code AS symbol, 'composite' AS strategy, h.signal_date,
         coalesce(c.intercept + c.slope * h.composite_score, 0) AS model_score,
         coalesce(u.industry, 'Unknown') AS industry, coalesce(r.state, 'sideways') AS market_regime,
         coalesce(r.exposure, 0.7) AS regime_exposure, n.open AS entry_price, x.open AS exit_price, e.exit_date, h.weight,
         r.volatility AS market_volatility
       FROM baskets h JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS exit_date FROM (SELECT DISTINCT date FROM baskets)) e
         ON e.date = h.date
       JOIN calibration c ON c.signal_date = h.signal_date LEFT JOIN universe u ON u.code = h.code
       LEFT JOIN bars n ON n.code = h.code AND n.date = h.date
       LEFT JOIN bars x ON x.code = h.code AND x.date = e.exit_date
       ASOF LEFT JOIN regime r ON h.signal_date >= r.date""",
    "baskets", "calibration", "universe", "bars", "regime",
)
SQL["decision_snapshots"] = ask(
    "decisions", "SELECT * FROM decisions",
    "date symbol strategy r:model_score industry market_regime r:entry_price r:exit_price s:exit_date r:weight r:market_volatility",
)


@query(QUERIES, "decision_explanations")
def decision_explanations(spark, sf_dir):
    return decision_log(spark, sf_dir).select("date", "symbol", "decision_reason")


_LEADERS = """SELECT d.date, d.symbol, string_agg(l.factor || '=' || printf('%+.3f', l.score), ', ' ORDER BY abs(l.score) DESC, l.factor) AS leaders
   FROM decisions d JOIN (SELECT *, row_number() OVER (PARTITION BY date, code ORDER BY abs(score) DESC, factor) AS rk FROM contributions) l
     ON l.date = d.signal_date AND l.code = d.symbol WHERE l.rk <= 3 GROUP BY d.date, d.symbol"""
SQL["decision_explanations"] = ask(
    "decisions contributions",
    f"""SELECT d.date, d.symbol, 'Buy because the security ranked in the selected composite-score set; factor contribution: ' || leaders
        || '; regime adjustment: ' || market_regime || ' exposure ' || printf('%.0f%%', regime_exposure * 100)
        || '; risk adjustment: final target exposure ' || printf('%.0f%%', weight * 100) || '.' AS decision_reason
        FROM decisions d JOIN ({_LEADERS}) USING (date, symbol)""",
    "date symbol decision_reason",
)


@query(QUERIES, "backfilled_explanations")
def backfilled_explanations(spark, sf_dir):
    log = decision_log(spark, sf_dir).withColumn("decision_reason", F.lit("Not recorded"))
    return dc.with_reasons(log).select("date", "symbol", "decision_reason")


SQL["backfilled_explanations"] = ask(
    "decisions contributions",
    f"""SELECT d.date, d.symbol, 'Buy decision explanation backfilled from v3.0 snapshot; factor contribution: ' || leaders
        || '; regime adjustment: ' || market_regime || '; risk adjustment: recorded target weight ' || printf('%.0f%%', weight * 100) || '.' AS decision_reason
        FROM decisions d JOIN ({_LEADERS}) USING (date, symbol)""",
    "date symbol decision_reason",
)


@query(QUERIES, "factor_scores_json_round_trip")
def factor_scores_json_round_trip(spark, sf_dir):
    log = decision_log(spark, sf_dir).select("date", "symbol", dc.scores_to_json("factor_scores").alias("text"))
    return log.select("date", "symbol", F.explode(dc.scores_from_json("text")).alias("factor", "score"))


SQL["factor_scores_json_round_trip"] = ask(
    "decisions contributions",
    """SELECT d.date, d.symbol, c.factor, c.score FROM decisions d JOIN contributions c ON c.date = d.signal_date AND c.code = d.symbol""",
    "date symbol factor r:score",
)

cte(
    "realized",
    """SELECT *, exit_price / entry_price - 1 AS future_return, exit_price / entry_price - 1 - model_score AS prediction_error FROM decisions
       WHERE entry_price IS NOT NULL AND exit_price IS NOT NULL""",
    "decisions",
)


@query(QUERIES, "realized_outcomes")
def realized_outcomes(spark, sf_dir):
    """Outcomes known by mid-2000 only."""
    log = dc.realize(decision_log(spark, sf_dir), F.lit("2000-06-30").cast("date"))
    return log.select("date", "symbol", "future_return", "prediction_error")


SQL["realized_outcomes"] = ask(
    "decisions realized",
    """SELECT d.date, d.symbol, CASE WHEN d.exit_date <= DATE '2000-06-30' THEN r.future_return END AS future_return,
       CASE WHEN d.exit_date <= DATE '2000-06-30' THEN r.prediction_error END AS prediction_error
       FROM decisions d LEFT JOIN realized r ON r.date = d.date AND r.symbol = d.symbol""",
    "date symbol r:future_return r:prediction_error",
)


@query(QUERIES, "late_exit_prices")
def late_exit_prices(spark, sf_dir):
    """Every second exit was unknown at recording time and is looked up in the closes."""
    log = decision_log(spark, sf_dir)
    odd = F.col("symbol").cast("bigint") % 2 == 1
    log = log.withColumn("exit_price", F.when(odd, None).otherwise(F.col("exit_price")))
    return dc.fill_exits(log, market.bars(spark, sf_dir)).select("date", "symbol", "exit_price")


SQL["late_exit_prices"] = ask(
    "decisions bars",
    """SELECT d.date, d.symbol, CASE WHEN CAST(d.symbol AS BIGINT) % 2 = 1 THEN b.close ELSE coalesce(d.exit_price, b.close) END AS exit_price
       FROM decisions d LEFT JOIN bars b ON b.code = d.symbol AND b.date = d.exit_date""",
    "date symbol r:exit_price",
)


@query(QUERIES, "decision_log_upsert")
def decision_log_upsert(spark, sf_dir):
    """The second half of the log is recorded twice more, last with doubled weights."""
    log = durable(decision_log(spark, sf_dir)).select("date", "symbol", "strategy", "weight")
    path = new_path(spark)
    month = F.trunc("date", "month")
    store.upsert_table(spark, path, log.withColumn("seq", F.lit(0)), dc.LOG_KEYS, ["seq"], "month", month)
    late = log.filter(F.col("date") >= "1998-06-01")
    again = [late.withColumns({"weight": F.col("weight") * n, "seq": F.lit(n)}) for n in (2, 1)]
    delta = again[0].unionByName(again[1])
    store.upsert_table(spark, path, delta, dc.LOG_KEYS, ["seq"], "month", month)
    return spark.read.parquet(path).select(*log.columns)


SQL["decision_log_upsert"] = ask(
    "decisions",
    """SELECT date, symbol, strategy, weight * CASE WHEN date >= DATE '1998-06-01' THEN 2 ELSE 1 END AS weight FROM decisions""",
    "date symbol strategy r:weight",
)

# ---------------------------------------------------------------- trade review


def reviewed(spark, sf_dir):
    return rv.reviewed(realized_log(spark, sf_dir), market.benchmark(spark, sf_dir))


cte(
    "reviewed",
    """SELECT r.*, weight / sum(weight) OVER () AS w, coalesce(o.close / i.close - 1, 0) AS market_return
       FROM realized r LEFT JOIN bench i ON i.date = r.date LEFT JOIN bench o ON o.date = coalesce(r.exit_date, r.date)""",
    "realized", "bench",
)


@query(QUERIES, "trade_market_returns")
def trade_market_returns(spark, sf_dir):
    return reviewed(spark, sf_dir).select("date", "symbol", "effective_weight", "market_return", "excess_return")


SQL["trade_market_returns"] = ask(
    "reviewed",
    "SELECT date, symbol, w AS effective_weight, market_return, future_return - market_return AS excess_return FROM reviewed",
    "date symbol r:effective_weight r:market_return r:excess_return",
)


@query(QUERIES, "trade_review_summary")
def trade_review_summary(spark, sf_dir):
    return rv.review_summary(reviewed(spark, sf_dir))


SQL["trade_review_summary"] = ask(
    "reviewed",
    """SELECT count(*) AS trade_count, sum(w * future_return) AS total_return, sum(w * market_return) AS market_return,
       sum(w * (future_return - market_return)) AS excess_return, sum(w * prediction_error) AS prediction_error,
       avg(CASE WHEN sign(model_score) = sign(future_return) THEN 1.0 ELSE 0 END) AS model_accuracy, avg(prediction_error) AS prediction_bias
       FROM reviewed""",
    "i:trade_count r:total_return r:market_return r:excess_return r:prediction_error r:model_accuracy r:prediction_bias",
)


@query(QUERIES, "trade_factor_contribution")
def trade_factor_contribution(spark, sf_dir):
    return rv.factor_contribution(reviewed(spark, sf_dir))


cte(
    "factor_contribution",
    """SELECT factor AS factor_name, avg(score) AS average_score, avg(future_return) AS average_return,
       sum(score * future_return * w) AS contribution, count(*) AS observations
       FROM reviewed r JOIN contributions c ON c.date = r.signal_date AND c.code = r.symbol GROUP BY factor""",
    "reviewed", "contributions",
)
SQL["trade_factor_contribution"] = ask(
    "factor_contribution", "SELECT * FROM factor_contribution",
    "factor_name r:average_score r:average_return r:contribution i:observations",
)


@query(QUERIES, "trade_industry_review")
def trade_industry_review(spark, sf_dir):
    return rv.group_review(reviewed(spark, sf_dir), "industry")


SQL["trade_industry_review"] = ask(
    "reviewed",
    """SELECT industry, count(*) AS trade_count, avg(future_return) AS average_return, sum(w * future_return) AS contribution,
       avg(prediction_error) AS prediction_error FROM reviewed GROUP BY industry""",
    "industry i:trade_count r:average_return r:contribution r:prediction_error",
)


@query(QUERIES, "trade_monthly_review")
def trade_monthly_review(spark, sf_dir):
    return rv.monthly_review(reviewed(spark, sf_dir))


SQL["trade_monthly_review"] = ask(
    "reviewed",
    """SELECT strftime(date, '%Y-%m') AS month, count(*) AS trade_count, avg(future_return) AS average_return, sum(w * future_return) AS total_return,
       avg(prediction_error) AS prediction_error FROM reviewed GROUP BY 1""",
    "month i:trade_count r:average_return r:total_return r:prediction_error",
)


@query(QUERIES, "trade_market_review")
def trade_market_review(spark, sf_dir):
    return rv.market_review(reviewed(spark, sf_dir))


SQL["trade_market_review"] = ask(
    "reviewed",
    """SELECT sum(w * market_return) AS market_return, sum(w * future_return) AS portfolio_return,
       sum(w * (future_return - market_return)) AS excess_return FROM reviewed""",
    "r:market_return r:portfolio_return r:excess_return",
)


@query(QUERIES, "trade_drawdowns", text=("recovery_date",))
def trade_drawdowns(spark, sf_dir):
    return rv.trade_drawdowns(reviewed(spark, sf_dir))


cte(
    "trade_equity",
    """SELECT date, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS equity FROM (SELECT date, sum(w * future_return) AS r FROM reviewed GROUP BY date)""",
    "reviewed",
)
SQL["trade_drawdowns"] = ask(
    "trade_equity",
    """SELECT peak_date, trough_date, recovery_date, drawdown, coalesce(back, last_i) - first_i AS duration_days FROM (
        SELECT *, lead(peak_date) OVER (ORDER BY g) AS recovery_date, lead(first_i) OVER (ORDER BY g) AS back
        FROM (SELECT g, min(date) AS peak_date, min(i) AS first_i, max(i) AS last_i, count(*) AS n,
                arg_min(date, row(equity, i)) AS trough_date, min(equity) / arg_min(equity, i) - 1 AS drawdown
              FROM (SELECT *, sum(CASE WHEN peak THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g
                    FROM (SELECT *, row_number() OVER (ORDER BY date) AS i,
                      coalesce(equity >= max(equity) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS peak
                      FROM trade_equity)) GROUP BY g)) WHERE n > 1""",
    "peak_date trough_date s:recovery_date r:drawdown i:duration_days",
)

# ---------------------------------------------------------------- error analysis


def analysed(spark, sf_dir):
    return er.completed(realized_log(spark, sf_dir))


_CLASS = """CASE WHEN model_score >= 0 AND future_return >= 0 THEN 'true_positive' WHEN model_score >= 0 THEN 'false_positive'
   WHEN future_return < 0 THEN 'true_negative' ELSE 'false_negative' END AS classification"""
_VOL = """CASE WHEN market_volatility IS NULL THEN 'unknown' WHEN market_volatility < 0.15 THEN 'low'
   WHEN market_volatility < 0.25 THEN 'normal' ELSE 'high' END AS volatility_bucket"""
cte("analysed", f"SELECT *, {_CLASS}, {_VOL} FROM realized", "realized")


@query(QUERIES, "prediction_classes")
def prediction_classes(spark, sf_dir):
    return analysed(spark, sf_dir).select("date", "symbol", "classification", "volatility_bucket")


SQL["prediction_classes"] = ask("analysed", "SELECT * FROM analysed", "date symbol classification volatility_bucket")


@query(QUERIES, "score_quantile_buckets")
def score_quantile_buckets(spark, sf_dir):
    return er.with_score_bucket(analysed(spark, sf_dir)).select("date", "symbol", "prediction_score_bucket")


cte(
    "bucketed",
    """SELECT *, 'Q' || CASE WHEN rk <= 1 + (n - 1) * 0.2::DOUBLE THEN 1 WHEN rk <= 1 + (n - 1) * 0.4::DOUBLE THEN 2
         WHEN rk <= 1 + (n - 1) * 0.6::DOUBLE THEN 3 WHEN rk <= 1 + (n - 1) * 0.8::DOUBLE THEN 4 ELSE 5 END AS prediction_score_bucket
       FROM (SELECT *, row_number() OVER (ORDER BY model_score, date, symbol) AS rk, count(*) OVER () AS n FROM analysed)""",
    "analysed",
)
SQL["score_quantile_buckets"] = ask("bucketed", "SELECT * FROM bucketed", "date symbol prediction_score_bucket")

CONDITIONS = {
    "regime": "market_regime",
    "industry": "industry",
    "volatility": "volatility_bucket",
    "score_bucket": "prediction_score_bucket",
}


@query(QUERIES, "condition_summaries")
def condition_summaries(spark, sf_dir):
    return er.condition_summary(er.with_score_bucket(analysed(spark, sf_dir)), CONDITIONS)


cte(
    "conditions",
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, {col} AS condition, count(*) AS observations, avg(future_return) AS average_return,
            avg(prediction_error) AS prediction_bias, avg(CASE WHEN classification IN ('true_positive', 'true_negative') THEN 1.0 ELSE 0 END) AS accuracy,
            count(CASE WHEN classification = 'false_positive' THEN 1 END) AS false_positive,
            count(CASE WHEN classification = 'false_negative' THEN 1 END) AS false_negative FROM bucketed GROUP BY {col}"""
        for kind, col in CONDITIONS.items()
    ),
    "bucketed",
)
SQL["condition_summaries"] = ask(
    "conditions", "SELECT * FROM conditions",
    "kind condition i:observations r:average_return r:prediction_bias r:accuracy i:false_positive i:false_negative",
)


@query(QUERIES, "factor_state_failures")
def factor_state_failures(spark, sf_dir):
    return er.factor_state_failures(analysed(spark, sf_dir))


cte(
    "failures",
    """SELECT factor, CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS factor_state, count(*) AS observations,
       avg(future_return) AS average_return, avg(CASE WHEN classification LIKE 'false%' THEN 1.0 ELSE 0 END) AS failure_rate,
       avg(prediction_error) AS prediction_bias
       FROM analysed a JOIN contributions c ON c.date = a.signal_date AND c.code = a.symbol GROUP BY 1, 2""",
    "analysed", "contributions",
)
SQL["factor_state_failures"] = ask(
    "failures", "SELECT * FROM failures",
    "factor factor_state i:observations r:average_return r:failure_rate r:prediction_bias",
)


@query(QUERIES, "strategy_diagnosis")
def strategy_diagnosis(spark, sf_dir):
    trades = analysed(spark, sf_dir)
    regimes = er.condition_summary(trades, {"regime": "market_regime"})
    return er.recommendations(regimes, er.factor_state_failures(trades), trades)


SQL["strategy_diagnosis"] = ask(
    "conditions failures analysed",
    """WITH found AS (
         SELECT 'market_regime' AS area, 'Review or reduce exposure during ' || condition || ' conditions.' AS recommendation,
           observations || ' trades; average return ' || printf('%.2f%%', average_return * 100) AS evidence
         FROM (SELECT * FROM conditions WHERE kind = 'regime' AND observations >= 5 ORDER BY average_return, condition LIMIT 5) WHERE average_return < 0
         UNION ALL SELECT 'factor', 'Review or downweight ' || factor || ' when its state is ' || factor_state || '.',
           'failure rate ' || printf('%.1f%%', failure_rate * 100) || ' across ' || observations || ' trades'
         FROM (SELECT * FROM failures WHERE observations >= 5 ORDER BY failure_rate DESC, observations DESC, factor, factor_state LIMIT 10) WHERE failure_rate > 0.5
         UNION ALL SELECT 'calibration', 'Apply a ' || CASE WHEN b < 0 THEN 'downward' ELSE 'upward' END || ' return-calibration review.',
           'mean prediction error ' || printf('%.3f%%', b * 100) FROM (SELECT avg(prediction_error) AS b FROM analysed) WHERE abs(b) >= 0.002)
       SELECT * FROM found UNION ALL
       SELECT 'evidence', 'No adjustment recommended: available completed-trade evidence is inconclusive.', 'minimum observation threshold is 5'
       WHERE NOT EXISTS (SELECT 1 FROM found)""",
    "area recommendation evidence",
)


@query(QUERIES, "regime_extremes")
def regime_extremes(spark, sf_dir):
    trades = durable(er.condition_summary(analysed(spark, sf_dir), {"regime": "market_regime"}))
    best = er.regime_extremes(trades, 5, best=True).withColumn("side", F.lit("best"))
    return best.unionByName(er.regime_extremes(trades, 5, best=False).withColumn("side", F.lit("worst"))).select(
        "side", "condition", "observations", "average_return"
    )


SQL["regime_extremes"] = ask(
    "conditions",
    """SELECT * FROM (SELECT 'best' AS side, condition, observations, average_return FROM conditions WHERE kind = 'regime' AND observations >= 5
         ORDER BY average_return DESC, condition LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'worst', condition, observations, average_return FROM conditions WHERE kind = 'regime' AND observations >= 5
         ORDER BY average_return, condition LIMIT 5)""",
    "side condition i:observations r:average_return",
)

# ---------------------------------------------------------------- weights


def evidence(spark, sf_dir, panel=None, log=None):
    """IC statistics, spreads and realised contribution per factor, one strategy; from one stored
    panel and one log."""
    panel = panel if panel is not None else signal_panel(spark, sf_dir)
    log = log if log is not None else realized_log(spark, sf_dir, panel)
    daily = durable(fs.daily_ic(panel, SCORING, "future_return"))
    realised = rv.factor_contribution(rv.reviewed(log, market.benchmark(spark, sf_dir))).select(
        F.col("factor_name").alias("factor"), "contribution"
    )
    stats = fs.ic_summary(daily).select("factor", F.col("ic_mean").alias("ic"), "icir")
    stats = stats.join(fs.spread_summary(daily), "factor").join(realised, "factor", "left")
    return stats.withColumn("strategy", F.lit(STRATEGY))


cte(
    "evidence",
    """SELECT factor, ic_mean AS ic, icir, spreads.average_return, contribution FROM ic_summary JOIN spreads USING (factor)
       LEFT JOIN factor_contribution ON factor_name = factor""",
    "ic_summary", "spreads", "factor_contribution",
)
METHODS = ("equal", "ic", "icir", "rolling_performance", "realized_contribution", "combined")


@query(QUERIES, "adaptive_factor_weights")
def adaptive_factor_weights(spark, sf_dir):
    stats = durable(evidence(spark, sf_dir))
    out = None
    for method in METHODS:
        rows = wt.adaptive_weights(stats, method).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("strategy")


def _alloc(x: str) -> str:
    return f"abs({x}) / sum(abs({x})) OVER ()"


_COMBINED = f"0.4 * {_alloc('ic')} + 0.3 * {_alloc('icir')} + 0.3 * {_alloc('contribution')}"
SQL["adaptive_factor_weights"] = ask(
    "evidence",
    f"""SELECT 'equal' AS method, factor, 1.0 / count(*) OVER () AS weight, 1.0 AS metric FROM evidence
        UNION ALL SELECT 'ic', factor, {_alloc('ic')}, ic FROM evidence
        UNION ALL SELECT 'icir', factor, {_alloc('icir')}, icir FROM evidence
        UNION ALL SELECT 'rolling_performance', factor, {_alloc('average_return')}, average_return FROM evidence
        UNION ALL SELECT 'realized_contribution', factor, {_alloc('contribution')}, contribution FROM evidence
        UNION ALL SELECT 'combined', factor, {_COMBINED}, 0.4 * ic + 0.3 * icir + 0.3 * contribution FROM evidence""",
    "method factor r:weight r:metric",
)


def _base_weights(spark):
    return spark.createDataFrame([(f, w) for f, (w, _) in WEIGHTS.items()], "factor string, base double")


@query(QUERIES, "bounded_weight_evolution")
def bounded_weight_evolution(spark, sf_dir):
    target = wt.adaptive_weights(evidence(spark, sf_dir), "combined").select("strategy", "factor", F.col("weight").alias("target"))
    return wt.bounded_evolution(target.join(F.broadcast(_base_weights(spark)), "factor"), 0.05).drop("strategy")


def evolution_sql(limit: float) -> str:
    sql = (
        f"""WITH t AS (SELECT factor, {_COMBINED} AS target FROM evidence),
       b AS (SELECT t.factor, target, base / sum(base) OVER () AS previous_weight FROM t JOIN (VALUES """
        + ", ".join(f"('{f}', {w}::DOUBLE)" for f, (w, _) in WEIGHTS.items())
        + """) v(factor, base) ON v.factor = t.factor),
       c AS (SELECT *, greatest(previous_weight - LIMIT_, 0) AS lo, least(previous_weight + LIMIT_, 1) AS hi,
               least(greatest(target, greatest(previous_weight - LIMIT_, 0)), least(previous_weight + LIMIT_, 1)) AS c FROM b),
       g AS (SELECT *, 1 - sum(c) OVER () AS gap FROM c),
       m AS (SELECT *, CASE WHEN gap > 0 THEN hi - c ELSE c - lo END AS room FROM g)
       SELECT factor, previous_weight, target AS target_weight, c + coalesce(gap * room / nullif(sum(room) OVER (), 0), 0) AS weight,
         c + coalesce(gap * room / nullif(sum(room) OVER (), 0), 0) - previous_weight AS weight_change FROM m"""
    )
    return sql.replace("LIMIT_", f"{limit}::DOUBLE")


EVOLVED = "factor r:previous_weight r:target_weight r:weight r:weight_change"
SQL["bounded_weight_evolution"] = ask("evidence", evolution_sql(0.05), EVOLVED)


@query(QUERIES, "factor_stability")
def factor_stability(spark, sf_dir):
    return wt.factor_stability(realized_log(spark, sf_dir))


cte(
    "stability",
    """SELECT factor, abs(avg(m)) AS stability FROM (SELECT factor, strftime(r.date, '%Y-%m') AS month, avg(score * future_return) AS m
         FROM realized r JOIN contributions c ON c.date = r.signal_date AND c.code = r.symbol GROUP BY 1, 2) GROUP BY factor""",
    "realized", "contributions",
)
SQL["factor_stability"] = ask("stability", "SELECT * FROM stability", "factor r:stability")


@query(QUERIES, "factor_evidence_table")
def factor_evidence_table(spark, sf_dir):
    base = _base_weights(spark).select("factor", F.col("base").alias("weight"))
    panel = signal_panel(spark, sf_dir)
    log = realized_log(spark, sf_dir, panel)
    stats = evidence(spark, sf_dir, panel, log).select("factor", "ic", "icir", "contribution")
    return wt.factor_evidence(base, stats, wt.factor_stability(log))


SQL["factor_evidence_table"] = ask(
    "evidence stability",
    "SELECT v.factor, v.weight, ic, icir, contribution, stability FROM (VALUES "
    + ", ".join(f"('{f}', {w}::DOUBLE)" for f, (w, _) in WEIGHTS.items())
    + ") v(factor, weight) LEFT JOIN evidence e ON e.factor = v.factor LEFT JOIN stability s ON s.factor = v.factor",
    "factor r:weight r:ic r:icir r:contribution r:stability",
)

_N = len(SCORING)
cte(
    "ic_grid",
    f"""SELECT d.date, f.factor, i.ic FROM (SELECT DISTINCT date FROM daily_ic WHERE ic IS NOT NULL) d,
        (SELECT unnest({SCORING!r}) AS factor) f LEFT JOIN daily_ic i ON i.date = d.date AND i.factor = f.factor""",
    "daily_ic",
)


def _combo_sql(raw: str) -> str:
    return f"""SELECT date, factor, CASE WHEN sum(abs(coalesce(raw, 0))) OVER (PARTITION BY date) > 0
          THEN coalesce(raw, 0) / sum(abs(coalesce(raw, 0))) OVER (PARTITION BY date) ELSE 1.0 / {_N} END AS weight
        FROM (SELECT date, factor, {raw} AS raw FROM ic_grid WINDOW w AS (PARTITION BY factor ORDER BY date ROWS 59 PRECEDING))"""


cte("ic_weights", _combo_sql("avg(ic) OVER w"), "ic_grid")
cte("icir_weights", _combo_sql("avg(ic) OVER w / nullif(stddev_samp(ic) OVER w, 0)"), "ic_grid")


def _combination(method):
    def run(spark, sf_dir):
        daily = durable(daily_ic(spark, sf_dir))
        return wt.combination_weights(daily, market.calendar(spark, sf_dir), SCORING, method)

    return run


for _m in ("ic", "icir"):
    query(QUERIES, f"combination_weights_{_m}")(_combination(_m))
    cte(
        f"{_m}_by_date",
        f"""SELECT d.date, d.factor, coalesce(w.weight, 1.0 / {_N}) AS weight
            FROM (SELECT date, factor FROM score_days, (SELECT unnest({SCORING!r}) AS factor)) d
            ASOF LEFT JOIN {_m}_weights w ON w.factor = d.factor AND d.date > w.date""",
        "score_days", f"{_m}_weights",
    )
    SQL[f"combination_weights_{_m}"] = ask(f"{_m}_by_date", f"SELECT * FROM {_m}_by_date", "date factor r:weight")
query(QUERIES, "combination_weights_optimized")(_combination("rolling_optimized"))


@query(QUERIES, "combined_factor_score")
def combined_factor_score(spark, sf_dir):
    weights = durable(_combination("ic")(spark, sf_dir))
    return wt.combined_score(scoring_panel(spark, sf_dir, ()), weights, SCORING, DIRECTIONS)


def _raw_z(f: str) -> str:
    w = "OVER (PARTITION BY date)"
    return f"CASE WHEN {f} IS NULL THEN 0 WHEN stddev_pop({f}) {w} > 0 THEN ({f} - avg({f}) {w}) / stddev_pop({f}) {w} ELSE 0 END AS z_{f}"


SQL["combined_factor_score"] = ask(
    "scoring ic_by_date",
    f"""SELECT z.date, code, {' + '.join(f"z_{f} * {DIRECTIONS[f]} * w_{f}" for f in SCORING)} AS factor_score
        FROM (SELECT date, code, {', '.join(map(_raw_z, SCORING))} FROM scoring) z
        JOIN (SELECT date, {', '.join(f"max(CASE WHEN factor = '{f}' THEN weight END) AS w_{f}" for f in SCORING)}
              FROM ic_by_date GROUP BY date) w ON w.date = z.date""",
    "date code r:factor_score",
)

ROLLING = [f"{f}_neutralized" for f in NEUTRAL]


def rolling(spark, sf_dir, methods):
    panel = durable(neutral_labelled(spark, sf_dir))
    daily = durable(
        fs.evaluated_only(fs.daily_ic(panel, ROLLING, "future_excess_return"), 5)
    )
    return wt.rolling_weights(panel, daily, ROLLING, "future_excess_return", HORIZON, methods=methods)


@query(QUERIES, "rolling_ic_weights")
def rolling_ic_weights(spark, sf_dir):
    return rolling(spark, sf_dir, ("equal", "ic", "icir"))


_M = len(ROLLING)
_RW = "OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)"
cte(
    "neutral_grid",
    f"""SELECT d.date, f.factor, i.ic FROM (SELECT DISTINCT date FROM neutral_ic) d, (SELECT unnest({ROLLING!r}) AS factor) f
        LEFT JOIN neutral_ic i ON i.date = d.date AND i.factor = f.factor""",
    "neutral_ic",
)
cte(
    "expanding",
    f"""SELECT date, method, factor, CASE WHEN sum(abs(coalesce(raw, 0))) OVER (PARTITION BY date, method) > 0
          THEN coalesce(raw, 0) / sum(abs(coalesce(raw, 0))) OVER (PARTITION BY date, method) ELSE 1.0 / {_M} END AS weight
        FROM (SELECT date, 'ic' AS method, factor, avg(ic) {_RW} AS raw FROM neutral_grid
              UNION ALL SELECT date, 'icir', factor, avg(ic) {_RW} / nullif(stddev_samp(ic) {_RW}, 0) FROM neutral_grid)""",
    "neutral_grid",
)
cte(
    "refits",
    f"""SELECT r.date AS refit_date, c.date AS cutoff FROM score_days r JOIN score_days c ON c.idx = r.idx - {HORIZON} WHERE r.idx % 20 = 0""",
    "score_days",
)
cte(
    "rolling_ic",
    f"""SELECT date, 'equal' AS method, factor, 1.0 / {_M} AS weight FROM score_days, (SELECT unnest({ROLLING!r}) AS factor)
        UNION ALL SELECT d.date, d.method, d.factor, coalesce(w.weight, 1.0 / {_M})
          FROM (SELECT date, method, factor FROM score_days, (VALUES ('ic'), ('icir')) m(method), (SELECT unnest({ROLLING!r}) AS factor)) d
          ASOF LEFT JOIN (SELECT r.refit_date, e.method, e.factor, e.weight
              FROM (SELECT * FROM refits, (VALUES ('ic'), ('icir')) m(method), (SELECT unnest({ROLLING!r}) AS factor)) r
              ASOF JOIN expanding e ON e.method = r.method AND e.factor = r.factor AND r.cutoff >= e.date) w
          ON w.method = d.method AND w.factor = d.factor AND d.date >= w.refit_date""",
    "expanding", "refits", "score_days",
)
SQL["rolling_ic_weights"] = ask("rolling_ic", "SELECT * FROM rolling_ic", "date method factor r:weight")


@query(QUERIES, "rolling_regression_weights")
def rolling_regression_weights(spark, sf_dir):
    return rolling(spark, sf_dir, ("regression",))


@query(QUERIES, "rolling_forest_weights")
def rolling_forest_weights(spark, sf_dir):
    return rolling(spark, sf_dir, ("ml",))


@query(QUERIES, "factor_scores_by_method")
def factor_scores_by_method(spark, sf_dir):
    """The panel scored under every closed-form weighting method at once."""
    weights = rolling(spark, sf_dir, ("equal", "ic", "icir"))
    return wt.method_scores(neutral_labelled(spark, sf_dir), weights, ROLLING)


SQL["factor_scores_by_method"] = ask(
    "rolling_ic neutral_labelled",
    f"""SELECT n.date, code, method, {' + '.join(f"coalesce({f}, 0) * w_{f}" for f in ROLLING)} AS factor_score
        FROM neutral_labelled n JOIN (
          SELECT date, method, {', '.join(f"max(CASE WHEN factor = '{f}' THEN weight END) AS w_{f}" for f in ROLLING)}
          FROM rolling_ic GROUP BY 1, 2) w ON w.date = n.date""",
    "date code method r:factor_score",
)


@query(QUERIES, "strategy_version_log")
def strategy_version_log(spark, sf_dir):
    """A version whenever the rounded weights of a method move."""
    history = rolling(spark, sf_dir, ("equal", "ic", "icir")).select(
        F.col("method").alias("strategy"), "date", "factor", F.round("weight", 2).alias("weight"), F.lit(1).alias("direction")
    )
    return wt.version_log(history).select("strategy", "version", "date")


SQL["strategy_version_log"] = ask(
    "rolling_ic",
    """SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY date) AS version, date FROM (
         SELECT *, lag(shape) OVER (PARTITION BY strategy ORDER BY date) AS last FROM (
           SELECT method AS strategy, date, string_agg(factor || ':' || (round(weight, 2) + 0)::VARCHAR, ',' ORDER BY factor) AS shape
           FROM rolling_ic GROUP BY 1, 2)) WHERE shape IS DISTINCT FROM last""",
    "strategy i:version date",
)


@query(QUERIES, "daily_return_attribution")
def daily_return_attribution(spark, sf_dir):
    return attributed(spark, sf_dir)


def attributed(spark, sf_dir):
    curve = durable(curves(spark, sf_dir).filter(F.col("scenario") == "equal_weight").select("date", "equity"))
    members = market.universe(spark, sf_dir).select("code", "industry")
    held = durable(equal_baskets(spark, sf_dir).join(members, "code").select("date", "code", "industry", "weight"))
    return rv.return_attribution(curve, bench_curve(spark, sf_dir), held, prices(spark, sf_dir))


cte(
    "attribution",
    """WITH d AS (SELECT date, r AS portfolio_return, b AS benchmark_return FROM (
           SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, benchmark / lag(benchmark) OVER (ORDER BY date) - 1 AS b
           FROM curves JOIN bench_curve USING (date) WHERE scenario = 'equal_weight') WHERE r IS NOT NULL),
       s AS (SELECT date, code, ret_1 FROM changes WHERE ret_1 IS NOT NULL),
       h AS (SELECT d.date, b.code, u.industry, b.weight FROM d ASOF JOIN (SELECT DISTINCT date FROM baskets) k ON d.date >= k.date
             JOIN baskets b ON b.date = k.date JOIN universe u ON u.code = b.code),
       m AS (SELECT h.*, s.ret_1 FROM h JOIN s ON s.date = h.date AND s.code = h.code),
       i AS (SELECT date, industry, sum(weight) AS pw, avg(ret_1) AS ir, sum(weight * ret_1) AS wr FROM m GROUP BY 1, 2),
       mk AS (SELECT date, avg(ret_1) AS mr, count(*) AS n FROM s GROUP BY date),
       sz AS (SELECT s.date, u.industry, count(*) AS size FROM s JOIN universe u USING (code)
              WHERE s.code IN (SELECT code FROM baskets) GROUP BY 1, 2),
       p AS (SELECT i.date, sum((pw - coalesce(size * 1.0 / n, 0)) * (ir - mr)) AS ia, sum(wr - pw * ir) AS ss
             FROM i JOIN mk USING (date) LEFT JOIN sz USING (date, industry) GROUP BY i.date),
       bt AS (SELECT covar_pop(portfolio_return, benchmark_return) / var_pop(benchmark_return) AS beta FROM d)
       SELECT d.date, portfolio_return, benchmark_return, coalesce(ia, 0) AS industry_allocation, coalesce(ss, 0) AS stock_selection,
         beta * benchmark_return AS market_beta,
         portfolio_return - beta * benchmark_return - coalesce(ia, 0) - coalesce(ss, 0) AS factor_timing
       FROM d LEFT JOIN p USING (date), bt""",
    "curves", "bench_curve", "changes", "baskets", "universe",
)
SQL["daily_return_attribution"] = ask(
    "attribution", "SELECT * FROM attribution",
    "date r:portfolio_return r:benchmark_return r:industry_allocation r:stock_selection r:market_beta r:factor_timing",
)


@query(QUERIES, "return_attribution_summary")
def return_attribution_summary(spark, sf_dir):
    return rv.attribution_summary(attributed(spark, sf_dir))


SQL["return_attribution_summary"] = ask(
    "attribution",
    """SELECT 'market_beta_contribution' AS component, sum(market_beta) AS contribution FROM attribution
       UNION ALL SELECT 'industry_allocation_contribution', sum(industry_allocation) FROM attribution
       UNION ALL SELECT 'stock_selection_contribution', sum(stock_selection) FROM attribution
       UNION ALL SELECT 'factor_timing_contribution', sum(factor_timing) FROM attribution
       UNION ALL SELECT 'portfolio_simple_return', sum(portfolio_return) FROM attribution""",
    "component r:contribution",
)
