"""Walk-forward, scenarios, search, daily batch and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.groups import discard, durable, new_path
from ..operators import construct as pc
from ..operators import cross_section as xs
from ..operators import factor_stats as fs
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import models as ml
from ..operators import returns as rt
from ..operators import risk as rk
from ..operators import timeseries as ts
from ..plans import annual, daily, replay
from ..sources import market
from .cross import WEIGHTS, rank_scores, score_table, scoring_panel
from .kit import SCORING, ask, cte, query
from .portfolio import _avg_rank, bench_curve, prices
from .review import EVOLVED, ROLLING, evidence, evolution_sql, signal_panel
from .stats import EVERY, HORIZON, daily_ic, event_labels, neutral_labelled

QUERIES: dict = {}
SQL: dict = {}


BASE_WEIGHTS = {"base": 0.0}


def variant_scores(spark, sf_dir, changes=None):
    """Scores under several weight sets from one standardisation (V4)."""
    z = xs.process_scores(scoring_panel(spark, sf_dir, ()), SCORING)
    variants = replay.weight_variants(spark, WEIGHTS, changes or BASE_WEIGHTS)
    long = replay.variant_scores(z, variants, SCORING).filter(F.col("score").isNotNull())
    kept = replay.thinned_codes(market.universe(spark, sf_dir), 0.8).withColumn("kept", F.lit(True))
    return durable(long.join(kept, "code", "left").fillna(False, ["kept"]))


def _replay(spark, sf_dir, scenarios, variants=None):
    scored = variant_scores(spark, sf_dir, variants)
    bars = durable(prices(spark, sf_dir))
    bench = market.benchmark(spark, sf_dir)
    dates = durable(jn.common_sessions(scored.filter(F.col("variant") == "base"), bars, bench))
    regimes = durable(rk.market_regime(bench, ts.breadth(bars)))
    held = replay.replay(scored, bars, market.universe(spark, sf_dir), regimes, dates, scenarios)
    return durable(held), bars.join(F.broadcast(dates), "date", "left_semi"), dates


def _base(spark):
    return spark.createDataFrame([replay.BASE], replay.SCENARIO_SCHEMA)


@query(QUERIES, "walk_forward_holdings")
def walk_forward_holdings(spark, sf_dir):
    held, _, _ = _replay(spark, sf_dir, _base(spark))
    return held.drop("scenario")


cte("wf_days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, lead(date) OVER (ORDER BY date) AS next, lag(date, 40) OVER (ORDER BY date) AS lower_date FROM common", "common")
cte(
    "wf_labels",
    """SELECT d.date AS signal_date, x.date AS exit_date, s.code, s.composite_score AS score, bx.open / bn.open - 1 AS future_return
       FROM wf_days d JOIN wf_days x ON x.idx = d.idx + 11 JOIN scores s ON s.date = d.date AND s.composite_score IS NOT NULL
       JOIN bars bn ON bn.code = s.code AND bn.date = d.next JOIN bars bx ON bx.code = s.code AND bx.date = x.date WHERE d.idx % 10 = 0""",
    "wf_days", "scores", "bars",
)
cte(
    "wf_fit",
    """SELECT e.date, e.next AS entry_date, regr_slope(future_return, score) AS slope, regr_intercept(future_return, score) AS intercept
       FROM wf_days e JOIN wf_labels l ON l.exit_date < e.date AND l.signal_date >= e.lower_date
       WHERE e.idx >= 40 AND (e.idx - 40) % 10 = 0 AND e.next IS NOT NULL
       GROUP BY e.date, e.next HAVING count(*) >= 30 AND max(score) > min(score)""",
    "wf_days", "wf_labels",
)
cte(
    "wf_candidates",
    """SELECT f.date, f.entry_date, s.code, s.composite_score AS score, f.intercept + f.slope * s.composite_score AS model_prediction,
         u.industry, 1 - r.exposure AS risk, r.state AS regime
       FROM wf_fit f JOIN scores s ON s.date = f.date AND s.composite_score IS NOT NULL LEFT JOIN universe u ON u.code = s.code
       ASOF LEFT JOIN regime r ON f.date >= r.date""",
    "wf_fit", "scores", "universe", "regime",
)
cte(
    "wf_planned",
    f"""SELECT entry_date AS date, date AS signal_date, code, industry,
          least(w * CASE WHEN sum(w) OVER g > 0.25 THEN 0.25 / sum(w) OVER g ELSE 1 END, 0.10) AS weight, model_prediction AS model_score, regime
        FROM (SELECT *, raw / sum(raw) OVER (PARTITION BY date) * (1 - CASE regime WHEN 'bull' THEN 0 WHEN 'bear' THEN 0.6
                WHEN 'high_volatility' THEN 0.5 ELSE 0.3 END) AS w
              FROM (SELECT *, quality * (1 - risk) AS raw, row_number() OVER (PARTITION BY date ORDER BY quality DESC, code) AS rk
                    FROM (SELECT *, 0.5 * sr + 0.5 * coalesce(mr, 0.5) AS quality
                          FROM (SELECT *, {_avg_rank('score')} AS sr, {_avg_rank('model_prediction')} AS mr FROM wf_candidates))) WHERE rk <= 20)
        WINDOW g AS (PARTITION BY date, industry)""",
    "wf_candidates",
)
# A basket hands over at the first later plan at which every name that it bought has an open.
cte(
    "wf_holdings",
    """WITH RECURSIVE plans AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM wf_planned)),
       bought AS (SELECT k.p, t.code FROM wf_planned t JOIN plans k USING (date) JOIN bars o ON o.code = t.code AND o.date = t.date WHERE t.weight > 0),
       ready AS (SELECT p, min(q) AS succ FROM (
           SELECT b.p, k.p AS q FROM bought b JOIN plans k ON k.p > b.p LEFT JOIN bars x ON x.code = b.code AND x.date = k.date
           GROUP BY 1, 2 HAVING count(*) = count(x.code)) GROUP BY p),
       chain AS (SELECT 1::BIGINT AS p UNION ALL
                 SELECT coalesce(r.succ, c.p + 1) FROM chain c LEFT JOIN ready r ON r.p = c.p
                 WHERE c.p <= (SELECT count(*) FROM plans) AND (r.succ IS NOT NULL OR c.p NOT IN (SELECT p FROM bought)))
       SELECT t.* FROM wf_planned t JOIN plans k USING (date) WHERE k.p IN (SELECT p FROM chain)""",
    "wf_planned", "bars",
)
SQL["walk_forward_holdings"] = ask(
    "wf_holdings", "SELECT * FROM wf_holdings", "date signal_date code industry r:weight r:model_score regime"
)


@query(QUERIES, "walk_forward_results")
def walk_forward_results(spark, sf_dir):
    scenarios = _base(spark)
    held, bars, _ = _replay(spark, sf_dir, scenarios)
    curve = replay.scenario_curves(held, bars, scenarios).select("date", "equity")
    return mt.walk_forward_table(durable(curve), market.benchmark(spark, sf_dir))


cte(
    "wf_dense",
    """SELECT g.code, g.date, coalesce(b.open, p.close) AS open, p.close FROM (SELECT code, date FROM (SELECT DISTINCT code FROM bars), common) g
       ASOF JOIN (SELECT * FROM bars WHERE date IN (SELECT date FROM common)) p ON g.code = p.code AND g.date >= p.date
       LEFT JOIN bars b ON b.code = g.code AND b.date = g.date""",
    "bars", "common",
)
_K1 = "(1 / ((1 + 0.0003::DOUBLE) * (1 + 0.001::DOUBLE)))"
_KEEP = "((1 - 0.001::DOUBLE) * (1 - 0.0003::DOUBLE - 0.0005::DOUBLE))"
cte(
    "wf_legs",
    """WITH k AS (SELECT date AS entry_date, row_number() OVER (ORDER BY date) AS p, lead(date) OVER (ORDER BY date) AS next_date
                  FROM (SELECT DISTINCT date FROM wf_holdings))
       SELECT k.p, k.entry_date, k.next_date, d.date, d.open, d.close, t.weight, o.open AS o0 FROM k
       JOIN wf_holdings t ON t.date = k.entry_date JOIN bars o ON o.code = t.code AND o.date = k.entry_date
       JOIN wf_dense d ON d.code = t.code AND d.date >= k.entry_date AND (k.next_date IS NULL OR d.date <= k.next_date)""",
    "wf_holdings", "bars", "wf_dense",
)
cte(
    "wf_curve",
    f"""SELECT m.date, 1000000.0 * coalesce(c.carry, 1) * (1 - invested + marked * {_K1}) AS equity
        FROM (SELECT p, date, sum(weight) AS invested, sum(weight * close / o0) AS marked FROM wf_legs
              WHERE next_date IS NULL OR date < next_date GROUP BY 1, 2) m
        LEFT JOIN (SELECT p + 1 AS p, exp(sum(ln(f)) OVER (ORDER BY p)) AS carry FROM (
            SELECT p, 1 - sum(weight) + sum(weight * open / o0) * {_K1} * {_KEEP} AS f FROM wf_legs WHERE date = next_date GROUP BY p)) c USING (p)""",
    "wf_legs",
)
SQL["walk_forward_results"] = ask(
    "wf_curve bench",
    """SELECT *, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS portfolio_return,
       coalesce(benchmark / lag(benchmark) OVER (ORDER BY date) - 1, 0) AS benchmark_return
       FROM (SELECT date, equity, first_value(equity) OVER (ORDER BY date) * close / first_value(close) OVER (ORDER BY date) AS benchmark
             FROM wf_curve JOIN bench USING (date))""",
    "date r:equity r:benchmark r:portfolio_return r:benchmark_return",
)

METRICS = ("annual_return", "sharpe", "max_drawdown", "win_rate", "turnover")


def _matrix(spark, sf_dir, scenarios):
    changes = {"base": 0.0, "minus": -0.05, "plus": 0.05}
    checked = durable(replay.checked_scenarios(scenarios, replay.weight_variants(spark, WEIGHTS, changes)))
    sound = checked.filter("problem IS NULL").drop("problem")
    held, bars, _ = _replay(spark, sf_dir, sound, changes)
    curve = durable(replay.scenario_curves(held, bars, sound))
    turn = pc.turnover(held, ("scenario",)).groupBy("scenario").agg(F.sum("turnover").alias("turnover"))
    measured = mt.curve_metrics(curve).join(turn, "scenario", "left")
    baskets = held.groupBy("scenario").agg(F.countDistinct("date").alias("baskets"))
    progress = baskets.join(curve.groupBy("scenario").agg(F.count(F.lit(1)).alias("sessions")), "scenario", "left")
    return replay.scenario_report(checked, measured, METRICS, progress)


@query(QUERIES, "robustness_matrix")
def robustness_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, replay.robustness_scenarios(spark))


@query(QUERIES, "robustness_failures")
def robustness_failures(spark, sf_dir):
    """Status and detail of every cell of a matrix in which some cannot be run: no interval, no
    costs, no such scores, and an interval beyond the calendar."""
    bad = [("every=0", "bad", 0, 1.0, "base", False), ("cost=nan", "bad", 10, float("nan"), "base", False),
           ("variant=none", "bad", 10, 1.0, "none", False), ("every=5000", "bad", 5000, 1.0, "base", False)]
    scenarios = replay.robustness_scenarios(spark).unionByName(spark.createDataFrame(bad, replay.SCENARIO_SCHEMA))
    return _matrix(spark, sf_dir, scenarios).select("scenario", "status", "detail")


SQL["robustness_failures"] = ask(
    "",
    """SELECT scenario, status, detail FROM (VALUES
         ('rebalance_frequency=5', 'available', 'measured'), ('rebalance_frequency=10', 'available', 'measured'),
         ('rebalance_frequency=20', 'available', 'measured'), ('transaction_cost_multiplier=0.5', 'available', 'measured'),
         ('transaction_cost_multiplier=1.0', 'available', 'measured'), ('transaction_cost_multiplier=2.0', 'available', 'measured'),
         ('factor_weight_perturbation=-0.05', 'available', 'measured'), ('factor_weight_perturbation=0.05', 'available', 'measured'),
         ('universe_fraction=0.8', 'available', 'measured'), ('universe_fraction=1.0', 'available', 'measured'),
         ('every=0', 'unavailable', 'a rebalance every 0 sessions'), ('cost=nan', 'unavailable', 'costs are not a positive multiple'),
         ('variant=none', 'unavailable', 'no scores of variant none'), ('every=5000', 'unavailable', 'no signal had enough matured labels')
       ) t(scenario, status, detail)""",
    "scenario status detail",
)


@query(QUERIES, "perturbed_weight_scores")
def perturbed_weight_scores(spark, sf_dir):
    z = xs.process_scores(scoring_panel(spark, sf_dir, ()), SCORING)
    variants = replay.weight_variants(spark, WEIGHTS, {"plus": 0.05})
    return replay.variant_scores(z, variants, SCORING).select("date", "code", F.col("score").alias("composite_score"))


def _shifted(change: float) -> dict[str, float]:
    first, *others = SCORING
    moved = WEIGHTS[first][0] + change
    rest = sum(WEIGHTS[f][0] for f in others)
    return {first: moved, **{f: WEIGHTS[f][0] / rest * (1 - moved) for f in others}}


SQL["perturbed_weight_scores"] = ask(
    "zscored",
    "SELECT date, code, " + " + ".join(f"{f}_z * {w * WEIGHTS[f][1]!r}::DOUBLE" for f, w in _shifted(0.05).items())
    + " AS composite_score FROM zscored",
    "date code r:composite_score",
)


@query(QUERIES, "thinned_universe")
def thinned_universe(spark, sf_dir):
    return replay.thinned_codes(market.universe(spark, sf_dir), 0.8)


SQL["thinned_universe"] = ask(
    "universe",
    """SELECT DISTINCT code FROM (SELECT code, row_number() OVER (ORDER BY code) - 1 AS r, count(*) OVER () AS n FROM universe) u
       JOIN (SELECT unnest(range(0, (SELECT count(*) FROM universe))) AS i) g
         ON u.r = g.i * (u.n - 1) // (greatest(5, floor(u.n * 0.8::DOUBLE))::BIGINT - 1)
       WHERE g.i < greatest(5, floor(u.n * 0.8::DOUBLE))""",
    "code",
)


@query(QUERIES, "annual_walk_forward")
def annual_walk_forward(spark, sf_dir):
    """Every fourth year on from 1999, on neutralised factors."""
    panel = durable(neutral_labelled(spark, sf_dir))
    return annual.annual_walk_forward(
        panel, ROLLING, "future_excess_return", HORIZON, market="benchmark_future_return"
    )


@query(QUERIES, "period_research")
def period_research(spark, sf_dir):
    """Rolling periods of two training years, evaluated together."""
    panel = scoring_panel(spark, sf_dir, ("close",)).select("date", "code", "close", "momentum_20")
    panel = durable(lb.forward_return(panel, HORIZON))
    periods = durable(lb.rolling_periods(panel.select("date"), train_years=2))
    return annual.run_periods(panel, periods, lambda rows: annual.slope_research(rows, "momentum_20", "future_return", HORIZON))


cte(
    "period_spans",
    """WITH e AS (SELECT min(date) AS first, max(date) AS last FROM scoring),
       s AS (SELECT i AS period, first + to_months(CAST(6 * i AS INTEGER)) AS start FROM e, range(0, 40) r(i)),
       p AS (SELECT period, part, CAST(start + to_months(lo) AS DATE) AS lo, CAST(start + to_months(hi) AS DATE) AS hi FROM s,
               (VALUES ('train', 0, 24), ('validation', 24, 30), ('test', 30, 36)) v(part, lo, hi)),
       h AS (SELECT period, part, min(date) AS start_date, max(date) AS end_date, count(date) AS n
             FROM p LEFT JOIN (SELECT DISTINCT date FROM scoring) d ON date >= lo AND date < hi GROUP BY 1, 2)
       SELECT * FROM h WHERE period < (SELECT min(period) FROM h WHERE n = 0)""",
    "scoring",
)
SQL["period_research"] = ask(
    "scoring period_spans",
    f"""WITH k AS (SELECT date, code, momentum_20 AS x, lead(close, {HORIZON}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS y FROM scoring),
       r AS (SELECT s.period, s.part, k.* FROM k JOIN period_spans s ON k.date BETWEEN s.start_date AND s.end_date WHERE x IS NOT NULL AND y IS NOT NULL),
       f AS (SELECT period, regr_slope(y, x) AS slope FROM r WHERE part = 'train' GROUP BY 1),
       t AS (SELECT period, date FROM (SELECT period, date, row_number() OVER (PARTITION BY period ORDER BY date) - 1 AS i
             FROM (SELECT DISTINCT period, date FROM r WHERE part = 'test')) WHERE i % {HORIZON} = 0),
       d AS (SELECT *, row_number() OVER (PARTITION BY period, date ORDER BY -slope * x, code) AS rk, count(*) OVER (PARTITION BY period, date) AS n
             FROM r JOIN t USING (period, date) JOIN f USING (period) WHERE part = 'test'),
       g AS (SELECT period, date, avg(y) FILTER (rk <= greatest(1, ceil(n * 0.2::DOUBLE))) AS r, avg(y) AS b FROM d GROUP BY 1, 2),
       v AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS nav FROM g WINDOW w AS (PARTITION BY period ORDER BY date)),
       m AS (SELECT period, exp(sum(ln(1 + r))) - 1 AS "return", exp(sum(ln(1 + b))) - 1 AS benchmark,
               CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(252.0 / {HORIZON}) ELSE 0 END AS sharpe, min(dd) AS drawdown
             FROM (SELECT *, nav / max(nav) OVER (PARTITION BY period ORDER BY date) - 1 AS dd FROM v) GROUP BY 1)
       SELECT s.period, s.start_date || ' to ' || s.end_date AS span, "return", benchmark, "return" - benchmark AS alpha, sharpe, drawdown
       FROM period_spans s LEFT JOIN m USING (period) WHERE s.part = 'test'""",
    "i:period span r:return r:benchmark r:alpha r:sharpe r:drawdown",
)


@query(QUERIES, "weight_grid_search")
def weight_grid_search(spark, sf_dir):
    """Normalised weight grid over three factors by weighted mean IC."""
    names = ["momentum_20", "trend_60", "volatility"]
    means = fs.ic_summary(daily_ic(spark, sf_dir)).filter(F.col("factor").isin(names))
    row = means.agg(*[F.max(F.when(F.col("factor") == n, F.col("ic_mean"))).alias(f"_{n}") for n in names])

    def evaluate(grid):
        value = sum((F.col(n) * F.col(f"_{n}") for n in names), F.lit(0.0))
        return grid.join(F.broadcast(row)).select(*names, value.alias("objective"))

    return replay.search(replay.weight_grid(spark, names), evaluate, "objective")


SQL["weight_grid_search"] = ask(
    "ic_summary",
    """WITH v AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x),
       m AS (SELECT max(CASE WHEN factor = 'momentum_20' THEN ic_mean END) AS a, max(CASE WHEN factor = 'trend_60' THEN ic_mean END) AS b,
               max(CASE WHEN factor = 'volatility' THEN ic_mean END) AS c FROM ic_summary)
       SELECT p.x / (p.x + q.x + s.x) AS momentum_20, q.x / (p.x + q.x + s.x) AS trend_60, s.x / (p.x + q.x + s.x) AS volatility,
         (p.x * a + q.x * b + s.x * c) / (p.x + q.x + s.x) AS objective FROM v p, v q, v s, m WHERE p.x + q.x + s.x > 0""",
    "r:momentum_20 r:trend_60 r:volatility r:objective",
)


@query(QUERIES, "live_simulation", text=("exit_date", "training_end_date"))
def live_simulation(spark, sf_dir):
    table = score_table(spark, sf_dir)
    bench = market.benchmark(spark, sf_dir)
    regimes = rk.market_regime(bench, ts.breadth(table.select("date", "code", "close")))
    return replay.live_simulation(table, table.select("code", "date", "open"), regimes, every=EVERY)


SQL["live_simulation"] = ask(
    "events scores calibration regime bars",
    """SELECT d.date, d.entry_date, d.exit_date, d.code AS symbol, d.model_score, d.composite_score, n.open AS entry_price, x.open AS exit_price,
         x.open / n.open - 1 AS future_return, d.training_end AS training_end_date, d.n_obs AS training_observations, true AS retrained,
         1.0 / count(*) OVER (PARTITION BY d.date) AS weight, r.state AS market_regime
       FROM (SELECT s.date, s.code, s.composite_score, e.entry_date, e.exit_date, c.training_end, c.n_obs,
               coalesce(c.intercept + c.slope * s.composite_score, 0) AS model_score,
               row_number() OVER (PARTITION BY s.date ORDER BY coalesce(c.intercept + c.slope * s.composite_score, 0) DESC, s.code) AS rk
             FROM events e JOIN calibration c ON c.signal_date = e.signal_date JOIN scores s ON s.date = e.signal_date
             WHERE s.composite_score IS NOT NULL) d
       LEFT JOIN bars n ON n.code = d.code AND n.date = d.entry_date LEFT JOIN bars x ON x.code = d.code AND x.date = d.exit_date
       ASOF LEFT JOIN regime r ON d.date >= r.date WHERE rk <= 20""",
    "date entry_date s:exit_date symbol r:model_score r:composite_score r:entry_price r:exit_price r:future_return "
    "s:training_end_date i:training_observations retrained r:weight market_regime",
)


def _daily(spark, sf_dir, evidence=None, table=None):
    bars = durable(market.bars(spark, sf_dir))
    known, events = event_labels(spark, sf_dir, table)
    fit = lb.calibration(known, events.agg(F.max("signal_date").alias("signal_date")), min_obs=10)
    line = durable(fit.select("intercept", "slope"))  # one row
    if table is not None:
        discard(table)
    old = bars.filter(F.col("date") < "2001-10-29")
    stored = durable(ts.build_factors(old, ts.SCORING_FACTORS, keep=["open", "close"]))
    return daily.daily_run(
        bars, stored, market.universe(spark, sf_dir), market.benchmark(spark, sf_dir), WEIGHTS, ts.SCORING_FACTORS,
        line, evidence=evidence,
    )


@query(QUERIES, "daily_batch_stages")
def daily_batch_stages(spark, sf_dir):
    panel = signal_panel(spark, sf_dir)
    stats = durable(evidence(spark, sf_dir, panel))
    table = durable(xs.composite_scores(panel, WEIGHTS))
    discard(panel)
    return _daily(spark, sf_dir, stats, table)["stages"]


@query(QUERIES, "daily_batch_weights")
def daily_batch_weights(spark, sf_dir):
    """Weights that the batch leaves for the next one. They follow from the evidence; the tables of
    the other stages are those of the queries beside this one."""
    return daily.evolve(durable(evidence(spark, sf_dir)), WEIGHTS).drop("strategy")


SQL["daily_batch_weights"] = ask("evidence", evolution_sql(0.10), EVOLVED)


@query(QUERIES, "daily_batch_holdings")
def daily_batch_holdings(spark, sf_dir):
    return _daily(spark, sf_dir)["holdings"]


# ---------------------------------------------------------------- models

FEATURES = ["momentum_20", "trend_60", "volatility", "liquidity", "turnover"]


def model_panel(spark, sf_dir):
    """Cleaned, standardised features with the benchmark-excess label."""
    panel = xs.zscore(
        xs.clean(scoring_panel(spark, sf_dir, ("close",)), FEATURES), {f"{f}_z": f for f in FEATURES}
    )
    return durable(lb.benchmark_excess(panel, market.benchmark(spark, sf_dir), HORIZON))


_Z = [f"{f}_z" for f in FEATURES]
LABEL = "future_excess_return"


def _split(panel, part):
    split = lb.ordered_split(panel.select("date"))
    return panel.join(F.broadcast(split.filter(F.col("part") == part).select("date")), "date", "left_semi")


def _held_out(name, **params):
    def run(spark, sf_dir):
        panel = model_panel(spark, sf_dir)
        model = ml.fit_ranking(_split(panel, "train"), _Z, LABEL, name, cleaned=True, **params)
        return model.transform(_split(panel, "test")).select("date", "code", "prediction")

    return run


query(QUERIES, "linear_ranking_predictions")(_held_out("linear"))
query(QUERIES, "forest_ranking_predictions")(_held_out("random_forest", numTrees=100, maxDepth=5))
query(QUERIES, "boosted_ranking_predictions")(_held_out("gradient_boosting", maxIter=100, maxDepth=3))


@query(QUERIES, "model_feature_importance")
def model_feature_importance(spark, sf_dir):
    panel = _split(model_panel(spark, sf_dir), "train")
    out = None
    for name, params in (("linear", {}), ("random_forest", {"numTrees": 100})):
        model = ml.fit_ranking(panel, _Z, LABEL, name, cleaned=True, **params)
        rows = ml.feature_importance(model, spark).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(QUERIES, "model_train_and_test")
def model_train_and_test(spark, sf_dir):
    """Ridge model per split: rows, IC and rank IC (ML7)."""
    panel = model_panel(spark, sf_dir)
    model = ml.fit_ranking(_split(panel, "train"), _Z, LABEL, "linear", cleaned=True)
    out = None
    for part in ("validation", "test"):
        scored = model.transform(_split(panel, part))
        rows = fs.prediction_ic(scored, "prediction", LABEL, 5).withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out


def _rolling_scores(spark, sf_dir):
    return ml.rolling_refit_scores(
        model_panel(spark, sf_dir), _Z, LABEL, every=20, horizon=HORIZON, name="random_forest", numTrees=50
    )


@query(QUERIES, "rolling_model_scores")
def rolling_model_scores(spark, sf_dir):
    return _rolling_scores(spark, sf_dir)[0]


@query(QUERIES, "rolling_model_importance")
def rolling_model_importance(spark, sf_dir):
    return fs.mean_importance(_rolling_scores(spark, sf_dir)[1])


@query(QUERIES, "model_signal_list")
def model_signal_list(spark, sf_dir):
    """Names of the newest scored date by model prediction (ML8)."""
    panel = model_panel(spark, sf_dir)
    model = ml.fit_ranking(_split(panel, "train"), _Z, LABEL, "linear", cleaned=True)
    last = panel.dropna(subset=_Z).agg(F.max("date").alias("date"))
    scored = model.transform(panel.join(F.broadcast(last), "date"))
    return xs.top_n(scored, 20, "prediction").select("date", "code", "rank", "prediction")


@query(QUERIES, "saved_ranking_pipeline")
def saved_ranking_pipeline(spark, sf_dir):
    """A pipeline of cleaning and a ridge model: fitted, saved, loaded, and scoring the held-out part."""
    raw = lb.benchmark_excess(scoring_panel(spark, sf_dir, ("close",)), market.benchmark(spark, sf_dir), HORIZON)
    raw = durable(raw.select("date", "code", "momentum_20", "volatility", LABEL))
    path = new_path(spark)
    ml.fit_ranking(_split(raw, "train"), ["momentum_20", "volatility"], LABEL, "linear", alpha=5.0).write().overwrite().save(path)
    return PipelineModel.load(path).transform(_split(raw, "test")).select("date", "code", "prediction")


cte(
    "split_days",
    """SELECT date, CASE WHEN i < a THEN 'train' WHEN i >= a + 40 + b THEN 'test' END AS part FROM (
         SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, floor(count(*) OVER () * 0.6::DOUBLE) AS a, floor(count(*) OVER () * 0.2::DOUBLE) AS b
         FROM (SELECT DISTINCT date FROM scoring))""",
    "scoring",
)
cte(
    "two_cleaned",
    """SELECT c.date, c.code, c.momentum_20 AS x, c.volatility AS z, e.future_excess_return AS y, part
       FROM cleaned c JOIN split_days USING (date) LEFT JOIN excess e ON e.date = c.date AND e.code = c.code""",
    "cleaned", "split_days", "excess",
)
SQL["saved_ranking_pipeline"] = ask(
    "two_cleaned",
    """SELECT date, code, CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN my + bx * (x - mx) + bz * (z - mz) END AS prediction
       FROM two_cleaned, (
         SELECT *, (sxy * (szz + 5) - szy * sxz) / ((sxx + 5) * (szz + 5) - sxz * sxz) AS bx,
           (szy * (sxx + 5) - sxy * sxz) / ((sxx + 5) * (szz + 5) - sxz * sxz) AS bz FROM (
           SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, count(*) * var_pop(x) AS sxx, count(*) * var_pop(z) AS szz,
             count(*) * covar_pop(x, z) AS sxz, count(*) * covar_pop(x, y) AS sxy, count(*) * covar_pop(z, y) AS szy
           FROM two_cleaned WHERE part = 'train' AND x IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL)) WHERE part = 'test'""",
    "date code r:prediction",
)


@query(QUERIES, "rank_score_backtest_metrics")
def rank_score_backtest_metrics(spark, sf_dir):
    """Equal-mean rank score, top five every 20 sessions, traded at the next open."""
    ranked = rank_scores(spark, sf_dir)
    events = lb.rebalance_events(market.calendar(spark, sf_dir), 20)
    entries = F.broadcast(events.select(F.col("signal_date").alias("date"), "entry_date"))
    best = pc.equal_weight(ranked.join(entries, "date"), 5, "score")
    held = best.select(F.lit("rank").alias("scenario"), F.col("entry_date").alias("date"), "code", "weight")
    curve = durable(rt.equity_curve(held, prices(spark, sf_dir), from_start=True, calendar=market.calendar(spark, sf_dir)))
    return mt.full_metrics(curve, bench_curve(spark, sf_dir))


cte("rank_events", "SELECT * FROM (SELECT date AS signal_date, idx, lead(date) OVER (ORDER BY date) AS entry_date FROM score_days) WHERE idx % 20 = 0 AND entry_date IS NOT NULL", "score_days")
cte(
    "rank_legs",
    """WITH t AS (SELECT e.entry_date, r.code, 1.0 / count(*) OVER (PARTITION BY e.entry_date) AS weight FROM rank_events e
                  JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rk FROM rank_scores) r ON r.date = e.signal_date WHERE rk <= 5),
       k AS (SELECT entry_date, row_number() OVER (ORDER BY entry_date) AS p, lead(entry_date) OVER (ORDER BY entry_date) AS next_date
             FROM (SELECT DISTINCT entry_date FROM t))
       SELECT k.p, k.entry_date, k.next_date, d.date, d.open, d.close, t.weight, o.open AS o0 FROM k JOIN t USING (entry_date)
       JOIN bars o ON o.code = t.code AND o.date = k.entry_date
       JOIN dense d ON d.code = t.code AND d.date >= k.entry_date AND (k.next_date IS NULL OR d.date <= k.next_date)""",
    "rank_events", "rank_scores", "bars", "dense",
)
cte(
    "rank_curve",
    f"""SELECT m.date, 100000.0 * coalesce(c.carry, 1) * (1 - invested + marked * {_K1}) AS equity
        FROM (SELECT p, date, sum(weight) AS invested, sum(weight * close / o0) AS marked FROM rank_legs
              WHERE next_date IS NULL OR date < next_date GROUP BY 1, 2) m
        LEFT JOIN (SELECT p + 1 AS p, exp(sum(ln(f)) OVER (ORDER BY p)) AS carry FROM (
            SELECT p, 1 - sum(weight) + sum(weight * open / o0) * {_K1} * {_KEEP} AS f FROM rank_legs WHERE date = next_date GROUP BY p)) c USING (p)
        UNION ALL SELECT date, 100000.0 FROM score_days WHERE date < (SELECT min(entry_date) FROM rank_legs)""",
    "rank_legs", "score_days",
)
SQL["rank_score_backtest_metrics"] = ask(
    "rank_curve bench_curve",
    """SELECT *, annual_return - benchmark_return AS excess_return FROM (
         SELECT 'rank' AS scenario, pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(r)) - 1 AS annual_return,
           stddev_pop(r) * sqrt(252) AS annual_volatility, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe,
           min(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0 END) AS win_rate
         FROM (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM rank_curve)), (
         SELECT pow(arg_max(benchmark, date) / arg_min(benchmark, date), 252.0 / count(b)) - 1 AS benchmark_return,
           covar_pop(r, b) / var_pop(b) AS beta, (avg(r) - covar_pop(r, b) / var_pop(b) * avg(b)) * 252 AS alpha,
           avg(r - b) / stddev_pop(r - b) * sqrt(252) AS information_ratio, count(*) AS observations
         FROM (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, benchmark / lag(benchmark) OVER (ORDER BY date) - 1 AS b
               FROM rank_curve JOIN bench_curve USING (date)))""",
    "scenario r:annual_return r:annual_volatility r:sharpe r:max_drawdown r:win_rate r:benchmark_return "
    "r:beta r:information_ratio i:observations r:alpha r:excess_return",
)
