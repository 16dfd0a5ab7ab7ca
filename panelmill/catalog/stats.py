"""Labels, splits and factor statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.groups import durable
from ..operators import cross_section as xs
from ..operators import factor_stats as fs
from ..operators import labels as lb
from ..operators import timeseries as ts
from ..sources import market
from .cross import NEUTRAL, neutral_panel, scores, scoring_panel
from .kit import H, SCORING, ask, cte, query

QUERIES: dict = {}
SQL: dict = {}
HORIZON = 20
MIN_NAMES = 5


def labelled(spark, sf_dir):
    return lb.forward_return(scoring_panel(spark, sf_dir, ("close",)), HORIZON)


cte("labelled", f"SELECT *, lead(close, {HORIZON}) {H} / close - 1 AS future_return FROM scoring", "scoring")


@query(QUERIES, "forward_returns")
def forward_returns(spark, sf_dir):
    return lb.forward_return(market.bars(spark, sf_dir).select("date", "code", "close"), HORIZON)


SQL["forward_returns"] = ask("labelled", "SELECT * FROM labelled", "date code r:close r:future_return")


@query(QUERIES, "cross_section_excess_label")
def cross_section_excess_label(spark, sf_dir):
    panel = lb.forward_return(market.bars(spark, sf_dir).select("date", "code", "close"), HORIZON)
    return lb.cross_section_excess(panel).select("date", "code", "label")


SQL["cross_section_excess_label"] = ask(
    "labelled",
    "SELECT date, code, future_return - avg(future_return) OVER (PARTITION BY date) AS label FROM labelled",
    "date code r:label",
)


@query(QUERIES, "benchmark_excess_label")
def benchmark_excess_label(spark, sf_dir):
    panel = market.bars(spark, sf_dir).select("date", "code", "close")
    return lb.benchmark_excess(panel, market.benchmark(spark, sf_dir), HORIZON).drop("close")


cte(
    "excess",
    f"""SELECT l.*, benchmark_future_return, future_return - benchmark_future_return AS future_excess_return
        FROM labelled l LEFT JOIN (SELECT date, lead(close, {HORIZON}) OVER (ORDER BY date) / close - 1
        AS benchmark_future_return FROM bench) USING (date)""",
    "labelled", "bench",
)
SQL["benchmark_excess_label"] = ask(
    "excess", "SELECT * FROM excess",
    "date code r:future_return r:benchmark_future_return r:future_excess_return",
)


def _ic_sql(source: str, factor: str, target: str) -> str:
    """One factor: ic, rank ic, spread and count per date."""
    return f"""
      SELECT date, '{factor}' AS factor,
        CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS ic,
        CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rank_ic,
        avg(CASE WHEN pos > n - k THEN y END) - avg(CASE WHEN pos <= k THEN y END) AS spread,
        count(*) AS observations
      FROM (SELECT *, greatest(1, ceil(n * 0.2::DOUBLE)) AS k FROM (
        SELECT date, x, y, count(*) OVER (PARTITION BY date) AS n,
          row_number() OVER (PARTITION BY date ORDER BY x, code) AS pos,
          rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry
        FROM (SELECT date, code, {factor} AS x, {target} AS y FROM {source})
        WHERE x IS NOT NULL AND y IS NOT NULL)) GROUP BY date"""


@query(QUERIES, "daily_rank_ic_momentum")
def daily_rank_ic_momentum(spark, sf_dir):
    panel = ts.build_factors(market.bars(spark, sf_dir), ["momentum_5"], keep=["close"])
    panel = lb.forward_return(panel, HORIZON)
    daily = fs.daily_ic(panel, ["momentum_5"], "future_return", MIN_NAMES)
    return daily.select("date", "rank_ic", "observations")


SQL["daily_rank_ic_momentum"] = ask(
    "labelled",
    f"SELECT * FROM ({_ic_sql('labelled', 'momentum_5', 'future_return')}) WHERE observations >= {MIN_NAMES}",
    "date r:rank_ic i:observations",
)

cte("daily_ic", " UNION ALL ".join(_ic_sql("labelled", f, "future_return") for f in SCORING), "labelled")


def daily_ic(spark, sf_dir):
    return fs.daily_ic(labelled(spark, sf_dir), SCORING, "future_return")


@query(QUERIES, "daily_factor_ic")
def daily_factor_ic(spark, sf_dir):
    return daily_ic(spark, sf_dir)


SQL["daily_factor_ic"] = ask(
    "daily_ic", "SELECT * FROM daily_ic", "date factor r:ic r:rank_ic r:spread i:observations"
)


@query(QUERIES, "factor_ic_summary")
def factor_ic_summary(spark, sf_dir):
    return fs.ic_summary(daily_ic(spark, sf_dir))


_SUMMARY = """SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(rank_ic) AS rank_ic_mean,
    avg(ic) / stddev_samp(ic) AS icir, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat,
    count(ic) AS samples, CASE WHEN count(ic) >= {m} THEN 'ok' ELSE 'insufficient_data' END AS status
    FROM {t} GROUP BY factor"""
cte("ic_summary", _SUMMARY.format(t="daily_ic", m=2), "daily_ic")
SQL["factor_ic_summary"] = ask(
    "ic_summary", "SELECT * FROM ic_summary",
    "factor r:ic_mean r:ic_std r:rank_ic_mean r:icir r:t_stat i:samples status",
)


@query(QUERIES, "factor_spread_summary")
def factor_spread_summary(spark, sf_dir):
    return fs.spread_summary(daily_ic(spark, sf_dir))


cte(
    "spreads",
    """SELECT factor, avg(spread) AS average_return, avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) AS win_rate
       FROM daily_ic WHERE observations >= 2 GROUP BY factor""",
    "daily_ic",
)
SQL["factor_spread_summary"] = ask("spreads", "SELECT * FROM spreads", "factor r:average_return r:win_rate")


@query(QUERIES, "factor_analysis_table")
def factor_analysis_table(spark, sf_dir):
    raw = durable(labelled(spark, sf_dir))
    cleaned = xs.clean(raw, SCORING)
    daily = fs.daily_ic(cleaned, SCORING, "future_return")
    return fs.factor_analysis(daily, xs.coverage(raw, cleaned, SCORING))


cte(
    "cleaned_labelled",
    "SELECT c.*, future_return FROM cleaned c JOIN labelled l USING (date, code)",
    "cleaned", "labelled",
)
cte(
    "cleaned_ic",
    " UNION ALL ".join(_ic_sql("cleaned_labelled", f, "future_return") for f in SCORING),
    "cleaned_labelled",
)
cte("cleaned_summary", _SUMMARY.format(t="cleaned_ic", m=2), "cleaned_ic")
SQL["factor_analysis_table"] = ask(
    "cleaned_summary cleaned_ic scoring",
    """SELECT * FROM cleaned_summary JOIN (
         SELECT factor, avg(spread) AS average_return, avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) AS win_rate
         FROM cleaned_ic WHERE observations >= 2 GROUP BY factor) USING (factor) JOIN ("""
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, 100.0 * count({f}) / count(*) AS coverage_pct,
            1 - count({f}) * 1.0 / count(*) AS nan_ratio, count({f}) AS valid_samples FROM scoring"""
        for f in SCORING
    )
    + ") USING (factor)",
    "factor r:ic_mean r:ic_std r:rank_ic_mean r:icir r:t_stat i:samples status r:coverage_pct "
    "r:nan_ratio i:valid_samples r:average_return r:win_rate",
)

_NEUTRALIZED = [f"{f}_neutralized" for f in NEUTRAL]


def neutral_labelled(spark, sf_dir):
    panel = neutral_panel(spark, sf_dir).select("date", "code", "close", *_NEUTRALIZED)
    return lb.benchmark_excess(panel, market.benchmark(spark, sf_dir), HORIZON)


cte(
    "neutral_labelled",
    "SELECT n.*, future_return, future_excess_return FROM neutral n JOIN excess USING (date, code)",
    "neutral", "excess",
)
cte(
    "neutral_ic",
    "SELECT * FROM ("
    + " UNION ALL ".join(_ic_sql("neutral_labelled", f, "future_excess_return") for f in _NEUTRALIZED)
    + f") WHERE observations >= {MIN_NAMES} AND ic IS NOT NULL",
    "neutral_labelled",
)


def neutral_ic(spark, sf_dir):
    return fs.daily_ic(neutral_labelled(spark, sf_dir), _NEUTRALIZED, "future_excess_return")


@query(QUERIES, "professional_factor_summary")
def professional_factor_summary(spark, sf_dir):
    return fs.professional_summary(neutral_ic(spark, sf_dir), HORIZON, MIN_NAMES)


cte(
    "neutral_years",
    """SELECT factor, year(date) AS year, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean,
       count(*) AS observations FROM neutral_ic GROUP BY 1, 2""",
    "neutral_ic",
)
cte("neutral_summary", _SUMMARY.format(t="neutral_ic", m=20), "neutral_ic")
SQL["professional_factor_summary"] = ask(
    "neutral_summary neutral_years neutral_ic",
    f"""SELECT s.*, st.stability, pow(1 + sp.m, 252.0 / {HORIZON}) - 1 AS annualized_long_short_return
        FROM neutral_summary s
        JOIN (SELECT factor, avg(spread) AS m FROM neutral_ic GROUP BY factor) sp USING (factor)
        JOIN (SELECT y.factor, avg(CASE WHEN sign(y.ic_mean) = sign(s2.ic_mean) THEN 1.0 ELSE 0 END) AS stability
              FROM neutral_years y JOIN neutral_summary s2 USING (factor) GROUP BY y.factor) st USING (factor)""",
    "factor r:ic_mean r:ic_std r:rank_ic_mean r:icir r:t_stat i:samples status r:stability "
    "r:annualized_long_short_return",
)


@query(QUERIES, "yearly_ic_stability")
def yearly_ic_stability(spark, sf_dir):
    return fs.yearly_ic(fs.evaluated_only(neutral_ic(spark, sf_dir), MIN_NAMES))


SQL["yearly_ic_stability"] = ask(
    "neutral_years", "SELECT * FROM neutral_years",
    "factor i:year r:ic_mean r:rank_ic_mean i:observations",
)


@query(QUERIES, "prediction_ic")
def prediction_ic(spark, sf_dir):
    panel = scores(spark, sf_dir, ("close",))
    return fs.prediction_ic(lb.forward_return(panel, HORIZON), "composite_score", "future_return", MIN_NAMES)


cte("score_labels", f"SELECT *, lead(close, {HORIZON}) {H} / close - 1 AS future_return FROM scores", "scores")
SQL["prediction_ic"] = ask(
    "score_labels",
    f"""SELECT avg(ic) AS prediction_ic, avg(rank_ic) AS prediction_rank_ic, count(*) AS prediction_observations
        FROM ({_ic_sql('score_labels', 'composite_score', 'future_return')})
        WHERE observations >= {MIN_NAMES} AND ic IS NOT NULL""",
    "r:prediction_ic r:prediction_rank_ic i:prediction_observations",
)


@query(QUERIES, "relevance_labels")
def relevance_labels(spark, sf_dir):
    panel = lb.forward_return(market.bars(spark, sf_dir).select("date", "code", "close"), HORIZON)
    return xs.relevance_labels(panel, "future_return").select(
        "date", "code", "relevance", "group_size"
    )


SQL["relevance_labels"] = ask(
    "labelled",
    """SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY future_return, code) - 1 AS relevance,
       count(*) OVER (PARTITION BY date) AS group_size FROM labelled WHERE future_return IS NOT NULL""",
    "date code i:relevance i:group_size",
)


def sessions(spark, sf_dir):
    """Every ship day: the daily calendar of the data."""
    return market.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


cte("sessions", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
cte("days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM sessions", "sessions")


@query(QUERIES, "rebalance_calendar", text=("exit_date",))
def rebalance_calendar(spark, sf_dir):
    return lb.rebalance_events(sessions(spark, sf_dir), 20)


SQL["rebalance_calendar"] = ask(
    "days",
    """SELECT CAST(idx / 20 AS BIGINT) AS event, idx, date AS signal_date, entry_date, exit_date
       FROM (SELECT *, lead(date) OVER (ORDER BY date) AS entry_date, lead(date, 21) OVER (ORDER BY date) AS exit_date
             FROM days) WHERE idx % 20 = 0 AND entry_date IS NOT NULL""",
    "i:event i:idx signal_date entry_date s:exit_date",
)


@query(QUERIES, "first_session_of_week")
def first_session_of_week(spark, sf_dir):
    return lb.weekly_sessions(sessions(spark, sf_dir))


SQL["first_session_of_week"] = ask(
    "sessions",
    "SELECT min(date) AS date FROM sessions GROUP BY date_trunc('week', date + INTERVAL 2 DAY)",
    "date",
)


@query(QUERIES, "chronological_split")
def chronological_split(spark, sf_dir):
    split = lb.ordered_split(sessions(spark, sf_dir))
    return split.groupBy("part").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("n")
    )


SQL["chronological_split"] = ask(
    "days",
    """SELECT part, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
         SELECT date, CASE WHEN idx < a THEN 'train' WHEN idx >= a + 20 AND idx < a + 20 + v THEN 'validation'
           WHEN idx >= a + 40 + v THEN 'test' END AS part
         FROM (SELECT *, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.2::DOUBLE) AS v FROM days))
       WHERE part IS NOT NULL GROUP BY part""",
    "part first_date last_date i:n",
)


@query(QUERIES, "purged_split")
def purged_split(spark, sf_dir):
    split = lb.purged_split(sessions(spark, sf_dir), 0.6, 0.2, 20)
    return split.groupBy("part").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("n")
    )


SQL["purged_split"] = ask(
    "days",
    """SELECT part, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
         SELECT date, CASE WHEN idx < greatest(1, a - 20) THEN 'train'
           WHEN idx >= a AND idx < greatest(a + 1, b - 20) THEN 'validation' WHEN idx >= b THEN 'test' END AS part
         FROM (SELECT *, least(greatest(2, floor(n * 0.6::DOUBLE)), n - 4) AS a,
               least(greatest(greatest(2, floor(n * 0.6::DOUBLE)) + 2, floor(n * 0.8::DOUBLE)), n - 2) AS b FROM days))
       WHERE part IS NOT NULL GROUP BY part""",
    "part first_date last_date i:n",
)


@query(QUERIES, "rolling_walk_forward_periods")
def rolling_walk_forward_periods(spark, sf_dir):
    return lb.rolling_periods(sessions(spark, sf_dir))


cte(
    "periods",
    """SELECT period, part, min(date) AS start_date, max(date) AS end_date, count(date) AS sessions
       FROM (SELECT period, part, f + to_months(CAST(6 * period + lo AS INTEGER)) AS lo_date,
                    f + to_months(CAST(6 * period + hi AS INTEGER)) AS hi_date
             FROM (SELECT min(date) AS f FROM sessions), range(0, 40) r(period),
                  (VALUES ('train', 0, 36), ('validation', 36, 42), ('test', 42, 48)) p(part, lo, hi)
             WHERE period < (SELECT min(q) FROM range(0, 40) g(q) WHERE NOT EXISTS (
               SELECT 1 FROM sessions, (SELECT min(date) AS f2 FROM sessions)
               WHERE date >= f2 + to_months(CAST(6 * q + 42 AS INTEGER)) AND date < f2 + to_months(CAST(6 * q + 48 AS INTEGER)))))
       JOIN sessions ON date >= lo_date AND date < hi_date GROUP BY period, part""",
    "sessions",
)
SQL["rolling_walk_forward_periods"] = ask(
    "periods", "SELECT * FROM periods", "i:period part start_date end_date i:sessions"
)


@query(QUERIES, "chronology_check")
def chronology_check(spark, sf_dir):
    periods = lb.rolling_periods(sessions(spark, sf_dir))
    broken = lb.chronology_breaks(periods).agg(F.count(F.lit(1)).alias("broken"))
    return periods.agg(F.countDistinct("period").alias("periods")).join(broken)


SQL["chronology_check"] = ask(
    "periods",
    """SELECT count(DISTINCT period) AS periods, (SELECT count(*) FROM periods a JOIN periods b ON a.period = b.period
         AND ((a.part = 'train' AND b.part = 'validation') OR (a.part = 'validation' AND b.part = 'test'))
         AND a.end_date >= b.start_date) AS broken FROM periods""",
    "i:periods i:broken",
)

EVERY = 10


def events_of(spark, sf_dir):
    return lb.rebalance_events(market.calendar(spark, sf_dir), EVERY)


def event_labels(spark, sf_dir, table=None):
    """Labels of every rebalance and the events, from stored scores if given."""
    s = table if table is not None else scores(spark, sf_dir)
    opens = market.bars(spark, sf_dir).select("date", "code", "open")
    events = events_of(spark, sf_dir)
    return lb.event_labels(s, opens, events), events


cte("score_days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)", "bars")
cte(
    "events",
    f"""SELECT idx // {EVERY} AS event, idx, date AS signal_date, entry_date, exit_date FROM (
        SELECT *, lead(date) OVER (ORDER BY date) AS entry_date, lead(date, {EVERY + 1}) OVER (ORDER BY date) AS exit_date
        FROM score_days) WHERE idx % {EVERY} = 0 AND entry_date IS NOT NULL""",
    "score_days",
)
cte(
    "event_labels",
    """SELECT e.event, e.signal_date, e.exit_date, s.code, s.composite_score AS score,
       x.open / n.open - 1 AS future_return
       FROM events e JOIN scores s ON s.date = e.signal_date
       JOIN bars n ON n.date = e.entry_date AND n.code = s.code
       JOIN bars x ON x.date = e.exit_date AND x.code = s.code WHERE s.composite_score IS NOT NULL""",
    "events", "scores", "bars",
)


@query(QUERIES, "rebalance_event_labels")
def rebalance_event_labels(spark, sf_dir):
    return event_labels(spark, sf_dir)[0]


SQL["rebalance_event_labels"] = ask(
    "event_labels", "SELECT * FROM event_labels",
    "i:event signal_date exit_date code r:score r:future_return",
)


@query(QUERIES, "past_only_calibration", text=("training_end",))
def past_only_calibration(spark, sf_dir):
    known, events = event_labels(spark, sf_dir)
    return lb.calibration(known, events.select("event", "signal_date"))


cte(
    "calibration",
    """SELECT event, signal_date, count(score) AS n_obs, max(l_exit) AS training_end,
       CASE WHEN count(score) >= 30 AND max(score) > min(score) THEN regr_slope(future_return, score) END AS slope,
       CASE WHEN count(score) >= 30 AND max(score) > min(score) THEN regr_intercept(future_return, score) END AS intercept
       FROM (SELECT e.event, e.signal_date, l.exit_date AS l_exit, l.score, l.future_return
             FROM events e LEFT JOIN event_labels l ON l.exit_date < e.signal_date)
       GROUP BY event, signal_date""",
    "events", "event_labels",
)
SQL["past_only_calibration"] = ask(
    "calibration", "SELECT * FROM calibration",
    "i:event signal_date i:n_obs s:training_end r:slope r:intercept",
)
