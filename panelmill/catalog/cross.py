"""Cross-sectional cleaning, ranks, scores and neutralisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.groups import durable
from ..operators import cross_section as xs
from ..operators import timeseries as ts
from ..sources import market
from . import factors as _factors  # noqa: F401 - registers the shared SQL parts
from .kit import SCORING, ask, cte, query

QUERIES: dict = {}
SQL: dict = {}

# Standard score weights and directions.
WEIGHTS: dict[str, tuple[float, int]] = {
    "momentum_5": (0.10, 1),
    "momentum_20": (0.10, 1),
    "momentum_60": (0.20, 1),
    "trend_20": (0.10, 1),
    "trend_60": (0.10, 1),
    "volatility": (0.15, -1),
    "liquidity": (0.05, 1),
    "turnover": (0.05, 1),
    "drawdown": (0.15, -1),
}


def scoring_panel(spark, sf_dir, keep=("open", "close")):
    return ts.build_factors(market.bars(spark, sf_dir), ts.SCORING_FACTORS, keep=keep)


def scores(spark, sf_dir, keep=()):
    return xs.composite_scores(scoring_panel(spark, sf_dir), WEIGHTS, keep)


def score_table(spark, sf_dir):
    """Scores with prices, stored once for the queries that read them repeatedly."""
    return durable(scores(spark, sf_dir, ("open", "close")))


def _clipped(x: str) -> str:
    w = "OVER (PARTITION BY date)"
    lo = f"avg({x}) {w} - 3 * stddev_pop({x}) {w}"
    hi = f"avg({x}) {w} + 3 * stddev_pop({x}) {w}"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN stddev_pop({x}) {w} > 0 "
        f"THEN least(greatest({x}, {lo}), {hi}) ELSE {x} END AS {x}"
    )


def _imputed(x: str) -> str:
    return f"coalesce({x}, median({x}) OVER (PARTITION BY date)) AS {x}"


def _z(x: str, out: str | None = None) -> str:
    w = "OVER (PARTITION BY date)"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN stddev_pop({x}) {w} > 0 "
        f"THEN ({x} - avg({x}) {w}) / stddev_pop({x}) {w} ELSE 0 END AS {out or x + '_z'}"
    )


cte("clipped", f"SELECT date, code, open, close, {', '.join(map(_clipped, SCORING))} FROM scoring", "scoring")
cte("cleaned", f"SELECT date, code, open, close, {', '.join(map(_imputed, SCORING))} FROM clipped", "clipped")
cte("zscored", f"SELECT date, code, open, close, {', '.join(map(_z, SCORING))} FROM cleaned", "cleaned")
_score = " + ".join(f"{f}_z * {w * d}" for f, (w, d) in WEIGHTS.items())
cte("scores", f"SELECT date, code, open, close, {_score} AS composite_score FROM zscored", "zscored")

_ALL = " ".join(f"r:{f}" for f in SCORING)


@query(QUERIES, "sigma_clip")
def sigma_clip(spark, sf_dir):
    return xs.clip_sigma(scoring_panel(spark, sf_dir, ()), SCORING)


SQL["sigma_clip"] = ask("clipped", "SELECT * FROM clipped", f"date code {_ALL}")


@query(QUERIES, "median_imputation")
def median_imputation(spark, sf_dir):
    return xs.clean(scoring_panel(spark, sf_dir, ()), SCORING)


SQL["median_imputation"] = ask("cleaned", "SELECT * FROM cleaned", f"date code {_ALL}")


@query(QUERIES, "factor_zscores")
def factor_zscores(spark, sf_dir):
    z = xs.process_scores(scoring_panel(spark, sf_dir, ()), SCORING)
    return z.select("date", "code", *[f"{f}_z" for f in SCORING])


SQL["factor_zscores"] = ask(
    "zscored", "SELECT * FROM zscored", "date code " + " ".join(f"r:{f}_z" for f in SCORING)
)


@query(QUERIES, "composite_score")
def composite_score(spark, sf_dir):
    return scores(spark, sf_dir)


SQL["composite_score"] = ask("scores", "SELECT * FROM scores", "date code r:composite_score")


@query(QUERIES, "percent_rank_average_ties")
def percent_rank_average_ties(spark, sf_dir):
    panel = market.bars(spark, sf_dir).select("date", "code", "volume", "close")
    return xs.pct_rank(
        panel, {"volume_rank": "volume", "close_rank": "close"}, {"close": -1}
    ).select("date", "code", "volume_rank", "close_rank")


SQL["percent_rank_average_ties"] = ask(
    "bars",
    """SELECT date, code,
        (rank() OVER (PARTITION BY date ORDER BY volume)
         + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS volume_rank,
        (rank() OVER (PARTITION BY date ORDER BY close DESC)
         + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS close_rank
       FROM bars""",
    "date code r:volume_rank r:close_rank",
)


# Direction of each factor in the equal-mean rank score.
RANK_DIRECTIONS = {f: -1 if f == "volatility" else 1 for f in SCORING}


def _rank_sql(f: str) -> str:
    way = "DESC" if RANK_DIRECTIONS[f] < 0 else "ASC"
    return (
        f"(rank() OVER (PARTITION BY date ORDER BY {f} {way}) "
        f"+ (count(*) OVER (PARTITION BY date, {f}) - 1) / 2.0) / count(*) OVER (PARTITION BY date)"
    )


_complete = " AND ".join(f"{f} IS NOT NULL" for f in SCORING)
cte(
    "rank_scores",
    f"SELECT date, code, ({' + '.join(map(_rank_sql, SCORING))}) / {len(SCORING)} AS score "
    f"FROM scoring WHERE {_complete}",
    "scoring",
)


def rank_scores(spark, sf_dir, keep=()):
    return xs.mean_rank_score(
        scoring_panel(spark, sf_dir, keep), SCORING, RANK_DIRECTIONS
    ).select("date", "code", *keep, "score")


@query(QUERIES, "mean_rank_score")
def mean_rank_score(spark, sf_dir):
    return rank_scores(spark, sf_dir)


SQL["mean_rank_score"] = ask("rank_scores", "SELECT * FROM rank_scores", "date code r:score")


@query(QUERIES, "latest_ranking")
def latest_ranking(spark, sf_dir):
    # Only the last session is ranked; its date is a one-row aggregate of the bars.
    panel = scoring_panel(spark, sf_dir, ())
    last = market.bars(spark, sf_dir).agg(F.max("date").alias("date"))
    snapshot = panel.join(F.broadcast(last), "date")
    names = market.universe(spark, sf_dir).select("code", "name")
    ranked = xs.mean_rank_score(snapshot, SCORING, RANK_DIRECTIONS)
    return ranked.join(names, "code").select("code", "name", "score").orderBy(F.desc("score"), "code")


SQL["latest_ranking"] = ask(
    "rank_scores universe bars",
    """SELECT code, name, score FROM rank_scores JOIN universe USING (code)
       WHERE date = (SELECT max(date) FROM bars)""",
    "code name r:score",
)


@query(QUERIES, "winsorized_zscore")
def winsorized_zscore(spark, sf_dir):
    panel = scoring_panel(spark, sf_dir, ())
    return xs.winsor_zscore(
        panel, {"momentum_z": "momentum_20", "volatility_z": "volatility"}
    ).select("date", "code", "momentum_z", "volatility_z")


def _winsor(x: str, out: str) -> str:
    lo, hi = (f"quantile_cont({x}, {q}) OVER (PARTITION BY date)" for q in (0.025, 0.975))
    return (
        f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END AS {out}_x, "
        f"count({x}) OVER (PARTITION BY date) AS {out}_n, {x}"
    )


def _winsor_z(x: str, out: str) -> str:
    w = "OVER (PARTITION BY date)"
    return (
        f"CASE WHEN {out}_n < 5 THEN NULL WHEN stddev_pop({out}_x) {w} = 0 THEN 0 "
        f"ELSE ({out}_x - avg({out}_x) {w}) / stddev_pop({out}_x) {w} END AS {out}"
    )


SQL["winsorized_zscore"] = ask(
    "scoring",
    f"""SELECT date, code, {_winsor_z('momentum_20', 'momentum_z')}, {_winsor_z('volatility', 'volatility_z')}
        FROM (SELECT date, code, {_winsor('momentum_20', 'momentum_z')}, {_winsor('volatility', 'volatility_z')}
              FROM scoring)""",
    "date code r:momentum_z r:volatility_z",
)

# Weights of the rule model over winsorised scores.
RULE = {"momentum_20": 0.4, "trend_60": 0.4, "volatility": -0.2}


@query(QUERIES, "rule_model_score")
def rule_model_score(spark, sf_dir):
    return xs.rule_score(scoring_panel(spark, sf_dir, ()), RULE).select(
        "date", "code", "prediction"
    )


cte(
    "rule",
    "SELECT date, code, "
    + " + ".join(f"{w} * least(greatest(coalesce(z{i}, 0), -3), 3)" for i, w in enumerate(RULE.values()))
    + " AS prediction FROM (SELECT date, code, "
    + ", ".join(_winsor_z(f, f"z{i}") for i, f in enumerate(RULE))
    + " FROM (SELECT date, code, "
    + ", ".join(_winsor(f, f"z{i}") for i, f in enumerate(RULE))
    + " FROM scoring))",
    "scoring",
)
SQL["rule_model_score"] = ask("rule", "SELECT * FROM rule", "date code r:prediction")


@query(QUERIES, "factor_coverage")
def factor_coverage(spark, sf_dir):
    raw = scoring_panel(spark, sf_dir, ())
    return xs.coverage(raw, xs.clean(raw, SCORING), SCORING)


SQL["factor_coverage"] = ask(
    "scoring cleaned",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, 100.0 * count(s.{f}) / count(*) AS coverage_pct,
            1 - count(s.{f}) * 1.0 / count(*) AS nan_ratio, count(s.{f}) AS valid_samples,
            count(c.{f}) - count(s.{f}) AS imputed_samples, count(c.{f}) AS post_clean_valid_samples
            FROM scoring s JOIN cleaned c USING (date, code)"""
        for f in SCORING
    ),
    "factor r:coverage_pct r:nan_ratio i:valid_samples i:imputed_samples i:post_clean_valid_samples",
)

NEUTRAL = ["momentum_20", "trend_60", "volatility"]


def neutral_panel(spark, sf_dir, factors=tuple(NEUTRAL)):
    panel = ts.build_factors(
        market.market_caps(market.bars(spark, sf_dir)),
        {f: ts.SCORING_FACTORS[f] for f in factors},
        keep=["close", "market_cap"],
    )
    members = market.universe(spark, sf_dir).select("code", "industry")
    cleaned = xs.clean(panel, factors).join(members, "code", "left")
    return xs.neutralize(cleaned, factors)


@query(QUERIES, "industry_cap_neutral_factors")
def industry_cap_neutral_factors(spark, sf_dir):
    return neutral_panel(spark, sf_dir).select(
        "date", "code", *[f"{f}_neutralized" for f in NEUTRAL]
    )


def _neutral_sql(factors) -> str:
    d, g = "OVER (PARTITION BY date)", "OVER (PARTITION BY date, industry)"
    base = f"""SELECT c.date, c.code, c.close, u.industry, ln(cap) AS lc, {', '.join('c.' + f for f in factors)}
        FROM cleaned c JOIN (SELECT date, code, close * sum(volume) OVER (PARTITION BY code ORDER BY date
             ROWS UNBOUNDED PRECEDING) AS cap FROM bars) m USING (date, code)
        LEFT JOIN universe u USING (code)"""
    inner = ", ".join(f"{f}, {f} - avg({f}) {g} AS t_{f}, {f} - avg({f}) {d} AS d_{f}, count({f}) {d} AS c_{f}" for f in factors)
    step = f"""SELECT date, code, close, industry, lc - avg(lc) {g} AS lt, count(*) {d} AS n, {inner} FROM ({base})"""
    groups = "SELECT date, count(DISTINCT industry) + 1 AS design FROM (" + base + ") GROUP BY date"
    resid = ", ".join(
        f"""CASE WHEN c_{f} = n AND n >= 5 THEN CASE WHEN n <= design THEN d_{f}
            ELSE t_{f} - lt * coalesce(sum(t_{f} * lt) {d} / nullif(sum(lt * lt) {d}, 0), 0) END END AS e_{f}"""
        for f in factors
    )
    out = ", ".join(_z(f"e_{f}", f"{f}_neutralized") for f in factors)
    return f"SELECT date, code, close, {out} FROM (SELECT date, code, close, {resid} FROM ({step}) JOIN ({groups}) USING (date))"


cte("neutral", _neutral_sql(NEUTRAL), "cleaned", "bars", "universe")
SQL["industry_cap_neutral_factors"] = ask(
    "neutral", "SELECT * FROM neutral", "date code " + " ".join(f"r:{f}_neutralized" for f in NEUTRAL)
)


@query(QUERIES, "rank_within_industry")
def rank_within_industry(spark, sf_dir):
    members = market.universe(spark, sf_dir).select("code", "industry")
    s = scores(spark, sf_dir).filter(F.col("composite_score").isNotNull())
    return xs.rank_in_industry(s.join(members, "code")).select(
        "date", "code", "industry", "industry_rank"
    )


cte(
    "industry_scores",
    """SELECT s.*, coalesce(u.industry, 'Unknown') AS industry,
       row_number() OVER (PARTITION BY date, industry ORDER BY composite_score DESC, code) AS industry_rank
       FROM scores s LEFT JOIN universe u USING (code) WHERE composite_score IS NOT NULL""",
    "scores", "universe",
)
SQL["rank_within_industry"] = ask(
    "industry_scores", "SELECT * FROM industry_scores", "date code industry i:industry_rank"
)


@query(QUERIES, "top_names_per_date")
def top_names_per_date(spark, sf_dir):
    return xs.top_n(scores(spark, sf_dir), 20).select("date", "code", "rank", "composite_score")


SQL["top_names_per_date"] = ask(
    "scores",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC, code) AS rank
       FROM scores WHERE composite_score IS NOT NULL) WHERE rank <= 20""",
    "date code i:rank r:composite_score",
)


@query(QUERIES, "factor_contributions")
def factor_contributions(spark, sf_dir):
    z = xs.process_scores(scoring_panel(spark, sf_dir, ()), SCORING)
    return z.select("date", "code", F.explode(xs.contribution_map(WEIGHTS)).alias("factor", "contribution"))


SQL["factor_contributions"] = ask(
    "zscored",
    " UNION ALL ".join(
        f"SELECT date, code, '{f}' AS factor, {f}_z * {w * d} AS contribution FROM zscored WHERE {f}_z IS NOT NULL"
        for f, (w, d) in WEIGHTS.items()
    ),
    "date code factor r:contribution",
)


@query(QUERIES, "alias_resolution")
def alias_resolution(spark, sf_dir):
    raw = ts.build_factors(
        market.bars(spark, sf_dir),
        {"mom_5": "momentum_5", "vol_20": "volatility_20", "drawdown_60": "drawdown_60"},
    )
    aliases = {
        "momentum_5": ("momentum_5", "mom_5"),
        "volatility": ("volatility", "volatility_20", "vol_20"),
        "drawdown": ("drawdown", "drawdown_60"),
    }
    return xs.resolve_aliases(raw, aliases)


SQL["alias_resolution"] = ask(
    "scoring", "SELECT * FROM scoring", "date code r:momentum_5 r:volatility r:drawdown"
)
