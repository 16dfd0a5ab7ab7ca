"""Walk-forward replay and its scenario matrix, all scenarios in one job.

A scenario is a value of a key column: rebalance interval, cost multiplier, score variant
and universe share. Panel rows meet the scenarios only on signal and label dates, and all
later steps carry the key, so ten scenarios cost one plan rather than ten replays.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.groups import durable, top_per_group, with_row_number
from ..operators import labels as lb
from ..operators import returns as rt
from ..operators.construct import AllocationSettings, allocate
from ..operators.joins import asof_join

KEY = "scenario"


@dataclass(frozen=True)
class ReplaySettings:
    """Walk-forward defaults."""

    train_window: int = 40
    validation_window: int = 20
    rebalance_frequency: int = 10
    retrain_frequency: int = 1
    top_n: int = 20
    initial_cash: float = 1_000_000.0
    min_labels: int = 30


SCENARIO_SCHEMA = (
    "scenario string, category string, every int, cost_scale double, variant string, thin boolean"
)
BASE = ("base", "base", 10, 1.0, "base", False)


def robustness_scenarios(spark: SparkSession, every: int = 10) -> DataFrame:
    """Interval, cost, weight and universe changes around the base (V3)."""
    rows = [(f"rebalance_frequency={n}", "rebalance_frequency", n, 1.0, "base", False) for n in (5, 10, 20)]
    rows += [
        (f"transaction_cost_multiplier={m}", "transaction_cost", every, m, "base", False) for m in (0.5, 1.0, 2.0)
    ]
    rows += [
        (f"factor_weight_perturbation={p}", "factor_weight_perturbation", every, 1.0, v, False)
        for p, v in ((-0.05, "minus"), (0.05, "plus"))
    ]
    rows += [
        (f"universe_fraction={f}", "universe_change", every, 1.0, "base", thin) for f, thin in ((0.8, True), (1.0, False))
    ]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def weight_variants(
    spark: SparkSession, weights: Mapping[str, tuple[float, int]], changes: Mapping[str, float]
) -> DataFrame:
    """``variant, factor, weight``: signed weights under a shift of the leading factor (V4).

    The leading share moves by the change and stays in [0, 1]; the others keep their
    proportions in what is left. ``changes`` names the variants; 0 leaves the weights alone.
    """
    shares = spark.createDataFrame(
        [(place, name, float(share), sign) for place, (name, (share, sign)) in enumerate(weights.items())],
        "place int, factor string, share double, sign int",
    )
    variants = spark.createDataFrame([(k, float(v)) for k, v in changes.items()], "variant string, change double")
    totals = shares.agg(
        F.max(F.when(F.col("place") == 0, F.col("share"))).alias("lead"),
        F.coalesce(F.sum(F.when(F.col("place") > 0, F.col("share"))), F.lit(0.0)).alias("others"),
    )
    table = variants.join(F.broadcast(totals)).withColumn("moved", F.least(F.greatest(F.col("lead") + F.col("change"), F.lit(0.0)), F.lit(1.0)))
    table = table.join(F.broadcast(shares))
    left = F.coalesce(F.try_divide("share", "others"), F.lit(0.0)) * (1 - F.col("moved"))
    weight = F.when(F.col("change") == 0, F.col("share")).when(F.col("place") == 0, F.col("moved")).otherwise(left)
    return table.select("variant", "factor", (weight * F.col("sign")).alias("weight"))


def variant_scores(zscored: DataFrame, variants: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``date, code, variant, score`` from one standardisation (V4); NULL when any factor is
    missing. ``variants`` becomes one row a variant, so every row meets a handful."""
    wide = variants.groupBy("variant").agg(*[F.max(F.when(F.col("factor") == f, F.col("weight"))).alias(f"_w_{f}") for f in factors])
    score = F.lit(0.0)
    for f in factors:
        score = score + F.col(f"{f}_z") * F.col(f"_w_{f}")
    return zscored.select("date", "code", *[f"{f}_z" for f in factors]).join(F.broadcast(wide)).select("date", "code", "variant", score.alias("score"))


def thinned_codes(codes: DataFrame, fraction: float, minimum: int = 5) -> DataFrame:
    """Evenly spaced share of the sorted codes (V5).

    Code r of n stays when r = floor(i (n - 1) / (m - 1)) for some i. The position comes
    from the spread row number, so the code list is never sorted in one task.
    """
    numbered = with_row_number(codes.select("code").distinct(), [], [F.col("code")], "_r").withColumn("_r", F.col("_r") - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("_n"))
    df = numbered.join(F.broadcast(size))
    m = F.greatest(F.lit(minimum), F.floor(F.col("_n") * F.lit(fraction)))
    i = F.floor((F.col("_r") * (m - 1) + F.col("_n") - 2) / (F.col("_n") - 1))
    keep = F.floor(i * (F.col("_n") - 1) / (m - 1)) == F.col("_r")
    return df.filter(keep | (m >= F.col("_n"))).select("code")


def scenario_events(dates: DataFrame, scenarios: DataFrame, settings: ReplaySettings) -> DataFrame:
    """Signals of every scenario with entry, exit and the start of the training window."""
    cal = lb.calendar(dates)
    w = Window.orderBy("idx")
    back = settings.train_window
    marked = cal.select(
        "idx",
        F.col("date").alias("signal_date"),
        F.lead("date").over(w).alias("entry_date"),
        F.lag("date", back).over(w).alias("lower_date"),
    )
    intervals = scenarios.select(KEY, "every", "variant", "thin")
    hit = (F.col("idx") >= back) & ((F.col("idx") - back) % F.col("every") == 0)
    events = F.broadcast(intervals).join(marked, hit).filter(F.col("entry_date").isNotNull())
    event = F.row_number().over(Window.partitionBy(KEY).orderBy("idx")) - 1
    return events.withColumn("event", event)


def scenario_labels(
    scored: DataFrame, prices: DataFrame, dates: DataFrame, scenarios: DataFrame
) -> DataFrame:
    """Open-to-open label of every name on the label grid of each scenario."""
    cal = lb.calendar(dates)
    entry = cal.select((F.col("idx") - 1).alias("idx"), F.col("date").alias("entry_date"))
    exit_ = cal.select(F.col("idx").alias("_x"), F.col("date").alias("exit_date"))
    grid = (
        F.broadcast(scenarios.select(KEY, "every", "variant", "thin"))
        .join(cal, F.col("idx") % F.col("every") == 0)
        .withColumn("_x", F.col("idx") + F.col("every") + 1)
        .join(entry, "idx").join(exit_, "_x")
        .select(KEY, "variant", "thin", F.col("date").alias("signal_date"), "entry_date", "exit_date")
    )
    day = in_scenario(scored, grid.withColumnRenamed("signal_date", "date"))
    opens = prices.filter(F.col("open") > 0).select("code", "date", "open")
    start = opens.toDF("code", "entry_date", "_in")
    end = opens.toDF("code", "exit_date", "_out")
    both = day.join(start, ["code", "entry_date"]).join(end, ["code", "exit_date"])
    return both.select(
        KEY, F.col("date").alias("signal_date"), "exit_date", "code", "score",
        (F.col("_out") / F.col("_in") - 1).alias("future_return"),
    )


def in_scenario(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Scored rows of each scenario on its dates: variant must match, thin drops codes.

    ``events`` has one row per scenario and rebalance, so it is broadcast.
    """
    joined = scored.join(F.broadcast(events), ["date", "variant"])
    return joined.filter(~F.col("thin") | F.col("kept"))


def replay(
    scored: DataFrame,
    prices: DataFrame,
    members: DataFrame,
    regimes: DataFrame,
    dates: DataFrame,
    scenarios: DataFrame,
    settings: ReplaySettings = ReplaySettings(),
) -> DataFrame:
    """Holdings of every scenario (V1): calibrated on matured labels, then allocated.

    ``scored``: ``date, code, variant, score, kept``. A signal without enough matured
    labels trades nothing; there is no warm-up fallback. A rebalance that would have to sell
    a name without an open waits for the next one (B8), so only executed baskets are returned.
    """
    events = durable(scenario_events(dates, scenarios, settings))
    labels = scenario_labels(scored, prices, dates, scenarios)
    fit = lb.calibration(
        labels, events.select(KEY, "event", "signal_date", "lower_date"), settings.min_labels, "lower_date", (KEY,)
    )
    fit = carried_fit(fit, settings.retrain_frequency).filter(F.col("slope").isNotNull())
    known = regimes.select(F.col("date").alias("_rd"), F.col("state").alias("_s"), F.col("exposure").alias("_e"))
    states = asof_join(events.select("signal_date").distinct(), known, [], "signal_date", "_rd", ["_s", "_e"])
    plan = (
        events.join(fit.select(KEY, "event", "n_obs", "training_end", "intercept", "slope"), [KEY, "event"])
        .join(states, "signal_date")
        .withColumnRenamed("signal_date", "date")
    )
    current = in_scenario(scored, plan).join(members.select("code", "industry"), "code", "left")
    candidates = current.select(
        KEY, "date", "entry_date", "code", "score",
        (F.col("intercept") + F.col("slope") * F.col("score")).alias("model_prediction"),
        "industry", (1 - F.coalesce("_e", F.lit(0.7))).alias("risk"), F.coalesce("_s", F.lit("sideways")).alias("regime"),
    )
    chosen = allocate(candidates, AllocationSettings(top_n=settings.top_n), (KEY, "date", "entry_date"))
    planned = chosen.select(
        KEY, F.col("entry_date").alias("date"), F.col("date").alias("signal_date"),
        "code", "industry", "weight", "model_score", "regime",
    )
    return rt.executed_baskets(planned, prices, (KEY,))


def carried_fit(fit: DataFrame, retrain: int) -> DataFrame:
    """Keep the line of the last refit between refits."""
    if retrain == 1:
        return fit
    line = F.struct("intercept", "slope", "training_end", "n_obs")
    w = Window.partitionBy(KEY).orderBy("event").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("event") % retrain == 0, line), ignorenulls=True).over(w)
    return fit.withColumn("_line", held).select(
        KEY, "event", "signal_date", "_line.n_obs", "_line.training_end", "_line.intercept", "_line.slope"
    )


def scenario_curves(
    holdings: DataFrame, prices: DataFrame, scenarios: DataFrame, settings: ReplaySettings = ReplaySettings()
) -> DataFrame:
    """Equity of every scenario under its own costs."""
    return rt.equity_curve(
        holdings.select(KEY, "date", "code", "weight"), prices, initial=settings.initial_cash,
        cost_scales=scenarios.select(KEY, "cost_scale"),
    )


def checked_scenarios(scenarios: DataFrame, variants: DataFrame) -> DataFrame:
    """Scenarios with ``problem``: why a cell cannot be run, NULL where it can (V3)."""
    known = variants.select(F.col("variant").alias("_known")).distinct()
    marked = scenarios.join(F.broadcast(known), F.col("variant") == F.col("_known"), "left")
    every, scale = F.col("every"), F.col("cost_scale")
    problem = (
        F.when(every.isNull() | (every < 1), F.concat(F.lit("a rebalance every "), F.coalesce(every.cast("string"), F.lit("?")), F.lit(" sessions")))
        .when(scale.isNull() | F.isnan(scale) | (scale < 0), F.lit("costs are not a positive multiple"))
        .when(F.col("_known").isNull(), F.concat(F.lit("no scores of variant "), F.coalesce("variant", F.lit("?"))))
        .when(F.col("thin").isNull(), F.lit("no universe"))
    )
    return marked.withColumn("problem", problem).drop("_known")


def scenario_report(checked: DataFrame, metrics: DataFrame, columns: Sequence[str], progress: DataFrame | None = None) -> DataFrame:
    """Every scenario as a row (V3): metrics, ``status`` and ``detail``.

    ``checked`` brings the problems found before the run. ``progress`` (``scenario, baskets,
    sessions``) tells how far a cell came, and a metric that has no finite value is named, so a
    failing cell says why and the others keep their figures.
    """
    rows = checked.select(KEY, "category", "problem").join(metrics, KEY, "left")
    if progress is None:
        progress = metrics.select(KEY, F.lit(None).cast("long").alias("baskets"), F.lit(None).cast("long").alias("sessions"))
    rows = rows.join(progress, KEY, "left")
    empty = [F.when(finite(c).isNull(), F.lit(c)) for c in columns]
    lacking = F.concat_ws(", ", *empty)
    detail = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce("baskets", F.lit(0)) == 0, "no signal had enough matured labels")
        .when(F.coalesce("sessions", F.lit(0)) < 2, "fewer than two sessions were marked")
        .when(lacking != "", F.concat(F.lit("undefined: "), lacking))
    )
    good = detail.isNull()
    return rows.select(
        KEY, "category", *[F.when(good, F.col(c)).alias(c) for c in columns],
        F.when(good, "available").otherwise("unavailable").alias("status"),
        F.coalesce(detail, F.lit("measured")).alias("detail"),
    )


def parameter_grid(spark: SparkSession, space: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every combination of the listed values, one row each (V6, J14); of any size."""
    if not all(space.values()):
        raise ValueError("a parameter without values leaves nothing to search")
    df = spark.range(1).select(F.lit(0).alias("_one"))
    for name, values in space.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("_one")


def weight_grid(
    spark: SparkSession, factors: Sequence[str], values: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), limit: int = 10_000
) -> DataFrame:
    """Normalised non-negative factor weights, the zero combination left out (V6)."""
    if len(values) ** len(factors) > limit:
        raise ValueError(f"more than {limit} weight combinations; pass a larger limit to search them all")
    grid = parameter_grid(spark, {f: values for f in factors})
    total = sum((F.col(f) for f in factors), F.lit(0.0))
    return grid.withColumn("_t", total).filter(F.col("_t") > 0).select(*[(F.col(f) / F.col("_t")).alias(f) for f in factors])


def search(
    grid: DataFrame, evaluate: Callable[[DataFrame], DataFrame], objective: str
) -> DataFrame:
    """Evaluate all combinations in one job, best first (V6, U4)."""
    result = evaluate(grid)
    if objective not in result.columns:
        raise ValueError(f"the evaluated grid has no column {objective!r}")
    return result.orderBy(F.desc(objective), *grid.columns)


def live_simulation(
    scores: DataFrame, prices: DataFrame, regimes: DataFrame | None = None,
    every: int = 20, retrain: int = 1, n: int = 20,
) -> DataFrame:
    """Past-only replay of rebalance events with equal-weight picks (V7).

    Without enough matured labels every name scores 0, and ties go to the lower code.
    """
    events = lb.rebalance_events(scores, every)
    labels = lb.event_labels(scores, prices, events)
    fit = lb.calibration(labels, events.select("event", "signal_date", "entry_date", "exit_date"))
    fit = fit.withColumn(KEY, F.lit("live"))
    if retrain > 1:
        dates = fit.select("event", "entry_date", "exit_date")
        fit = carried_fit(fit, retrain).join(dates, "event")
    fit = fit.withColumn("retrained", F.col("event") % retrain == 0)
    if regimes is None:
        fit = fit.withColumn("market_regime", F.lit("sideways"))
    else:
        known = regimes.select(F.col("date").alias("_rd"), F.col("state").alias("market_regime"))
        fit = asof_join(fit, known, [], "signal_date", "_rd", ["market_regime"])
    day = scores.filter(F.col("composite_score").isNotNull()).join(
        F.broadcast(fit.withColumnRenamed("signal_date", "date")), "date"
    )
    prediction = F.coalesce(F.col("intercept") + F.col("slope") * F.col("composite_score"), F.lit(0.0))
    day = day.withColumn("model_score", prediction)
    best = top_per_group(day, ["date"], [F.col("model_score").desc(), F.col("code")], n)
    best = best.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    opens = prices.filter(F.col("open") > 0).select("code", "date", "open")
    best = best.join(opens.toDF("code", "entry_date", "entry_price"), ["code", "entry_date"], "left")
    best = best.join(opens.toDF("code", "exit_date", "exit_price"), ["code", "exit_date"], "left")
    return best.select(
        "date", "entry_date", "exit_date", F.col("code").alias("symbol"), "model_score", "composite_score",
        "entry_price", "exit_price", (F.col("exit_price") / F.col("entry_price") - 1).alias("future_return"),
        F.col("training_end").alias("training_end_date"), F.col("n_obs").alias("training_observations"),
        "retrained", "weight", "market_regime",
    )
