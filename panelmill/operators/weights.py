"""Factor weights: past-only combination, rolling research, adaptation, versions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.groups import durable, top_per_group
from .cross_section import zscore
from .joins import asof_join
from .labels import calendar

# Leading bits of a row's hash that are counted before a sample is taken.
HASH_BITS = 12
# Split candidates of a forest's feature, and their accuracy: ranks are off by at most n / ACCURACY.
SPLITS, ACCURACY = 32, 10_000
# Windows of more rows are fitted one after the other; each fit keeps its rows as tree points.
SIDE_BY_SIDE = 1_000_000


def l1_normalised(raw: Column, keys: Sequence[str], factors: int) -> Column:
    """raw / sum |raw| inside the key, equal weights where the sum is 0."""
    value = F.coalesce(raw, F.lit(0.0))
    total = F.sum(F.abs(value)).over(Window.partitionBy(*keys))
    return F.when(total > 0, value / total).otherwise(1.0 / factors)


def ic_grid(daily: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``date, factor, ic`` dense over the dates with any IC; calendar x factors rows."""
    known = daily.filter(F.col("ic").isNotNull() & F.col("factor").isin(*factors)).select("date", "factor", "ic")
    dates = known.select("date").distinct()
    grid = dates.select("date", F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"))
    return grid.join(known, ["date", "factor"], "left")


def combination_weights(
    daily: DataFrame, dates: DataFrame, factors: Sequence[str], method: str, window: int = 60
) -> DataFrame:
    """``date, factor, weight`` for each panel date from IC strictly before it (X11).

    Methods: equal, ic, icir, rolling_optimized. Works on calendar x factor rows only.
    """
    if method not in {"equal", "ic", "icir", "rolling_optimized"}:
        raise ValueError(f"factors cannot be combined by {method}")
    k = len(factors)
    names = F.array(*[F.lit(f) for f in factors])
    equal = F.map_from_arrays(names, F.array(*[F.lit(1.0 / k) for _ in factors]))
    days = dates.select("date").distinct()
    if method == "equal":
        return days.select("date", F.explode(equal).alias("factor", "weight"))
    grid = ic_grid(daily, factors)
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-(window - 1), 0)
    if method == "rolling_optimized":
        known = _optimized(grid, factors, window)
    else:
        mean = F.avg("ic").over(w)
        raw = mean if method == "ic" else ratio(mean, F.stddev_samp("ic").over(w))
        scored = grid.select("date", "factor", raw.alias("_raw")).withColumn(
            "weight", l1_normalised(F.col("_raw"), ["date"], k)
        )
        known = scored.groupBy("date").agg(
            F.map_from_entries(F.collect_list(F.struct("factor", "weight"))).alias("weights")
        )
    known = known.select(F.col("date").alias("_known"), "weights")
    out = asof_join(days, known, [], "date", "_known", ["weights"], strict=True)
    return out.select("date", F.explode(F.coalesce("weights", equal)).alias("factor", "weight"))


def _optimized(grid: DataFrame, factors: Sequence[str], window: int) -> DataFrame:
    """Mean-variance direction of the trailing IC rows; one small solve per date."""
    row = grid.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("factor", F.coalesce("ic", F.lit(float("nan")))))).alias("m")
    )
    vector = F.array(*[F.element_at("m", F.lit(f)) for f in factors])
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    stacked = row.select("date", F.collect_list(vector).over(w).alias("rows"))
    k = len(factors)

    def solve(batches):
        for pdf in batches:
            out = []
            for rows in pdf["rows"]:
                x = np.array([list(r) for r in rows], dtype=float)
                weights = np.full(k, 1.0 / k)
                if len(x) >= 2:
                    seen = (~np.isnan(x)).sum(axis=0)
                    mean = np.where(seen > 0, np.nansum(x, axis=0) / np.maximum(seen, 1), 0.0)
                    cov = np.atleast_2d(np.cov(np.nan_to_num(x), rowvar=False)) + np.eye(k) * 1e-6
                    raw = np.linalg.pinv(cov) @ mean
                    total = np.abs(raw).sum()
                    if np.isfinite(total) and total > 0:
                        weights = raw / total
                out.append(dict(zip(factors, map(float, weights))))
            yield pd.DataFrame({"date": pdf["date"], "weights": out})

    return stacked.mapInPandas(solve, "date date, weights map<string,double>")


def combined_score(
    panel: DataFrame, weights: DataFrame, factors: Sequence[str],
    directions: Mapping[str, int] | None = None,
) -> DataFrame:
    """``date, code, factor_score``: directed z-scores times the weights of the date (X11)."""
    z = zscore(panel, {f"_z_{f}": f for f in factors})
    per_date = weights.groupBy("date").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("weight"))).alias(f"_w_{f}") for f in factors]
    )
    total = F.lit(0.0)
    for f in factors:
        sign = (directions or {}).get(f, 1)
        total = total + F.coalesce(F.col(f"_z_{f}"), F.lit(0.0)) * sign * F.col(f"_w_{f}")
    return z.join(F.broadcast(per_date), "date").select("date", "code", total.alias("factor_score"))


# ---------------------------------------------------------------- regression moments


def gram_sums(panel: DataFrame, factors: Sequence[str], target: str, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Regression moments per key: n and the sums of 1, x, y and their products.

    A partial aggregate of (k + 2)^2 / 2 numbers; any training window is a sum of these
    rows, so the panel is read once however many windows are fitted.
    """
    names = [*factors, target]
    full = panel.dropna(subset=names)
    sums = [F.count(F.lit(1)).cast("double").alias("g_n")]
    for i, a in enumerate(names):
        sums.append(F.sum(a).alias(f"g_s{i}"))
        for j, b in enumerate(names[i:], start=i):
            sums.append(F.sum(F.col(a) * F.col(b)).alias(f"g_p{i}_{j}"))
    return full.groupBy(*keys).agg(*sums)


def gram_columns(k: int) -> list[str]:
    """Column names of the moments of k factors and a target."""
    out = ["g_n"]
    for i in range(k + 1):
        out.append(f"g_s{i}")
        out.extend(f"g_p{i}_{j}" for j in range(i, k + 1))
    return out


def solve_weights(moments: DataFrame, factors: Sequence[str], key: str, min_rows: int | None = None) -> DataFrame:
    """L1-normalised least-squares slopes per row of moments; equal when too few rows."""
    k = len(factors)
    need = min_rows if min_rows is not None else max(30, 5 * k)
    key_type = {f.name: f.dataType.simpleString() for f in moments.schema.fields}[key]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                weights = np.full(k, 1.0 / k)
                n = r["g_n"]
                if pd.notna(n) and n >= need:
                    s = np.array([r[f"g_s{i}"] for i in range(k + 1)], dtype=float)
                    p = np.array(
                        [[r[f"g_p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float
                    )
                    centred = p - np.outer(s, s) / n
                    slopes, *_ = np.linalg.lstsq(centred[:k, :k], centred[:k, k], rcond=None)
                    total = np.abs(slopes).sum()
                    if np.isfinite(total) and total > 0:
                        weights = slopes / total
                out.append(dict(zip(factors, map(float, weights))))
            yield pd.DataFrame({key: pdf[key], "weights": out})

    return moments.mapInPandas(solve, f"{key} {key_type}, weights map<string,double>")


def rolling_weights(
    panel: DataFrame,
    daily: DataFrame,
    factors: Sequence[str],
    target: str,
    horizon: int = 20,
    window: int = 252,
    every: int = 20,
    methods: Sequence[str] = ("equal", "ic", "icir", "regression"),
    ml_every: int = 60,
    ml_sample: int | None = None,
    ml_trees: int = 20,
) -> DataFrame:
    """``date, method, factor, weight`` refitted every k sessions from matured rows.

    A refit at session i uses sessions up to i - horizon only; before that weights are
    equal. Between refits the last weights hold. ``ml`` is refitted every ``ml_every`` sessions:
    the importances of a forest fitted on every row of the window, or on at most ``ml_sample``
    rows where a caller asks for that.
    """
    k = len(factors)
    cal = calendar(panel)
    refit = cal.filter((F.col("idx") % every == 0) & (F.col("idx") >= horizon)).select(
        F.col("date").alias("refit_date"), (F.col("idx") - horizon).alias("idx")
    )
    refits = refit.join(cal.select("idx", F.col("date").alias("cutoff")), "idx").drop("idx")
    names = F.array(*[F.lit(f) for f in factors])
    equal = F.map_from_arrays(names, F.array(*[F.lit(1.0 / k) for _ in factors]))
    days = cal.select("date")
    out = None
    for method in methods:
        if method == "equal":
            table = days.withColumn("weights", equal)
        else:
            if method in ("ic", "icir"):
                known = _expanding_ic(daily, factors, method)
                fitted = asof_join(refits, known, [], "cutoff", "_known", ["weights"])
            elif method == "regression":
                fitted = _rolling_regression(panel, cal, refits, factors, target, window)
            elif method == "ml":
                fitted = _rolling_forest(panel, cal, horizon, factors, target, window, ml_every, ml_sample, ml_trees)
            else:
                raise ValueError(f"unknown weight method: {method}")
            fitted = fitted.select(F.col("refit_date").alias("_refit"), "weights")
            table = asof_join(days, fitted, [], "date", "_refit", ["weights"])
        rows = table.select(
            "date", F.lit(method).alias("method"), F.explode(F.coalesce("weights", equal)).alias("factor", "weight")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _expanding_ic(daily: DataFrame, factors: Sequence[str], method: str) -> DataFrame:
    """Weights from every IC up to a date, for each IC date."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    mean, std = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    raw = mean if method == "ic" else F.when(std > 0, mean / std)
    scored = ic_grid(daily, factors).select("date", "factor", raw.alias("_raw"))
    scored = scored.withColumn("weight", l1_normalised(F.col("_raw"), ["date"], len(factors)))
    return scored.groupBy(F.col("date").alias("_known")).agg(
        F.map_from_entries(F.collect_list(F.struct("factor", "weight"))).alias("weights")
    )


def _rolling_regression(panel, cal, refits, factors, target, window) -> DataFrame:
    gram = gram_columns(len(factors))
    daily = cal.join(gram_sums(panel, factors, target), "date", "left").fillna(0.0, gram)
    w = Window.orderBy("idx").rowsBetween(-(window - 1), 0)
    summed = daily.select("date", *[F.sum(g).over(w).alias(g) for g in gram])
    at_refit = refits.join(summed.withColumnRenamed("date", "cutoff"), "cutoff")
    return solve_weights(at_refit, factors, "refit_date")


def training_samples(
    panel: DataFrame, cal: DataFrame, horizon: int, factors: Sequence[str], target: str, window: int, every: int, most: int
) -> DataFrame:
    """``refit_date`` and at most ``most`` complete rows of each refit's window.

    Rows are taken by a hash of (date, code), so a sample does not depend on their order or
    place. Counts in bins of the hash tell which bins hold the first rows; the others are dropped
    before the shuffle, so a refit's task gets little more than ``most`` rows of any panel.
    """
    refits = cal.filter((F.col("idx") % every == 0) & (F.col("idx") >= horizon)).select(
        F.col("date").alias("refit_date"), (F.col("idx") - horizon).alias("_to")
    )
    names = [*factors, target]
    dated = panel.select("date", "code", *names).dropna(subset=names).join(F.broadcast(cal), "date")
    # A session is in a handful of windows; refits are calendar rows.
    held = dated.join(F.broadcast(refits), (F.col("idx") <= F.col("_to")) & (F.col("idx") > F.col("_to") - window))
    held = held.withColumn("_h", F.xxhash64("date", "code")).withColumn("_bin", F.shiftright("_h", 64 - HASH_BITS))
    bins = held.groupBy("refit_date", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("refit_date").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    needed = bins.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).filter(F.col("_before") < most)
    last = needed.groupBy("refit_date").agg(F.max("_bin").alias("_last"))
    first = held.join(F.broadcast(last), "refit_date").filter("_bin <= _last")
    return top_per_group(first, ["refit_date"], [F.col("_h"), F.col("date"), F.col("code")], most).select("refit_date", *names)


def training_rows(panel: DataFrame, cal: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """``idx`` and the numbers of every complete row, stored once for all windows, in an order of its
    own: a forest draws its bags along the rows, so they do not depend on the order of the panel."""
    names = [*factors, target]
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = panel.select("date", "code", *names).dropna(subset=names).join(F.broadcast(cal), "date")
    spread = dated.repartition(parts, "idx", "code").sortWithinPartitions("idx", "code", *names)
    return durable(spread.select("idx", *names))


def _rolling_forest(panel, cal, horizon, factors, target, window, every, most, trees) -> DataFrame:
    """Forest importances per refit; a window with too few rows keeps equal weights."""
    spark = panel.sparkSession
    need = max(100, 10 * len(factors))
    if most is None:
        rows = training_rows(panel, cal, factors, target)
        days = cal.join(rows.groupBy("idx").agg(F.count(F.lit(1)).alias("_n")), "idx", "left").collect()  # a row per session
        held = {d["idx"]: d["_n"] or 0 for d in days}
        refits = []
        for d in days:
            end = d["idx"] - horizon
            n = sum(held[i] for i in range(max(0, end - window + 1), end + 1))
            if d["idx"] % every == 0 and end >= 0 and n >= need:
                inside = rows.filter((F.col("idx") <= end) & (F.col("idx") > end - window))
                refits.append((d["date"], n, inside))
    else:
        samples = durable(training_samples(panel, cal, horizon, factors, target, window, every, most))
        sizes = samples.groupBy("refit_date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)
        refits = [(r["refit_date"], r["n"], samples.filter(F.col("refit_date") == F.lit(r["refit_date"]))) for r in sizes.collect()]

    def fit(refit) -> tuple:
        date, n, inside = refit
        # A square of more bins than rows makes the trainer look at all rows for its thresholds, which
        # lie between the values of the binned features: SPLITS at most.
        forest = RandomForestRegressor(
            featuresCol="_features", labelCol=target, numTrees=trees, minInstancesPerNode=5, maxDepth=10, seed=0,
            maxBins=max(SPLITS + 1, math.isqrt(n) + 1),
        )
        values = forest.fit(_binned(inside, factors)).featureImportances.toArray()
        total = float(np.abs(values).sum())
        shares = values / total if total > 0 else np.full(len(factors), 1.0 / len(factors))
        return date, dict(zip(factors, map(float, shares), strict=True))

    with ThreadPool(4 if all(n <= SIDE_BY_SIDE for _, n, _ in refits) else 1) as pool:
        fitted = pool.map(fit, refits)  # a row per refit
    return spark.createDataFrame(fitted, "refit_date date, weights map<string,double>")


def _binned(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """The rows with ``_features``: the bin of each factor among quantiles of all of them."""
    points = [k / SPLITS for k in range(1, SPLITS)]
    cuts = rows.agg(*[F.percentile_approx(f, points, F.lit(ACCURACY)).alias(f) for f in factors]).first()
    splits = []
    for f in factors:
        inner = sorted({float(c) for c in cuts[f] if math.isfinite(c)}) or [0.0]
        splits.append([-math.inf, *inner, math.inf])
    names = [f"_bin_{f}" for f in factors]
    binned = Bucketizer(splitsArray=splits, inputCols=list(factors), outputCols=names).transform(rows)
    return VectorAssembler(inputCols=names, outputCol="_features").transform(binned)


def method_scores(panel: DataFrame, weights: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``date, code, method, factor_score`` of every weighting method in one join (A12): a
    missing factor counts 0. The weight table has a row per session, method and factor."""
    wide = weights.groupBy("date", "method").agg(*[F.max(F.when(F.col("factor") == f, F.col("weight"))).alias(f"_w_{f}") for f in factors])
    total = F.lit(0.0)
    for f in factors:
        total = total + F.coalesce(F.col(f), F.lit(0.0)) * F.col(f"_w_{f}")
    return panel.select("date", "code", *factors).join(F.broadcast(wide), "date").select("date", "code", "method", total.alias("factor_score"))


# ---------------------------------------------------------------- adaptation and versions


def adaptive_weights(stats: DataFrame, method: str = "equal") -> DataFrame:
    """``strategy, factor, weight, metric`` from research evidence.

    ``stats``: ``strategy, factor`` with ``ic, icir, average_return, contribution``; a
    strategy has one row per factor.
    """
    columns = {"ic": "ic", "icir": "icir", "rolling_performance": "average_return", "realized_contribution": "contribution"}
    w = Window.partitionBy("strategy")

    def allocation(x: Column) -> Column:
        raw = F.coalesce(F.abs(x), F.lit(0.0))
        total = F.sum(raw).over(w)
        return F.when(total > 0, raw / total).otherwise(1.0 / F.count(F.lit(1)).over(w))

    if method == "combined":
        parts = ((0.4, "ic"), (0.3, "icir"), (0.3, "contribution"))
        weight = sum((F.lit(p) * allocation(F.col(c)) for p, c in parts), F.lit(0.0))
        metric = sum((F.lit(p) * F.coalesce(c, F.lit(0.0)) for p, c in parts), F.lit(0.0))
    elif method == "equal":
        weight, metric = allocation(F.lit(1.0)), F.lit(1.0)
    elif method in columns:
        weight, metric = allocation(F.col(columns[method])), F.col(columns[method])
    else:
        raise ValueError(f"evidence cannot be weighted by {method}")
    return stats.select("strategy", "factor", weight.alias("weight"), metric.alias("metric"))


def bounded_evolution(weights: DataFrame, max_change: float = 0.10) -> DataFrame:
    """Move base weights towards targets within +/- max change, summing to one.

    ``weights``: ``strategy, factor, base, target``. After clipping, the missing or surplus
    total is spread over the remaining room in proportion to it; one pass is exact because
    the base itself is feasible.
    """
    w = Window.partitionBy("strategy")

    def normal(x: Column) -> Column:
        v = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
        total = F.sum(v).over(w)
        return F.when(total > 0, v / total).otherwise(1.0 / F.count(F.lit(1)).over(w))

    df = weights.withColumns({"previous_weight": normal(F.col("base")), "_t": normal(F.col("target"))})
    lo = F.greatest(F.col("previous_weight") - max_change, F.lit(0.0))
    hi = F.least(F.col("previous_weight") + max_change, F.lit(1.0))
    df = df.withColumn("_c", F.least(F.greatest(F.col("_t"), lo), hi))
    gap = 1 - F.sum("_c").over(w)
    df = df.withColumn("_gap", gap)
    room = F.when(F.col("_gap") > 0, hi - F.col("_c")).otherwise(F.col("_c") - lo)
    df = df.withColumn("_room", F.greatest(room, F.lit(0.0)))
    share = F.coalesce(ratio(F.col("_room"), F.sum("_room").over(w)), F.lit(0.0))
    moved = F.col("_c") + F.when(F.abs("_gap") >= 1e-12, share * F.col("_gap")).otherwise(0.0)
    return df.withColumn("weight", moved).select(
        "strategy", "factor", "previous_weight", F.col("target").alias("target_weight"), "weight",
        (F.col("weight") - F.col("previous_weight")).alias("weight_change"),
    )


def factor_stability(log: DataFrame) -> DataFrame:
    """Absolute mean over months of the monthly mean score x return."""
    rows = log.filter(F.col("future_return").isNotNull()).select(
        F.date_format("date", "yyyy-MM").alias("month"), "future_return", F.explode("factor_scores").alias("factor", "score")
    )
    monthly = rows.filter(F.col("score").isNotNull()).groupBy("factor", "month").agg(
        F.avg(F.col("score") * F.col("future_return")).alias("_m")
    )
    return monthly.groupBy("factor").agg(F.abs(F.avg("_m")).alias("stability"))


def version_log(history: DataFrame) -> DataFrame:
    """A new version each time a strategy's weights differ from the last ones.

    ``history``: ``strategy, date, factor, weight, direction``; a snapshot holds one row per
    factor. Returns ``strategy, version, date, fingerprint``.
    """
    entry = F.struct("factor", "weight", "direction")
    shots = history.groupBy("strategy", "date").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("fingerprint")
    )
    w = Window.partitionBy("strategy").orderBy("date")
    changed = ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))
    kept = shots.withColumn("_new", changed).filter("_new")
    return kept.select("strategy", F.row_number().over(w).alias("version"), "date", "fingerprint")


def factor_evidence(weights: DataFrame, stats: DataFrame, stability: DataFrame) -> DataFrame:
    """Weights with the statistics and stability that back them."""
    return weights.join(stats, "factor", "left").join(stability, "factor", "left")
