"""Statistics, labels, errors and weights: hand numbers, pandas and leakage."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from panelmill.functions.groups import durable
from panelmill.operators import cross_section as xs
from panelmill.operators import errors as er
from panelmill.operators import factor_stats as fs
from panelmill.operators import labels as lb
from panelmill.operators import models as ml
from panelmill.operators import weights as wt
from tests.helpers import panel, rows, same


def test_hand_computed_ic(spark):
    data = [(d, f"{i}", float(i), r) for d, rs in (("2024-01-01", (.01, .02, .03)), ("2024-01-02", (.01, .03, .02))) for i, r in enumerate(rs, 1)]
    df = spark.createDataFrame(data, "date string, code string, mom_5 double, future_return double").withColumn("date", F.col("date").cast("date"))
    daily = fs.daily_ic(df, ["mom_5"], "future_return")
    s = fs.ic_summary(daily).first()
    assert s["ic_mean"] == pytest.approx(0.75) and s["ic_std"] == pytest.approx(0.5**0.5 / 2)
    assert s["icir"] == pytest.approx(3 / 2**0.5) and s["status"] == "ok"
    p = fs.spread_summary(daily).first()
    assert p["average_return"] == pytest.approx(0.015) and p["win_rate"] == 1.0
    assert fs.ic_summary(daily, 3).first()["status"] == "insufficient_data"


def test_a_flat_factor_has_no_residual(spark):
    """Equal values leave 0 for every name, not the last bit by which a sum over a count misses them."""
    names = [(pd.Timestamp("2020-01-01").date(), f"{i:06d}", f"I{i % 3}", 0.1 * (i % 3 + 1), 0.3 + i % 3 / 7, 10.0 + i) for i in range(21)]
    df = spark.createDataFrame(names, "date date, code string, industry string, f double, cap double, market_cap double")
    for cap in ("market_cap", "cap"):
        got = xs.neutralize(df, ["f"], cap=cap).select("f_neutralized").toPandas()["f_neutralized"]
        assert (got == 0).all()


def test_neutralize_matches_least_squares(spark):
    rng = np.random.default_rng(6)
    n = 40
    pdf = pd.DataFrame({"date": "2024-01-01", "code": [f"{i:06d}" for i in range(n)], "industry": rng.choice(list("abcd"), n),
                        "market_cap": rng.uniform(1, 100, n), "f": rng.normal(size=n)})
    pdf.loc[3, "market_cap"] = -1.0
    got = rows(xs.neutralize(spark.createDataFrame(pdf), ["f"]), "code")["f_neutralized"]
    cap = pdf["market_cap"].where(pdf["market_cap"] > 0)
    x = np.column_stack([pd.get_dummies(pdf["industry"], dtype=float), np.log(cap.fillna(cap.median()))])
    e = pdf["f"] - x @ np.linalg.lstsq(x, pdf["f"], rcond=None)[0]
    np.testing.assert_allclose(got, (e - e.mean()) / e.std(ddof=0), rtol=1e-8, atol=1e-10)


def test_saturated_design_only_demeans(spark):
    pdf = pd.DataFrame({"date": "2024-01-01", "code": list("abcde"), "industry": list("vwxyz"), "f": [1., 2., 3., 4., 10.]})
    got = rows(xs.neutralize(spark.createDataFrame(pdf), ["f"]), "code")["f_neutralized"]
    np.testing.assert_allclose(got, (pdf["f"] - 4) / pdf["f"].std(ddof=0))


def test_clean_ignores_infinities(spark):
    pdf = pd.DataFrame({"date": "2024-01-01", "code": list("abcdef"), "f": [1., 2., np.inf, np.nan, 3., -np.inf]})
    got = rows(xs.clean(spark.createDataFrame(pdf), ["f"]), "code")["f"]
    np.testing.assert_allclose(got, [1, 2, 2, 2, 3, 2])


def test_composite_needs_every_factor(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0)], "code string, x_z double, y_z double")
    got = {r["code"]: r["s"] for r in df.select("code", xs.composite({"x": (0.5, 1), "y": (0.5, -1)}).alias("s")).collect()}
    assert got == {"a": -0.5, "b": None}


def test_scores_do_not_see_the_future(spark):
    pdf = panel(10, 60, seed=2)
    cut = sorted(pdf["date"].unique())[40]
    later = pdf.copy()
    later.loc[later["date"] > cut, "close"] *= 5

    def upto(p):
        df = xs.process_scores(spark.createDataFrame(p), ["close", "volume"]).filter(F.col("date") <= F.lit(cut))
        return rows(df, "code", "date")

    pd.testing.assert_frame_equal(upto(pdf), upto(later))


def test_calibration_uses_matured_labels_only(spark):
    pdf = panel(12, 90, seed=4)
    df = spark.createDataFrame(pdf).withColumn("composite_score", F.col("volume"))
    events = lb.rebalance_events(df, 10)
    labels = lb.event_labels(df, df, events)
    got = rows(lb.calibration(labels, events.select("event", "signal_date")), "event")
    known = labels.toPandas()
    for r in got.itertuples():
        past = known[known["exit_date"] < r.signal_date]
        assert r.n_obs == len(past)
        if len(past) >= 30:
            slope, icpt = np.polyfit(past["score"], past["future_return"], 1)
            assert r.slope == pytest.approx(slope, rel=1e-6) and r.intercept == pytest.approx(icpt, rel=1e-6)
        else:
            assert np.isnan(r.slope)


@pytest.mark.parametrize("seed", range(3))
def test_calibration_windows_match_the_range_join(spark, seed):
    """Lower bounds inside, before and after the known labels; events of one score; ties in time."""
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2021-01-04", periods=80).date
    rows_ = []
    for key in ("a", "b"):
        for i in range(0, 60, 4):
            same = rng.uniform() < 0.6
            for _ in range(rng.integers(0, 5)):
                rows_.append((key, days[i], days[i + 6 - 6 * (i % 8 == 4) + 4 * (i % 8 == 4)], 2.0 if same else float(rng.normal()), float(rng.normal())))
    labels = spark.createDataFrame(rows_, "k string, signal_date date, exit_date date, score double, future_return double")
    known = pd.DataFrame(rows_, columns=["k", "signal_date", "exit_date", "score", "future_return"])
    signals = [(k, days[i], days[max(0, i - back)]) for k in ("a", "b", "none") for i in range(0, 80, 5) for back in (0, 3, 11, 40)]
    table = spark.createDataFrame(signals, "k string, signal_date date, low date")
    for lower in ("low", None):
        got = lb.calibration(labels, table, 3, lower, ("k",)).collect()
        assert len(got) == len(signals)
        for r in got:
            past = known[(known["k"] == r["k"]) & (known["exit_date"] < r["signal_date"])]
            if lower:
                past = past[past["signal_date"] >= r["low"]]
            assert r["n_obs"] == len(past) and r["training_end"] == (past["exit_date"].max() if len(past) else None)
            if len(past) >= 3 and past["score"].nunique() > 1:
                slope, icpt = np.polyfit(past["score"], past["future_return"], 1)
                assert r["slope"] == pytest.approx(slope, rel=1e-6) and r["intercept"] == pytest.approx(icpt, rel=1e-6, abs=1e-9)
            else:
                assert r["slope"] is None and r["intercept"] is None
    plan = lb.calibration(labels, table, 3, "low", ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("n", [1, 2, 4, 7, 11, 23, 60])
def test_score_buckets_match_qcut(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"date": pd.Timestamp("2024-01-01").date(), "symbol": [f"{i:06d}" for i in range(n)], "strategy": "s",
                        "model_score": rng.integers(0, max(2, n // 2), n).astype(float)})
    got = rows(er.with_score_bucket(spark.createDataFrame(pdf)), "symbol")["prediction_score_bucket"].tolist()
    q = min(5, pdf["model_score"].nunique(), n)
    want = ["Q1"] * n if q < 2 else pd.qcut(pdf["model_score"].rank(method="first"), q, labels=[f"Q{i}" for i in range(1, q + 1)]).astype(str).tolist()
    assert got == want


def test_confusion_and_states(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (-1.0, -1.0), (-1.0, 1.0)], "s double, r double")
    got = [r["c"] for r in df.select(er.confusion(F.col("s"), F.col("r")).alias("c")).collect()]
    assert got == ["true_positive", "false_positive", "true_negative", "false_negative"]


def test_optimized_weights_match_numpy(spark):
    rng = np.random.default_rng(3)
    dates = pd.bdate_range("2024-01-01", periods=40).date
    names = ["a", "b", "c"]
    ic = rng.normal(0.02, 0.1, (40, 3))
    ic[5, 1] = np.nan
    daily = spark.createDataFrame(
        [(d, f, None if np.isnan(v) else float(v)) for d, row in zip(dates, ic) for f, v in zip(names, row)], "date date, factor string, ic double")
    days = spark.createDataFrame([(d,) for d in dates], "date date")
    got = wt.combination_weights(daily, days, names, "rolling_optimized", 10).toPandas().pivot(index="date", columns="factor", values="weight")
    for i, d in enumerate(dates):
        prior = ic[max(0, i - 10):i]
        want = np.full(3, 1 / 3)
        if len(prior) >= 2:
            raw = np.linalg.pinv(np.cov(np.nan_to_num(prior), rowvar=False) + np.eye(3) * 1e-6) @ np.nanmean(prior, axis=0)
            want = raw / np.abs(raw).sum()
        np.testing.assert_allclose(got.loc[d, names], want, rtol=1e-7)


def test_combination_ignores_the_ic_of_the_same_date(spark):
    dates = pd.bdate_range("2024-01-01", periods=3).date
    rows_ = [(dates[0], "a", 0.1), (dates[0], "b", 0.3), (dates[2], "a", 99.0), (dates[2], "b", -99.0)]
    daily = spark.createDataFrame(rows_, "date date, factor string, ic double")
    days = spark.createDataFrame([(d,) for d in dates], "date date")
    got = {(r["date"], r["factor"]): r["weight"] for r in wt.combination_weights(daily, days, ["a", "b"], "ic").collect()}
    assert got[(dates[0], "a")] == 0.5
    assert got[(dates[2], "a")] == pytest.approx(0.25) and got[(dates[2], "b")] == pytest.approx(0.75)


def test_rolling_regression_matches_lstsq(spark):
    pdf = panel(10, 80, seed=12)
    rng = np.random.default_rng(1)
    pdf["x1"], pdf["x2"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = 0.3 * pdf["x1"] - 0.1 * pdf["x2"] + rng.normal(0, 0.5, len(pdf))
    got = wt.rolling_weights(spark.createDataFrame(pdf[["date", "code", "x1", "x2", "y"]]), None, ["x1", "x2"], "y", horizon=5, window=20, every=10,
                             methods=("regression",)).toPandas().pivot(index="date", columns="factor", values="weight")
    dates = sorted(pdf["date"].unique())
    for i in (0, 9, 10, 35, 79):
        refit = i // 10 * 10
        want = np.array([0.5, 0.5])
        if refit >= 5:
            used = pdf[pdf["date"].isin(dates[max(0, refit - 5 - 19): refit - 5 + 1])]
            x = np.column_stack([np.ones(len(used)), used[["x1", "x2"]]])
            b = np.linalg.lstsq(x, used["y"], rcond=None)[0][1:]
            want = b / np.abs(b).sum()
        np.testing.assert_allclose(got.loc[dates[i], ["x1", "x2"]], want, rtol=1e-7)


def test_bounded_evolution(spark):
    rng = np.random.default_rng(5)
    data = [(f"s{k}", f"f{i}", float(b), float(t)) for k in range(30) for i, (b, t) in enumerate(zip(rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6) * 0.3)))]
    df = wt.bounded_evolution(spark.createDataFrame(data, "strategy string, factor string, base double, target double")).toPandas()
    assert (df["weight_change"].abs() <= 0.10 + 1e-9).all() and (df["weight"] >= -1e-12).all()
    np.testing.assert_allclose(df.groupby("strategy")["weight"].sum(), 1.0)


def test_adaptive_weights(spark):
    df = spark.createDataFrame([("s", "a", 0.1, 1.0, 0.0, 0.2), ("s", "b", -0.2, 1.0, 0.0, 0.2)],
                               "strategy string, factor string, ic double, icir double, average_return double, contribution double")
    got = {r["factor"]: r["weight"] for r in wt.adaptive_weights(df, "ic").collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": 2 / 3})
    zero = {r["factor"]: r["weight"] for r in wt.adaptive_weights(df, "rolling_performance").collect()}
    assert zero == {"a": 0.5, "b": 0.5}


def test_versions_only_on_change(spark):
    data = [("s", d, f, w, 1) for d, ws in (("2024-01-01", (0.4, 0.6)), ("2024-01-02", (0.4, 0.6)), ("2024-01-03", (0.5, 0.5))) for f, w in zip("ab", ws)]
    got = wt.version_log(spark.createDataFrame(data, "strategy string, date string, factor string, weight double, direction int")).collect()
    assert [(r["version"], r["date"]) for r in sorted(got, key=lambda r: r["version"])] == [(1, "2024-01-01"), (2, "2024-01-03")]


def test_ridge_matches_normal_equations(spark, tmp_path):
    pdf = panel(8, 30, seed=1)
    rng = np.random.default_rng(2)
    pdf["a"], pdf["b"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = 0.5 * pdf["a"] + rng.normal(0, 0.1, len(pdf))
    df = spark.createDataFrame(pdf[["date", "code", "a", "b", "y"]])
    model = ml.fit_ranking(df, ["a", "b"], "y", "linear", cleaned=True, alpha=2.0)
    x, y = pdf[["a", "b"]] - pdf[["a", "b"]].mean(), pdf["y"] - pdf["y"].mean()
    want = np.linalg.solve(x.T @ x + 2.0 * np.eye(2), x.T @ y)
    np.testing.assert_allclose(model.stages[-1].inner.coefficients.toArray(), want, rtol=1e-6)
    gaps = df.withColumn("a", F.when(F.col("code") != "000001", F.col("a")))
    got = model.transform(gaps)
    assert got.filter(F.col("prediction").isNull()).count() == 30
    ic = fs.prediction_ic(model.transform(df), "prediction", "y").first()
    assert ic["prediction_ic"] > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    np.testing.assert_allclose(again.stages[-1].inner.coefficients.toArray(), model.stages[-1].inner.coefficients.toArray())


def test_forest_and_boosting_find_a_planted_signal(spark):
    pdf = panel(20, 30, seed=1)
    rng = np.random.default_rng(2)
    pdf["a"], pdf["b"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = pdf["a"] + rng.normal(0, 0.2, len(pdf))
    df = spark.createDataFrame(pdf[["date", "code", "a", "b", "y"]])
    for name, params in (("random_forest", {"numTrees": 10}), ("gradient_boosting", {"maxIter": 4, "maxDepth": 3})):
        model = ml.fit_ranking(df, ["a", "b"], "y", name, cleaned=True, **params)
        top = ml.feature_importance(model, spark).orderBy(F.desc("importance")).first()
        assert top["feature"] == "a"
        assert fs.prediction_ic(model.transform(df), "prediction", "y").first()["prediction_rank_ic"] > 0.5


def test_pipeline_cleans_saves_and_loads(spark, tmp_path):
    """The cleaning stage is part of the saved pipeline, and an unfitted one can be saved as well."""
    rng = np.random.default_rng(5)
    pdf = panel(12, 20, seed=5)
    pdf["a"], pdf["b"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = 0.5 * pdf["a"] + rng.normal(0, 0.1, len(pdf))
    pdf.loc[::37, "a"] = np.inf
    pdf.loc[5::41, "b"] = 1e9
    df = spark.createDataFrame(pdf[["date", "code", "a", "b", "y"]])
    for name, params in (("random_forest", {"numTrees": 5}), ("linear", {"alpha": 3.0})):
        ml.ranking_pipeline(["a", "b"], "y", name, **params).write().overwrite().save(str(tmp_path / name))
        model = Pipeline.load(str(tmp_path / name)).fit(df)
        model.write().overwrite().save(str(tmp_path / f"{name}-fitted"))
        again = PipelineModel.load(str(tmp_path / f"{name}-fitted"))
        assert again.stages[0].getInputCols() == ["a", "b"] and again.stages[0].getOrDefault("sigma") == 3.0
        a, b = (rows(m.transform(df).select("date", "code", "prediction"), "date", "code") for m in (model, again))
        pd.testing.assert_frame_equal(a, b)
        assert a["prediction"].notna().all()
    by_hand = ml.fit_ranking(xs.clean(df, ["a", "b"]), ["a", "b"], "y", "linear", cleaned=True, alpha=3.0)
    same(a, rows(by_hand.transform(xs.clean(df, ["a", "b"])), "date", "code"), ["prediction"])
    with pytest.raises(ValueError, match="no ranking model"):
        ml.fit_ranking(df, ["a", "b"], "y", "nope")


@pytest.mark.parametrize("seed", range(3))
def test_refits_follow_the_sessions(spark, seed):
    """Refit sessions against a walk, with thin stretches in which no model can be fitted."""
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=150).date
    thin = set(days[40:70]) if seed else set()
    rows_ = [(d, f"{i:06d}", float(rng.normal()), None if d in thin else 1.0) for d in days for i in range(6)]
    df = spark.createDataFrame(rows_, "date date, code string, x double, y double")
    got = {r["idx"]: (r["first"], r["last"], r["usable"]) for r in ml.refit_table(df, ["x", "y"], 5, 8, 25, 17, 130).collect()}
    want, due = {}, 0
    for idx in range(0, len(days) - 1, 5):
        if idx < 8 or idx < due:
            continue
        end = idx - 8
        used = [d for d in days[max(0, end - 24) : end + 1] if d not in thin]
        usable = len(used) >= 20 and 6 * len(used) >= 130
        want[idx] = (days[max(0, end - 24)], days[end], usable)
        due = idx + 17 if usable else 0
    assert got == want


def test_factors_ranked_in_turns_agree_and_a_stored_panel_is_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame([(d, f"{i:03d}") for d in pd.bdate_range("2020-01-01", periods=4).date for i in range(30)], columns=["date", "code"])
    for c in ("f", "g", "h", "y"):
        pdf[c] = np.where(rng.random(len(pdf)) < 0.2, np.nan, rng.integers(0, 9, len(pdf)))
    panel = durable(xs.finite_columns(spark.createDataFrame(pdf), ["f", "g", "h", "y"]))
    want = rows(fs.daily_ic(panel, ["f", "g", "h"], "y"), "date", "factor")
    written, write = [], fs.durable
    monkeypatch.setattr(fs, "durable", lambda df: written.append(df.columns) or write(df))
    monkeypatch.setattr(fs, "RANKED_AT_ONCE", 200)  # two of the three factors
    got = rows(fs.daily_ic(panel, ["f", "g", "h"], "y"), "date", "factor")
    pd.testing.assert_frame_equal(got, want)
    assert len(got) == 12 and len(written) == 2 and all("ic" in columns for columns in written)
    again = rows(fs.daily_ic(panel.filter("code < '999'"), ["f", "g", "h"], "y"), "date", "factor")
    pd.testing.assert_frame_equal(again, want)


def test_forest_weights_follow_the_signal(spark):
    """The planted factor changes half way; samples are bounded and do not depend on row order."""
    rng = np.random.default_rng(8)
    days = pd.bdate_range("2020-01-01", periods=200).date
    pdf = pd.DataFrame([(d, f"{i:06d}") for d in days for i in range(12)], columns=["date", "code"])
    pdf["f"], pdf["g"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = np.where(pdf["date"] < days[100], pdf["f"], pdf["g"]) + rng.normal(0, 0.1, len(pdf))
    df = spark.createDataFrame(pdf)
    got = wt.rolling_weights(df, None, ["f", "g"], "y", horizon=5, window=40, methods=("ml",), ml_every=60, ml_sample=300, ml_trees=5)
    weight = {(r["date"], r["factor"]): r["weight"] for r in got.collect()}
    assert weight[(days[3], "f")] == 0.5 and weight[(days[70], "f")] > 0.8 and weight[(days[190], "g")] > 0.8
    assert all(weight[(d, "f")] + weight[(d, "g")] == pytest.approx(1.0) for d in days)
    cal = lb.calendar(df)
    one, two = (rows(wt.training_samples(some, cal, 5, ["f", "g"], "y", 40, 60, 300), "refit_date", "f", "g") for some in (df, df.orderBy(F.rand(1)).repartition(7)))
    pd.testing.assert_frame_equal(one, two)
    assert one.groupby("refit_date").size().tolist() == [300, 300, 300]
    scored = rows(wt.method_scores(df, got, ["f", "g"]), "date", "code")
    sample = scored.iloc[1234]
    want = pdf.sort_values(["date", "code"]).iloc[1234]
    assert sample["factor_score"] == pytest.approx(want["f"] * weight[(want["date"], "f")] + want["g"] * weight[(want["date"], "g")])


def test_forest_weights_come_from_every_row_of_the_window(spark, monkeypatch):
    """24,000 rows in the window: all reach the forest, and its thresholds come from all of them."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 600).cast("int"))
    some = F.xxhash64("id") / float(2**63)
    df = spark.range(36_000).select(
        day.alias("date"), F.format_string("%06d", F.col("id") % 600).alias("code"), some.alias("f"), F.rand(3).alias("g"), some.alias("y")
    )
    fitted, forest = [], wt.RandomForestRegressor

    def watched(**params):
        made, fit = forest(**params), forest.fit
        monkeypatch.setattr(forest, "fit", lambda self, data: fitted.append((data.count(), self.getMaxBins())) or fit(self, data))
        return made

    monkeypatch.setattr(wt, "RandomForestRegressor", watched)
    got = wt.rolling_weights(df, None, ["f", "g"], "y", horizon=5, window=40, methods=("ml",), ml_every=50, ml_trees=3).collect()
    assert fitted[0][0] == 24_000 and fitted[0][1] ** 2 >= 24_000
    assert max(r["weight"] for r in got if r["factor"] == "f") > 0.9


def test_training_samples_rank_few_rows_more_than_they_keep(spark, monkeypatch):
    days = pd.bdate_range("2020-01-01", periods=70).date
    pdf = pd.DataFrame([(d, f"{i:06d}", float(i), 1.0) for d in days for i in range(60)], columns=["date", "code", "f", "y"])
    df, ranked, top = spark.createDataFrame(pdf), [], wt.top_per_group
    monkeypatch.setattr(wt, "top_per_group", lambda rows_, *rest: ranked.append(rows_) or top(rows_, *rest))
    got = wt.training_samples(df, lb.calendar(df), 5, ["f"], "y", 40, 60, 300)
    assert got.count() == 300 and ranked[0].count() <= 310  # 2,400 rows in the window
    place = F.xxhash64("date", "code")
    window = df.join(lb.calendar(df), "date").filter("idx > 15 and idx <= 55")
    want = window.orderBy(place).limit(300).select("f").toPandas()["f"].sort_values().tolist()
    assert sorted(r["f"] for r in got.collect()) == want
