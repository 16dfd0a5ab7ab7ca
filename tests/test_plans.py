"""Replay, scenarios, annual research, daily batch and streaming."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.catalog.cross import WEIGHTS
from panelmill.operators import labels as lb
from panelmill.operators import risk as rk
from panelmill.operators import timeseries as ts
from panelmill.plans import annual, daily, replay
from panelmill.streaming import bars as sb
from panelmill.streaming.state import ROCKSDB, rocksdb, running_state
from tests.helpers import panel, rows


@pytest.fixture(scope="module")
def inputs(spark):
    pdf = panel(15, 120, seed=21)
    bars = spark.createDataFrame(pdf)
    rng = np.random.default_rng(1)
    pdf["score"] = rng.normal(size=len(pdf))
    scored = spark.createDataFrame(pdf[["date", "code", "score"]]).withColumns({"variant": F.lit("base"), "kept": F.col("code").cast("int") % 2 == 0})
    both = scored.unionByName(scored.withColumns({"variant": F.lit("plus"), "score": F.col("score") * 2})).unionByName(
        scored.withColumns({"variant": F.lit("minus"), "score": -F.col("score")}))
    members = spark.createDataFrame([(f"{i:06d}", f"I{i % 5}") for i in range(15)], "code string, industry string")
    bench = bars.groupBy("date").agg(F.avg("close").alias("close"))
    return pdf, both, bars, members, rk.market_regime(bench), bars.select("date").distinct()


def test_scenario_matrix_contains_the_single_replay(spark, inputs):
    _, scored, bars, members, regimes, dates = inputs
    settings = replay.ReplaySettings(top_n=5, min_labels=10)
    many = replay.robustness_scenarios(spark)
    one = spark.createDataFrame([replay.BASE], replay.SCENARIO_SCHEMA)
    all_ = replay.replay(scored, bars, members, regimes, dates, many, settings)
    base = rows(replay.replay(scored, bars, members, regimes, dates, one, settings).drop("scenario"), "date", "code")
    for name in ("rebalance_frequency=10", "universe_fraction=1.0", "transaction_cost_multiplier=2.0"):
        same = rows(all_.filter(F.col("scenario") == name).drop("scenario"), "date", "code")
        pd.testing.assert_frame_equal(same, base)
    thin = all_.filter(F.col("scenario") == "universe_fraction=0.8")
    assert thin.filter(F.col("code").cast("int") % 2 == 1).count() == 0 and thin.count() > 0
    curves = replay.scenario_curves(all_, bars, many)
    final = {r["scenario"]: r["equity"] for r in curves.groupBy("scenario").agg(F.max_by("equity", "date").alias("equity")).collect()}
    assert final["transaction_cost_multiplier=0.5"] > final["transaction_cost_multiplier=1.0"] > final["transaction_cost_multiplier=2.0"]
    assert len(final) == 10


def test_replay_ignores_the_future(spark, inputs):
    pdf, scored, bars, members, regimes, dates = inputs
    cut = sorted(pdf["date"].unique())[90]
    changed = bars.withColumn("open", F.when(F.col("date") > F.lit(cut), F.col("open") * 4).otherwise(F.col("open")))
    one = spark.createDataFrame([replay.BASE], replay.SCENARIO_SCHEMA)
    a, b = (rows(replay.replay(scored, p, members, regimes, dates, one).filter(F.col("signal_date") <= F.lit(cut)), "date", "code") for p in (bars, changed))
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b)


def test_thinning_matches_linspace(spark):
    for n, fraction in ((10, 0.8), (37, 0.5), (100, 0.8), (6, 0.1)):
        codes = spark.createDataFrame([(f"{i:06d}",) for i in range(n)], "code string")
        m = max(5, int(n * fraction))
        want = {f"{i * (n - 1) // (m - 1):06d}" for i in range(m)}
        assert {r["code"] for r in replay.thinned_codes(codes, fraction).collect()} == want


def test_weight_variants(spark):
    got = {}
    for r in replay.weight_variants(spark, WEIGHTS, {"base": 0.0, "minus": -0.05, "plus": 0.05, "all": 5.0, "none": -5.0}).collect():
        got.setdefault(r["variant"], {})[r["factor"]] = r["weight"]
    assert got["base"] == {f: w * sign for f, (w, sign) in WEIGHTS.items()}
    for name, lead in (("minus", 0.05), ("plus", 0.15), ("all", 1.0), ("none", 0.0)):
        assert got[name]["momentum_5"] == pytest.approx(lead) and sum(map(abs, got[name].values())) == pytest.approx(1.0)
        assert got[name]["drawdown"] == pytest.approx(-0.15 / 0.9 * (1 - lead))
    alone = replay.weight_variants(spark, {"x": (1.0, 1)}, {"v": -0.5}).collect()
    assert [(r["factor"], r["weight"]) for r in alone] == [("x", 0.5)]


def test_a_failing_cell_leaves_the_others(spark, inputs):
    _, scored, bars, members, regimes, dates = inputs
    bad = [("a", "bad", 0, 1.0, "base", False), ("b", "bad", None, 1.0, "base", False), ("c", "bad", 10, -1.0, "base", False),
           ("d", "bad", 10, 1.0, "nope", False), ("e", "bad", 10, 1.0, None, False), ("f", "bad", 900, 1.0, "base", False)]
    scenarios = spark.createDataFrame([replay.BASE, *bad], replay.SCENARIO_SCHEMA)
    checked = replay.checked_scenarios(scenarios, scored.select("variant"))
    sound = checked.filter("problem IS NULL").drop("problem")
    held = replay.replay(scored, bars, members, regimes, dates, sound, replay.ReplaySettings(top_n=5, min_labels=10))
    curve = replay.scenario_curves(held, bars, sound)
    metrics = curve.groupBy("scenario").agg((F.max("equity") / F.min("equity")).alias("x"), F.lit(float("nan")).alias("y"))
    progress = held.groupBy("scenario").agg(F.countDistinct("date").alias("baskets")).join(
        curve.groupBy("scenario").agg(F.count(F.lit(1)).alias("sessions")), "scenario")
    got = {r["scenario"]: r for r in replay.scenario_report(checked, metrics, ["x"], progress).collect()}
    assert got["base"]["status"] == "available" and got["base"]["x"] > 0 and got["base"]["detail"] == "measured"
    assert {k: r["detail"] for k, r in got.items() if k != "base"} == {
        "a": "a rebalance every 0 sessions", "b": "a rebalance every ? sessions", "c": "costs are not a positive multiple",
        "d": "no scores of variant nope", "e": "no scores of variant ?", "f": "no signal had enough matured labels"}
    assert all(r["x"] is None for k, r in got.items() if k != "base")
    undefined = replay.scenario_report(checked, metrics, ["x", "y"], progress).filter("scenario = 'base'").first()
    assert (undefined["status"], undefined["detail"]) == ("unavailable", "undefined: y")


def test_grids(spark):
    assert replay.parameter_grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6
    grid = replay.weight_grid(spark, ["a", "b"], [0.0, 1.0])
    assert sorted((r["a"], r["b"]) for r in grid.collect()) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    assert replay.parameter_grid(spark, {"a": range(100), "b": range(200)}).count() == 20_000
    with pytest.raises(ValueError, match="without values"):
        replay.parameter_grid(spark, {"a": [], "b": [1]})
    best = replay.search(grid, lambda g: g.withColumn("s", F.col("a")), "s").first()
    assert best["a"] == 1.0


def test_retrain_interval_keeps_the_last_line(spark):
    df = spark.createDataFrame([("s", i, "d", 40, "e", float(i), float(i)) for i in range(5)],
                               "scenario string, event int, signal_date string, n_obs int, training_end string, intercept double, slope double")
    got = rows(replay.carried_fit(df, 2), "event")
    assert got["slope"].tolist() == [0.0, 0.0, 2.0, 2.0, 4.0]


def test_annual_walk_forward_matches_numpy(spark):
    rng = np.random.default_rng(3)
    dates = [d.date() for d in pd.date_range("2018-01-31", "2023-12-31", freq="ME")]
    pdf = pd.DataFrame([(d, f"{i:06d}") for d in dates for i in range(10)], columns=["date", "code"])
    pdf["f"], pdf["g"] = rng.normal(size=len(pdf)), rng.normal(size=len(pdf))
    pdf["y"] = 0.02 * pdf["f"] + rng.normal(0, 0.02, len(pdf))
    got = rows(annual.annual_walk_forward(spark.createDataFrame(pdf), ["f", "g"], "y", horizon=2), "period")
    assert got["period"].tolist() == ["2022", "2023"]
    for r in got.itertuples():
        year = int(r.period)
        first = min(d for d in dates if d.year == year)
        cut = [d for d in dates if d < first][:-2]
        train = pdf[pdf["date"].map(lambda d: year - 4 <= d.year < year and d in cut)]
        b = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[["f", "g"]]]), train["y"], rcond=None)[0][1:]
        w = b / np.abs(b).sum()
        rets = []
        for d in [d for d in dates if d.year == year][::2]:
            day = pdf[pdf["date"] == d]
            s = day["f"] * w[0] + day["g"] * w[1]
            rets.append(day.loc[s.nlargest(2).index, "y"].mean())
        assert getattr(r, "_2") == pytest.approx(np.prod(1 + np.array(rets)) - 1)


def test_period_research(spark):
    dates = pd.date_range("2018-01-01", "2023-06-30", freq="W-MON").date
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(d, f"{i:06d}") for d in dates for i in range(9)], columns=["date", "code"])
    pdf["x"] = rng.normal(size=len(pdf))
    pdf["y"] = 0.02 * pdf["x"] + rng.normal(0, 0.02, len(pdf))
    df = spark.createDataFrame(pdf)
    periods = lb.rolling_periods(df)
    assert lb.chronology_breaks(periods).count() == 0
    got = rows(annual.run_periods(df, periods, lambda some: annual.slope_research(some, "x", "y", 4)), "period")
    spans = periods.toPandas().set_index(["period", "part"])
    assert got["period"].tolist() == sorted({p for p, _ in spans.index}) and len(got) > 2
    for r in got.to_dict("records"):
        part = lambda name, r=r: pdf[pdf["date"].between(*spans.loc[(r["period"], name), ["start_date", "end_date"]])]
        train, test = part("train"), part("test")
        slope = np.polyfit(train["x"], train["y"], 1)[0]
        picks, market = [], []
        for d in sorted(test["date"].unique())[::4]:
            day = test[test["date"] == d]
            picks.append(day.loc[(slope * day["x"]).nlargest(2).index, "y"].mean())
            market.append(day["y"].mean())
        nav = np.cumprod(1 + np.array(picks))
        assert r["return"] == pytest.approx(nav[-1] - 1) and r["benchmark"] == pytest.approx(np.prod(1 + np.array(market)) - 1)
        assert r["drawdown"] == pytest.approx((nav / np.maximum.accumulate(nav) - 1).min())
    with pytest.raises(ValueError, match="without benchmark"):
        annual.run_periods(df, periods, lambda some: some.groupBy("period").agg(F.lit(1.0).alias("return")))
    late = periods.withColumn("end_date", F.when(F.col("part") == "train", F.date_add("end_date", 400)).otherwise(F.col("end_date")))
    with pytest.raises(ValueError, match="before an earlier part"):
        annual.run_periods(df, late, lambda some: some)


def test_daily_batch_rebuilds_only_stale_codes(spark):
    pdf = panel(12, 230, seed=2)
    bars = spark.createDataFrame(pdf)
    last = max(pdf["date"])
    features = ts.build_factors(bars, ts.SCORING_FACTORS, keep=["open", "close"])
    stored = features.filter((F.col("code") != "000003") & ~((F.col("code") == "000005") & (F.col("date") == F.lit(last))))
    universe = spark.createDataFrame([(f"{i:06d}", f"I{i % 4}") for i in range(12)], "code string, industry string")
    bench = bars.groupBy("date").agg(F.avg("close").alias("close"))
    line = spark.createDataFrame([(0.0, 0.1)], "intercept double, slope double")
    out = daily.daily_run(bars, stored, universe, bench, WEIGHTS, ts.SCORING_FACTORS, line)
    assert {r["code"] for r in out["stale"].collect()} == {"000003", "000005"}
    held = out["holdings"].toPandas()
    assert 0 < len(held) <= 12 and held["weight"].sum() <= 1 + 1e-9 and set(held["date"]) == {last}
    stages = rows(out["stages"], "seq")
    assert stages["detail"][0] == "built 2 missing or stale feature sets" and len(stages) == 5
    rows_ = [("s", f, 0.1 * k, 0.2 * k, 0.0, 0.3 * k) for k, f in enumerate(WEIGHTS, 1)]
    evidence = spark.createDataFrame(rows_, "strategy string, factor string, ic double, icir double, average_return double, contribution double")
    out = daily.daily_run(bars, stored, universe, bench, WEIGHTS, ts.SCORING_FACTORS, line, evidence=evidence)
    weights = rows(out["weights"], "factor").set_index("factor")
    assert weights["weight"].sum() == pytest.approx(1.0) and weights["weight_change"].abs().max() <= 0.1 + 1e-12
    assert weights.loc["drawdown", "weight_change"] > 0 > weights.loc["momentum_5", "weight_change"]
    last_stage = rows(out["stages"], "seq").iloc[-1]
    assert last_stage["stage"] == "weight-evolution" and last_stage["detail"].startswith("moved=")


def test_stream_state_takes_late_and_missing_bars(spark):
    """Three deliveries with late bars inside and beyond the bound, missing closes and repeated bars."""
    pdf = panel(3, 60, seed=6)[["code", "date", "close"]]
    dates = sorted(pdf["date"].unique())
    pdf["turn"] = pdf["date"].map({d: i // 20 for i, d in enumerate(dates)})
    place = pdf["date"].map({d: i for i, d in enumerate(dates)})
    code = pdf["code"].astype(int)
    pdf.loc[(place % 20 >= 16) & (place < 40) & (code == 1), "turn"] += 1  # within the bound
    pdf.loc[place.isin([3, 25]) & (code == 2), "turn"] += 1  # beyond it
    pdf.loc[place.isin([0, 30]) & (code == 0), "close"] = np.nan
    pdf["seq"] = 1
    again = pdf[(place == 10) & (code == 0)].assign(seq=0, close=1e6)  # an older version of a bar
    beat = pd.DataFrame({"code": [""], "date": [dates[-1] + pd.Timedelta(days=99)], "close": [np.nan], "turn": [3], "seq": [0]})
    full = pd.concat([pdf, again, beat])
    parts = [spark.createDataFrame(p.drop(columns="turn")).withColumn("close", F.when(~F.isnan("close"), F.col("close"))) for _, p in full.groupby("turn")]
    with rocksdb(spark):
        got = rows(sb.emitted(parts, lambda bars: running_state(bars, late="10 days")).filter(F.col("code") != ""), "code", "date")
    want = pdf[~(place.isin([3, 25]) & (code == 2))].sort_values(["code", "date"]).reset_index(drop=True)
    assert got[["code", "date"]].equals(want[["code", "date"]])
    by = want.groupby("code")["close"]
    ema = by.transform(lambda s: s.ewm(span=12, adjust=False, ignore_na=True).mean()).where(by.transform(lambda s: s.notna().cumsum()) >= 12)
    np.testing.assert_allclose(got["ema"].to_numpy(float), ema, rtol=1e-12)
    peak = by.transform(lambda s: s.cummax().ffill())
    np.testing.assert_allclose(got["peak"].to_numpy(float), peak)
    np.testing.assert_allclose(got["drawdown"].to_numpy(float), want["close"] / peak - 1, atol=1e-12)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB


def test_stream_state_of_an_idle_code_goes(spark):
    day = lambda n: (pd.Timestamp("2020-01-01") + pd.Timedelta(days=n)).date()
    kind = "code string, date date, seq int, close double"
    parts = [[("a", day(0), 0, 10.0), ("a", day(1), 0, 5.0)], [("b", day(40), 0, 1.0)], [("b", day(60), 0, 1.0)], [("a", day(61), 0, 4.0), ("b", day(99), 0, 1.0)]]
    with rocksdb(spark):
        got = sb.emitted([spark.createDataFrame(p, kind) for p in parts], lambda bars: running_state(bars, 2, "1 day", keep_days=30))
        peaks = {(r["code"], r["date"]): r["peak"] for r in got.collect()}
    assert peaks[("a", day(1))] == 10.0 and peaks[("a", day(61))] == 4.0


def test_stream_state_is_a_value_a_code(spark, tmp_path):
    """Waiting bars are held as one value, so that a batch does not touch the state bar by bar."""
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame(panel(2, 60, seed=6)[["code", "date", "close"]]).withColumn("seq", F.lit(0)).write.parquet(files)
    stream = sb.file_stream(spark, files, spark.read.parquet(files).schema)
    with rocksdb(spark):
        done = sb.run_available(running_state(stream, late="200 days"), sb.batch_writer(str(tmp_path / "out")), checkpoint=state)
    assert 2 <= done.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 60


def ticks(spark, rows_):
    return spark.createDataFrame([(c, pd.Timestamp(t).to_pydatetime(), s, p, 1.0) for c, t, s, p in rows_], "code string, ts timestamp, seq long, price double, quantity double")


def test_windows_close_and_late_ticks_are_set_aside(spark, tmp_path):
    parts = [
        ticks(spark, [("a", "2021-01-01 10:00", 2, 5.0), ("a", "2021-01-01 10:00", 1, 4.0), ("a", "2021-01-02 01:00", 3, 6.0)]),
        ticks(spark, [("a", "2021-01-01 23:00", 4, 9.0), ("a", "2021-01-03 05:00", 5, 7.0)]),  # one in time: bound 2nd, 23:00 of the 1st
        ticks(spark, [("a", "2021-01-02 02:00", 6, 1.0), ("a", "2021-01-03 06:00", 7, 8.0), ("b", "2021-01-01 00:00", 8, 2.0)]),  # two late
        ticks(spark, [("a", "2021-01-09 00:00", 9, 8.0)]),
    ]
    got = [tuple(r)[0:6] for r in sb.emitted(parts, lambda t: sb.tumbling_bars(t, late="2 hours")).orderBy("start").collect()]
    t = pd.Timestamp
    assert got == [(t("2021-01-01"), "a", 4.0, 9.0, 4.0, 9.0), (t("2021-01-02"), "a", 6.0, 6.0, 6.0, 6.0), (t("2021-01-03"), "a", 7.0, 8.0, 7.0, 8.0)]
    files, state, aside = (str(tmp_path / k) for k in ("in", "state", "aside"))
    sb.deliver(parts, lambda s: sb.run_available(s, sb.late_ticks(aside), checkpoint=state), files)
    late = sb.set_aside(spark, aside, parts[0].schema)
    assert {r["seq"] for r in late.collect()} == {6, 8}


def test_window_state_does_not_grow(spark, tmp_path):
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    held = []
    for day in range(1, 9):
        ticks(spark, [("a", f"2021-01-{day:02d} {h:02d}:00", day * 100 + h, 1.0) for h in range(24)]).write.mode("append").parquet(files)
        stream = sb.file_stream(spark, files, spark.read.parquet(files).schema)
        done = sb.run_available(sb.tumbling_bars(stream), sb.batch_writer(str(tmp_path / "out")), checkpoint=state)
        held.append(done.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 2


def test_ledger_guard_for_good(spark, tmp_path):
    files, state, path = (str(tmp_path / k) for k in ("in", "state", "ledger"))
    at = lambda text: pd.Timestamp(text).to_pydatetime()
    one = spark.createDataFrame([(1, at("2020-01-01"), 5), (1, at("2020-01-01"), 3), (2, at("2020-01-02"), 7)], "id long, ts timestamp, v int")
    year_on = spark.createDataFrame([(1, at("2020-01-01"), 9), (3, at("2021-06-01"), 1), (1, at("2021-06-01"), 2)], one.schema)
    write = sb.first_arrivals(path, ["id"], ["v"])
    sb.deliver([one, year_on, one], lambda s: sb.run_available(s, write, checkpoint=state), files)
    want = {(1, "2020-01-01", 3), (2, "2020-01-02", 7), (3, "2021-06-01", 1), (1, "2021-06-01", 2)}
    keep = lambda: {(r["id"], str(r["ts"].date()), r["v"]) for r in spark.read.parquet(path).collect()}
    assert keep() == want
    write(year_on, 1)  # the batch again, as after a crash
    assert keep() == want


def test_ingest_replays_nothing_after_a_restart(spark, tmp_path):
    bars = spark.createDataFrame(panel(2, 5))
    bars.write.parquet(str(tmp_path / "in"))
    stream = sb.file_stream(spark, str(tmp_path / "in"), bars.schema)
    for _ in range(2):
        sb.ingest(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
    assert sb.ingested(spark, str(tmp_path / "log")).count() == 10
