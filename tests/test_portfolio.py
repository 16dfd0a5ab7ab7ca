"""Targets and returns against literal loops."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import chains as ch
from panelmill.operators import construct as pc
from panelmill.operators import joins as jn
from panelmill.operators import metrics as mt
from panelmill.operators import returns as rt
from panelmill.operators import risk as rk
from tests.helpers import panel, rows


def deal(ranked, n, need):
    """Literal round-robin selection of one date."""
    leaders = ranked[ranked["ir"] == 1].sort_values(["score", "industry"], ascending=[False, True])["industry"].tolist()
    size = ranked.groupby("industry").size()
    chosen = leaders[: min(len(leaders), n, need)]
    for ind in leaders[len(chosen):]:
        if size[chosen].sum() >= n or len(chosen) >= n:
            break
        chosen.append(ind)
    give, left = {i: 1 for i in chosen}, n - len(chosen)
    while left > 0 and any(give[i] < size[i] for i in chosen):
        for i in chosen:
            if give[i] < size[i] and left > 0:
                give[i] += 1
                left -= 1
    share = min(1 / len(chosen), 0.25)
    out = {}
    for i in chosen:
        names = ranked[(ranked["industry"] == i) & (ranked["ir"] <= give[i])]["code"]
        out.update({c: min(share / len(names), 0.10) for c in names})
    return out


def test_industry_neutral_matches_the_loop(spark):
    rng = np.random.default_rng(4)
    frames = []
    for d in range(12):
        m = int(rng.integers(3, 60))
        frames.append(pd.DataFrame({
            "date": pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=d), "code": [f"{i:06d}" for i in range(m)],
            "industry": [f"I{v}" for v in rng.integers(0, rng.integers(1, 22), m)],
            "composite_score": rng.normal(size=m).round(1),
        }))
    pdf = pd.concat(frames, ignore_index=True)
    got = pc.industry_neutral(spark.createDataFrame(pdf), 20).toPandas()
    for date, group in pdf.groupby("date"):
        r = group.rename(columns={"composite_score": "score"}).sort_values(["industry", "score", "code"], ascending=[True, False, True])
        r["ir"] = r.groupby("industry").cumcount() + 1
        want = deal(r, 20, max(5, math.ceil(1 / 0.25)))
        have = got[got["date"] == date].set_index("code")["weight"].to_dict()
        assert have == pytest.approx(want)


def test_allocator_limits(spark):
    rows_ = [("2020-01-01", f"{i:06d}", float(i), None if i % 3 else 0.1 * i, f"I{i % 4}", 0.2, "bull" if i else "bear") for i in range(30)]
    df = spark.createDataFrame(rows_, "date string, code string, score double, model_prediction double, industry string, risk double, regime string")
    held = pc.allocate(df).toPandas()
    assert len(held) == 20 and (held["weight"] <= 0.10 + 1e-12).all()
    assert (held.groupby("industry")["weight"].sum() <= 0.25 + 1e-12).all()
    bear = df.withColumn("regime", F.lit("bear"))
    assert pc.cash_weight(pc.allocate(bear)).first()["cash"] >= 0.60 - 1e-12


@pytest.fixture(scope="module")
def market(spark):
    pdf = panel(8, 60, seed=11, gaps=0.15)
    dates = sorted(pdf["date"].unique())
    rng = np.random.default_rng(8)
    held = []
    for i in range(3, 60, 9):
        codes = rng.choice(8, 5, replace=False)
        w = rng.uniform(0.02, 0.19, 5)
        held += [("s", dates[i], f"{c:06d}", float(x)) for c, x in zip(codes, w)]
    schema = "scenario string, date date, code string, weight double"
    return pdf, dates, held, spark.createDataFrame(pdf), spark.createDataFrame(held, schema)


def literal(pdf, dates, held, exposure_of=lambda curve, date: 1.0, cost=(0.0003, 0.0005, 0.001)):
    """Sell everything at the open, buy the new weights, mark at the (last known) close."""
    c, t, s = cost
    price = {(r.date, r.code): (r.open, r.close) for r in pdf.itertuples()}
    plans = {}
    for _, d, code, w in held:
        plans.setdefault(d, {})[code] = w
    cash, shares, last, curve, costs = 100_000.0, {}, {}, [], 0.0
    for d in dates:
        if d in plans:
            e = exposure_of([v for _, v in curve], d)
            for code, n in shares.items():
                o = price[(d, code)][0] if (d, code) in price else last[code]
                cash += n * o * (1 - s) * (1 - c - t)
                costs += n * o * (1 - (1 - s) * (1 - c - t))
            shares, base = {}, cash
            for code, w in plans[d].items():
                if (d, code) in price:
                    o = price[(d, code)][0]
                    shares[code] = base * w * e / (1 + c) / (o * (1 + s))
                    cash -= base * w * e
                    costs += base * w * e - shares[code] * o
        for code in [f"{i:06d}" for i in range(8)]:
            if (d, code) in price:
                last[code] = price[(d, code)][1]
        curve.append((d, cash + sum(n * last[k] for k, n in shares.items())))
    return curve, costs


def test_equity_equals_the_loop(market):
    pdf, dates, held, prices, holdings = market
    got = rows(rt.equity_curve(holdings, prices, from_start=True), "date")
    want, costs = literal(pdf, dates, held)
    np.testing.assert_allclose(got["equity"], [v for _, v in want], rtol=1e-11)
    paid = rt.trading_costs(holdings, prices).agg(F.sum(F.col("buy_cost") + F.col("sell_cost"))).first()[0]
    assert paid == pytest.approx(costs, rel=1e-9)


def test_controlled_equity_equals_the_loop(spark, market):
    pdf, dates, held, prices, holdings = market
    known = [(d, 0.9) for d in sorted({h[1] for h in held})]

    def feedback(curve, date):
        x = np.asarray(curve)
        r = (x[1:] / x[:-1] - 1)[-20:]
        v = r.std() * np.sqrt(252) if len(r) >= 2 else 0.0
        scale = min(1.0, 0.05 / v) if v > 0 else 1.0
        dd = x[-1] / x.max() - 1
        return 0.9 * scale * (0.5 if dd <= -0.02 else 0.7 if dd <= -0.005 else 1.0)

    exposures = spark.createDataFrame(known, "entry_date date, base_exposure double")
    got = rows(rt.controlled_equity(holdings, prices, exposures, 0.05, 20, ((0.02, 0.5), (0.005, 0.7)), from_start=True), "date")
    want, _ = literal(pdf, dates, held, feedback)
    np.testing.assert_allclose(got["equity"], [v for _, v in want], rtol=1e-11)


def test_deferred_rebalances(market):
    pdf, dates, held, prices, holdings = market
    got = sorted({r["date"] for r in rt.executed_baskets(holdings, prices).select("date").distinct().collect()})
    opened = {(r.date, r.code) for r in pdf.itertuples()}
    plans, current, want = {}, None, []
    for _, d, code, _w in held:
        plans.setdefault(d, []).append(code)
    for d in sorted(plans):
        if current is None or all((d, code) in opened for code in current):
            current = [code for code in plans[d] if (d, code) in opened]
            want.append(d)
    assert got == want


def test_turnover(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "a", 0.5), ("2020-01-01", "b", 0.5), ("2020-01-08", "b", 0.4), ("2020-01-08", "c", 0.6)],
        "date string, code string, weight double")
    assert rows(pc.turnover(df), "date")["turnover"].tolist() == pytest.approx([0.5, 0.6])


def test_known_drawdown_and_worst_hold(spark):
    curve = spark.createDataFrame(
        [("s", d, v) for d, v in zip(pd.date_range("2024-01-01", periods=5).date, [100e3, 110e3, 95e3, 90e3, 112e3])],
        "scenario string, date date, equity double")
    dd = mt.drawdown_periods(curve, keys=("scenario",)).toPandas()
    assert len(dd) == 1 and dd["drawdown"][0] == pytest.approx(90 / 110 - 1) and dd["duration_days"][0] == 3
    worst = mt.worst_holding_periods(curve, bars=2, limit=1).first()
    assert worst["return"] == pytest.approx(90 / 110 - 1)


def test_metrics_match_pandas(spark):
    rng = np.random.default_rng(0)
    eq = 1e5 * np.cumprod(1 + rng.normal(0, 0.01, 50))
    bench = 1e3 * np.cumprod(1 + rng.normal(0, 0.01, 50))
    dates = pd.date_range("2024-01-01", periods=50).date
    curve = spark.createDataFrame([("s", d, float(v)) for d, v in zip(dates, eq)], "scenario string, date date, equity double")
    index = spark.createDataFrame([(d, float(v)) for d, v in zip(dates, bench)], "date date, benchmark double")
    m = mt.full_metrics(curve, index).first()
    r, b = pd.Series(eq).pct_change().dropna(), pd.Series(bench).pct_change().dropna()
    assert m["annual_return"] == pytest.approx((eq[-1] / eq[0]) ** (252 / 49) - 1)
    assert m["sharpe"] == pytest.approx(r.mean() / r.std(ddof=0) * math.sqrt(252))
    beta = r.cov(b, ddof=0) / b.var(ddof=0)
    assert m["beta"] == pytest.approx(beta) and m["alpha"] == pytest.approx((r - beta * b).mean() * 252)
    assert m["win_rate"] == pytest.approx((r > 0).mean())


def test_regime_growth_and_swings(spark):
    up = [(d, 100 * 1.001**i) for i, d in enumerate(pd.bdate_range("2023-01-02", periods=220).date)]
    bench = spark.createDataFrame(up, "date date, close double")
    breadth = spark.createDataFrame([(up[0][0], 0.8)], "date date, breadth double")
    last = rk.market_regime(bench, breadth).orderBy(F.desc("date")).first()
    assert (last["state"], last["exposure"]) == ("bull", 1.0)
    swing = spark.createDataFrame([(d, 100.0 if i % 2 else 108.0) for i, (d, _) in enumerate(up)], "date date, close double")
    assert rk.market_regime(swing).orderBy(F.desc("date")).first()["state"] == "high_volatility"
    assert rk.moving_average_regime(bench).orderBy(F.desc("date")).first()["state"] == "Bull"
    assert rk.moving_average_regime(bench).orderBy("date").first()["state"] == "Neutral"


def test_asof_takes_the_whole_row_and_respects_ties(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2)], "code string, t int")
    right = spark.createDataFrame([("a", 2, 1.0, None), ("a", 1, 5.0, 6.0)], "code string, u int, x double, y double")
    got = rows(jn.asof_join(left, right, ["code"], "t", "u", ["x", "y"]), "code", "t")
    assert got["x"].fillna(-1).tolist() == [5.0, 1.0, 1.0, -1.0]
    assert got["y"].fillna(-1).tolist() == [6.0, -1.0, -1.0, -1.0]
    strict = rows(jn.asof_join(left, right, ["code"], "t", "u", ["x"], strict=True), "code", "t")
    assert strict["x"].fillna(-1).tolist() == [-1.0, 5.0, 1.0, -1.0]


def test_execution_costs(spark):
    df = spark.createDataFrame([("buy", 10.0, 1e6, 250.0), ("sell", 10.0, 1e7, 99.0)], "side string, open double, amount double, quantity double")
    a, b = pc.execution_costs(df).collect()
    assert (a["slippage"], a["filled"], a["commission"], a["tax"]) == (0.002, 200, 5.0, 0.0)
    assert (b["slippage"], b["filled"], b["commission"]) == (0.001, 0, 0.0)
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-07",), ("2024-01-08",)], "d string").select(
        pc.next_business_day(F.col("d").cast("date")).cast("string").alias("n"))
    assert [r["n"] for r in days.collect()] == ["2024-01-08", "2024-01-08", "2024-01-08", "2024-01-09"]


def test_chains_by_pointer_jumping(spark):
    rng = np.random.default_rng(4)
    links, want = [], set()
    for key in ("a", "b", "c"):
        after = {p: int(rng.integers(p + 1, p + 9)) if rng.uniform() < 0.97 else None for p in range(1, 200)}
        links += [(key, p, q) for p, q in after.items()]
        here = 1
        while here in after:
            want.add((key, here))
            here = after[here]
    links += [("one", 7, None), ("gone", 3, 400)]
    want |= {("one", 7), ("gone", 3)}
    df = spark.createDataFrame(links, "k string, p long, q long")
    assert {tuple(r) for r in ch.on_chain(df, ["k"], "p", "q").collect()} == want
    assert ch.on_chain(df.limit(0), ["k"], "p", "q").count() == 0


def test_first_position_in_blocks(spark):
    rows_ = [("a", 5), ("a", 40_000), ("b", 32_767), ("b", 32_768), ("c", 0)]
    bits = ch.positions_bitmap(spark.createDataFrame(rows_, "k string, at long"), ["k"], "at")

    def first(key, low):
        found = bits.filter(F.col("k") == key).select(ch.first_position(F.col("_bits"), F.col("_block"), F.lit(low), F.lit(50_000)).alias("at"))
        return found.agg(F.min("at")).first()[0]

    assert [first("a", 0), first("a", 6), first("a", 40_001), first("b", 32_768), first("b", 1), first("c", 0), first("c", 1)] == [
        5, 40_000, None, 32_768, 32_767, 0, None]


@pytest.mark.parametrize("seed", range(4))
def test_deferral_with_many_gaps(spark, seed):
    """Baskets of up to four names that trade on seven days in ten; some buy nothing."""
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2021-01-04", periods=60).date
    codes = [f"{i:06d}" for i in range(12)]
    opens = {(d, c): float(rng.choice([0.0, 10.0], p=[0.1, 0.9])) for d in dates for c in codes if rng.uniform() < 0.75}
    held = [(s, d, str(c), float(w)) for s in ("x", "y") for d in dates[::2] for c in rng.choice(codes, rng.integers(1, 5), replace=False)
            for w in [rng.choice([0.0, 0.2, 0.3])]]
    holdings = spark.createDataFrame(held, "scenario string, date date, code string, weight double")
    prices = spark.createDataFrame([(c, d, o) for (d, c), o in opens.items()], "code string, date date, open double")
    got = {(r["scenario"], r["date"]) for r in rt.executed_baskets(holdings, prices).collect()}
    want = set()
    for s in ("x", "y"):
        current = []
        for d in dates[::2]:
            if all(opens.get((d, c), 0.0) > 0 for c in current):
                current = [c for k, e, c, w in held if k == s and e == d and w > 0 and opens.get((d, c), 0.0) > 0]
                want.add((s, d))
    assert got == want


def test_deferral_plan_has_no_pairs(spark, market):
    _, _, _, prices, holdings = market
    text = rt.successors(holdings, prices)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("NestedLoop", "Cartesian", "FlatMapGroups", "ArrowEvalPython"))


def test_left_unique_of_one_value_ranks_nothing(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", 4.0), ("d", 5.0)], "k string, x double")
    right = spark.createDataFrame(
        [("a", 10.0, 1), ("a", 20.0, 2), ("a", 30.0, None), ("b", None, 9), ("b", 7.0, 8), ("c", 6.0, None)], "k string, v double, seq int"
    )
    got = jn.left_unique(left, right, ["k"], "seq")
    assert got.columns == ["k", "x", "v", "seq"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == [
        ("a", 1.0, 20.0, 2), ("a", 2.0, 20.0, 2), ("b", 3.0, None, 9), ("c", 4.0, 6.0, None), ("d", 5.0, None, None)
    ]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    two = jn.left_unique(left, right.withColumn("w", F.col("v") * 2), ["k"], "seq").filter("k = 'a'").first()
    assert (two["v"], two["w"]) == (20.0, 40.0)
