"""Rolling factors against pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import timeseries as ts
from panelmill.sources import market
from tests.helpers import panel, rows


@pytest.fixture(scope="module")
def built(spark):
    pdf = panel(3, 140, seed=5)
    bench = pd.DataFrame({"date": sorted(pdf["date"].unique())})
    bench["close"] = 1000 * np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.01, len(bench))))
    names = [n for n in ts.FACTORS]
    got = rows(ts.build_factors(spark.createDataFrame(pdf), names, spark.createDataFrame(bench)), "code", "date")
    return pdf.sort_values(["code", "date"]).reset_index(drop=True), bench, got


def by_code(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.groupby("code")]).sort_index().to_numpy()


def check(got, want):
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_price_factors(built):
    pdf, _, got = built
    check(got["momentum_20"], by_code(pdf, lambda g: g["close"].pct_change(20, fill_method=None)))
    check(got["trend_60"], by_code(pdf, lambda g: g["close"] / g["close"].rolling(60).mean() - 1))
    check(got["volatility_20"], by_code(pdf, lambda g: g["close"].pct_change().rolling(20).std()))
    check(got["drawdown_60"], by_code(pdf, lambda g: g["close"] / g["close"].rolling(60).max() - 1))
    check(got["liquidity_20"], by_code(pdf, lambda g: g["amount"].rolling(20).mean()))
    check(got["volume_ratio_20"], by_code(pdf, lambda g: g["volume"] / g["volume"].rolling(20).mean()))


def test_oscillators(built):
    pdf, _, got = built

    def rsi(g):
        r = g["close"].pct_change()
        gain, loss = r.clip(lower=0).rolling(14).mean(), (-r).clip(lower=0).rolling(14).mean()
        return (100 - 100 / (1 + gain / loss)).where(loss != 0, 100.0).where(gain.notna())

    check(got["rsi_14"], by_code(pdf, rsi))

    def boll(g):
        m, s = g["close"].rolling(20).mean(), g["close"].rolling(20).std(ddof=0)
        return (g["close"] - (m - 2 * s)) / (4 * s)

    check(got["bollinger_position"], by_code(pdf, boll))

    def atr(g):
        p = g["close"].shift()
        tr = pd.concat([g["high"] - g["low"], (g["high"] - p).abs(), (g["low"] - p).abs()], axis=1).max(axis=1)
        return tr.rolling(14).mean()

    check(got["atr_14"], by_code(pdf, atr))


def test_beta(built):
    pdf, bench, got = built
    market = bench.set_index("date")["close"].pct_change()

    def beta(g):
        r, m = g["close"].pct_change(), g["date"].map(market)
        m.index = g.index
        return r.rolling(60).cov(m, ddof=0) / m.rolling(60).var(ddof=0)

    check(got["beta_60"], by_code(pdf, beta))


def test_macd(built):
    pdf, _, got = built

    def macd(g):
        e = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
        line = e(g["close"], 12) - e(g["close"], 26)
        return pd.DataFrame({"m": line, "s": e(line, 9)})

    want = pd.concat([macd(g) for _, g in pdf.groupby("code")]).sort_index()
    check(got["macd"], want["m"].to_numpy())
    check(got["macd_signal"], want["s"].to_numpy())


def test_ema_crosses_blocks(spark):
    pdf = panel(2, 1700, seed=9)[["code", "date", "close"]]
    df = ts.ema(spark.createDataFrame(pdf), "close", 26, "e")
    got = rows(df, "code", "date")
    want = by_code(pdf.sort_values(["code", "date"]).reset_index(drop=True),
                   lambda g: g["close"].ewm(span=26, adjust=False, min_periods=26).mean())
    check(got["e"], want)


def test_flat_prices_give_no_band(spark):
    pdf = panel(1, 30)
    pdf["close"] = 10.0
    got = ts.build_factors(spark.createDataFrame(pdf), ["bollinger_position", "rsi_14"]).toPandas()
    assert got["bollinger_position"].isna().all()
    assert got["rsi_14"].dropna().eq(100.0).all()


def test_no_future_leaks_into_factors(spark):
    pdf = panel(4, 80, seed=7)
    cut = sorted(pdf["date"].unique())[60]
    changed = pdf.copy()
    later = changed["date"] > cut
    changed.loc[later, ["open", "high", "low", "close", "volume", "amount", "turnover"]] *= 3
    names = [n for n in ts.FACTORS if not n.startswith("beta")]
    a, b = (rows(ts.build_factors(spark.createDataFrame(p), names).filter(F.col("date") <= F.lit(cut)), "code", "date")
            for p in (pdf, changed))
    pd.testing.assert_frame_equal(a, b)


def test_register_factor(spark):
    ts.register_factor("double_close", lambda: F.col("close") * 2)
    pdf = panel(1, 5)
    got = rows(ts.build_factors(spark.createDataFrame(pdf), ["double_close"]), "date")
    np.testing.assert_allclose(got["double_close"], pdf["close"] * 2)
    with pytest.raises(ValueError, match="unknown factor"):
        ts.build_factors(spark.createDataFrame(pdf), ["nope"])


def test_bad_values_leave_with_their_window(spark):
    """NaN, infinities, gaps and extremes against windows taken literally, one by one."""
    rng = np.random.default_rng(11)
    pdf = panel(4, 200, seed=11)
    for column, bad in (("close", [np.nan, np.inf, 1e13]), ("amount", [np.inf, -np.inf, 1e17]), ("volume", [np.nan, 0.0, 1e15]), ("turnover", [np.nan])):
        at = rng.choice(len(pdf), 6, replace=False)
        pdf.loc[at, column] = rng.choice(bad, 6)
    bench = pd.DataFrame({"date": sorted(pdf["date"].unique())})
    bench["close"] = 1000 * np.exp(np.cumsum(rng.normal(0, 0.01, len(bench))))
    names = ["trend_20", "trend_60", "trend_120", "volatility_20", "volatility_60", "liquidity_20", "volume_ratio_20", "turnover_5", "turnover_20", "beta_60"]
    got = rows(ts.build_factors(spark.createDataFrame(pdf), names, spark.createDataFrame(bench)), "code", "date")
    pdf = pdf.sort_values(["code", "date"]).reset_index(drop=True).replace([np.inf, -np.inf], np.nan)
    market = dict(zip(bench["date"], bench["close"].pct_change(), strict=True))

    def literal(x, n, fn):
        return np.array([fn(x[i - n + 1 : i + 1]) if i >= n - 1 and not np.isnan(x[i - n + 1 : i + 1]).any() else np.nan for i in range(len(x))])

    for code, g in pdf.groupby("code"):
        mine = got[got["code"] == code]
        x = {c: g[c].to_numpy() for c in ("close", "amount", "volume", "turnover")}
        ret = np.concatenate(([np.nan], x["close"][1:] / x["close"][:-1] - 1))
        want = {f"trend_{n}": x["close"] / literal(x["close"], n, np.mean) - 1 for n in (20, 60, 120)}
        want |= {f"volatility_{n}": literal(ret, n, lambda w: w.std(ddof=1)) for n in (20, 60)}
        want |= {f"turnover_{n}": literal(x["turnover"], n, np.mean) for n in (5, 20)}
        want["liquidity_20"] = literal(x["amount"], 20, np.mean)
        want["volume_ratio_20"] = x["volume"] / literal(x["volume"], 20, np.mean)
        m = np.array([market[d] for d in g["date"]])
        pair = np.where(np.isnan(ret) | np.isnan(m), np.nan, np.arange(len(ret), dtype=float))
        want["beta_60"] = literal(pair, 60, lambda w: np.cov(ret[w.astype(int)], m[w.astype(int)], ddof=0)[0, 1] / m[w.astype(int)].var())
        for name, values in want.items():
            np.testing.assert_allclose(mine[name].to_numpy(float), values, rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=f"{code} {name}")
    assert got["trend_120"].notna().any() and got["beta_60"].notna().any()


def test_trades_keep_a_full_order(spark):
    """Orders and parts beyond the old widths; a line without quantity is no trade."""
    day = "2021-03-02 00:00:00"
    lines = [(1, 2**40 + 1, 1, 5, 10.0, 1000.0, day), (1, 2**40, 7, 2**33, 10.0, 2000.0, day), (1, 2**40, 7, 2**33 + 131072, 10.0, 3000.0, day),
             (1, 1, 1, 1, 0.0, 9.0, day), (1, 0, 1, 1, 10.0, 4000.0, "2021-03-02 10:00:00"), (2, 1, 1, 1, 0.0, 9.0, day)]
    df = spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate string")
    got = {r["supplier"]: r for r in market.bars_from_trades(market.trades_of(df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))), "supplier").collect()}
    assert (got[1]["open"], got[1]["close"], got[1]["volume"]) == (100.2, 100.4, 40.0)
    assert (got[2]["open"], got[2]["volume"], got[2]["amount"]) == (None, 0.0, 9.0)
    plan = market.bars_from_trades(market.trades_of(df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))), "supplier")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
