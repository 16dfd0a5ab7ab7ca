"""Group primitives against pandas, for groups of one slice and of many."""
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import groups as g
from panelmill.operators import cross_section as xs
from panelmill.operators import factor_stats as fs
from panelmill.operators import labels as lb
from tests.helpers import panel, rows, same


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows and one value a third of them."""
    rng = np.random.default_rng(1)
    n = 900
    pdf = pd.DataFrame(
        {
            "date": np.where(np.arange(n) < 700, "2020-01-01", np.where(np.arange(n) % 2, "2020-01-02", "2020-01-03")),
            "code": [f"{i:06d}" for i in range(n)],
            "x": np.where(rng.uniform(size=n) < 0.34, 7.0, rng.normal(size=n).round(2)),
            "y": rng.normal(size=n),
        }
    )
    pdf.loc[rng.uniform(size=n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.withColumn("date", F.col("date").cast("date"))


def test_global_row_number(skewed):
    got = rows(g.with_row_number(skewed, [], [F.col("x").asc_nulls_last(), F.col("code")], "r"), "r")
    assert got["r"].tolist() == list(range(1, 901))
    want = skewed.toPandas().sort_values(["x", "code"], na_position="last")["code"].tolist()
    assert got["code"].tolist() == want


def test_row_number_inside_groups(skewed):
    got = rows(g.with_row_number(skewed, ["date"], [F.col("x").asc_nulls_first(), F.col("code")], "r"), "code")
    want = skewed.toPandas().sort_values(["x", "code"], na_position="first")
    want["r"] = want.groupby("date").cumcount() + 1
    assert got["r"].tolist() == want.sort_values("code")["r"].tolist()


@pytest.mark.parametrize("size", [g.SLICE_ROWS, 200, 23, 1])
def test_ranks_match_pandas_at_any_slice_size(skewed, monkeypatch, size):
    """One slice, several, and slices of a single value, which holds a third of a date."""
    monkeypatch.setattr(g, "SLICE_ROWS", size)
    got = rows(g.with_ranks(skewed, ["date"], {"rx": "x", "ry": "y"}, {"px": "x", "py": "y"}), "code")
    want = skewed.toPandas().sort_values("code").reset_index(drop=True)
    by = want.groupby("date")
    np.testing.assert_allclose(got["rx"].to_numpy(float), by["x"].rank())
    np.testing.assert_allclose(got["ry"].to_numpy(float), by["y"].rank())
    np.testing.assert_allclose(got["px"].to_numpy(float), by["x"].rank(method="first"))
    np.testing.assert_allclose(got["py"].to_numpy(float), by["y"].rank(method="first"))
    assert got.columns.tolist() == ["date", "code", "x", "y", "px", "py", "rx", "ry"]


def test_a_lone_value_meets_no_window(skewed, monkeypatch):
    """Rows of the value that fills slices are spread over salts before any sort."""
    monkeypatch.setattr(g, "SLICE_ROWS", 23)
    plan = g.with_ranks(skewed, ["date"], {"rx": "x"})._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(hash(code" in plan


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantiles_match_pandas(skewed, monkeypatch, accuracy):
    monkeypatch.setattr(g, "ACCURACY", accuracy)
    wanted = {"q": ("x", 0.975), "m": ("x", 0.5), "low": ("y", 0.025), "least": ("y", 0.0), "most": ("y", 1.0)}
    got = rows(g.with_quantiles(skewed, ["date"], wanted), "code")
    by = skewed.toPandas().sort_values("code").reset_index(drop=True).groupby("date")
    for out, (value, q) in wanted.items():
        np.testing.assert_allclose(got[out], by[value].transform(lambda s, q=q: s.quantile(q)), err_msg=out)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("d", "a", None), ("d", "b", None), ("e", "a", 3.0)], "date string, code string, x double")
    got = {r["date"]: r["m"] for r in g.with_quantiles(df, ["date"], {"m": ("x", 0.5)}).collect()}
    assert got == {"d": None, "e": 3.0}
    assert g.with_quantiles(df.limit(0), ["date"], {"m": ("x", 0.5)}).count() == 0
    assert g.with_ranks(df.limit(0), ["date"], {"r": "x"}, {"p": "x"}).count() == 0


def test_group_stats_and_checked_broadcast(spark, skewed, monkeypatch):
    stats = {"m": F.avg("x"), "n": F.count("x")}
    want = skewed.toPandas().groupby("date")["x"]
    for limit, broadcast in ((g.BROADCAST_BYTES, True), (0, False)):
        monkeypatch.setattr(g, "BROADCAST_BYTES", limit)
        df = g.with_group_stats(skewed, ["date"], stats)
        got = rows(df, "code")
        np.testing.assert_allclose(got.groupby("date")["m"].first(), want.mean())
        assert got.groupby("date")["n"].first().tolist() == want.count().tolist()
        assert ("rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()) == broadcast


def test_quantiles_of_extreme_values_by_narrow_passes(spark, monkeypatch):
    """Bins that are few, and brackets of one value, leave the order statistics exact."""
    monkeypatch.setattr(g, "FEW", 1)
    monkeypatch.setattr(g, "BINS", 3)
    most = 1.7976931348623157e308
    values = [-most, -1e300, -7.0, -7.0, 0.0, 5e-324, 1e-320, 2.0, 2.0, 2.0, 2.5, 9.0, 1e17, most]
    cells = [("d", f"{k:02d}", x) for k, x in enumerate(values)] + [("e", "00", float("inf")), ("e", "01", 1.0), ("e", "02", 3.0)]
    df = spark.createDataFrame(cells, "date string, code string, x double")
    places = {f"p{k}": ("x", k / 13) for k in (2, 3, 4, 7, 8, 9, 10, 11, 12)}
    got = {r["date"]: r for r in g.quantile_table(df, ["date"], places | {"m": ("x", 0.5)}).collect()}
    for k in (2, 3, 4, 7, 8, 9, 10, 11, 12):
        np.testing.assert_allclose(got["d"][f"p{k}"], np.quantile(values, k / 13), rtol=1e-9, atol=1e-9)
    assert got["e"]["m"] == 3.0


def test_daily_ic_sorts_once_a_rank(spark):
    """A position and two average ranks are three windows: none has a partition per value."""
    df = lb.forward_return(spark.createDataFrame(panel(6, 12, seed=1)), 2)
    plan = fs.daily_ic(df, ["close", "volume"], "future_return")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3
    assert "factor" not in plan[plan.index("Window [") :]


def test_keep_last_is_not_arbitrary(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, s int, v int")
    assert {r["k"]: r["v"] for r in g.keep_last(df, ["k"], "s").collect()} == {"a": 20, "b": 5}
    assert {r["k"]: r["v"] for r in g.keep_first(df, ["k"], "s").collect()} == {"a": 10, "b": 5}


def test_operators_hold_for_many_slices(spark, monkeypatch):
    """Per-date operators give the same rows whether a date is one slice or many."""
    pdf = panel(15, 30, seed=3)
    pdf.loc[pdf.index % 17 == 0, "volume"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    df = lb.forward_return(df, 5).withColumn("industry", (F.col("code").cast("int") % 3).cast("string"))
    names = ["close", "volume"]

    def results():
        yield rows(xs.process_scores(df, names), "code", "date"), ["close_z", "volume_z"]
        yield rows(xs.winsor_zscore(df, {"a": "close", "b": "volume"}), "code", "date"), ["a", "b"]
        yield rows(xs.rule_score(df, {"close": 0.5, "volume": -0.2}), "code", "date"), ["prediction"]
        yield rows(xs.pct_rank(df, {"a": "volume"}, {"volume": -1}), "code", "date"), ["a"]
        yield rows(xs.neutralize(df.fillna(0.0, ["volume"]), ["volume"], cap="amount"), "code", "date"), ["volume_neutralized"]
        yield rows(fs.daily_ic(df, names, "future_return"), "date", "factor"), ["ic", "rank_ic", "spread", "observations"]
        yield rows(xs.relevance_labels(df, "future_return"), "code", "date"), ["relevance", "group_size"]

    one = list(results())
    monkeypatch.setattr(g, "SLICE_ROWS", 4)
    monkeypatch.setattr(g, "BROADCAST_BYTES", 0)
    for (a, columns), (b, _) in zip(one, results(), strict=True):
        same(a, b, columns)
    assert xs.relevance_contract(xs.relevance_labels(df, "future_return")).count() == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """Jobs in a row held the shuffles of all before them until the driver happened to collect garbage."""
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in str(place.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in f}

    before = files()
    df = spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("x"))
    table = g.durable(df)
    assert sorted(r.k for r in table.collect()) == list(range(7)) and table.schema == df.schema
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    g.discard(table)
    assert not g.path_exists(spark, table.stored_at)
