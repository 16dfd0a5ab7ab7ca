"""Sources, contracts and validation rules."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions.columns import two_decimals
from panelmill.operators import quality as dq
from panelmill.sources import landing, market, store
from tests.helpers import panel, rows


def clean_bars(n=501):
    dates = pd.bdate_range("2020-01-01", periods=n)
    return pd.DataFrame({"code": "000001", "seq": range(n), "date": dates.date, "open": 10.0, "high": 11.0, "low": 9.0, "close": 10.0, "volume": 100.0})


def errors(spark, pdf, **kw):
    df = spark.createDataFrame(pdf)
    fixed = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    return dq.validate_bars(fixed, **kw).first()["errors"]


def test_clean_history_has_no_errors(spark):
    assert errors(spark, clean_bars()) == []


@pytest.mark.parametrize("change, message", [
    (lambda p: p.iloc[:500], "only 500 rows; at least 501 trading days required"),
    (lambda p: p.assign(close=p["close"].where(p.index >= 31)), "close missing rate 6.19% exceeds 5.00%"),
    (lambda p: p.assign(date=p["date"].iloc[::-1].to_numpy()), "dates are not in ascending order"),
    (lambda p: p.assign(date=[p["date"][0]] * 2 + list(p["date"][2:])), "dates contain duplicates"),
    (lambda p: p.assign(date=[None] + list(p["date"][1:])), "date contains null or invalid values"),
    (lambda p: p.assign(volume=p["volume"].where(~p.index.isin(range(10, 15)), 0.0)), "suspended trading detected: 5 consecutive zero-volume days"),
    (lambda p: p.assign(high=p["high"].where(p.index != 4, 9.5)), "high is below open or close"),
    (lambda p: p.assign(low=p["low"].where(p.index != 4, 10.5)), "low is above open or close"),
    (lambda p: p.assign(open=p["open"].where(p.index != 4)), "open, high, or low contains null or non-numeric values"),
    (lambda p: p.assign(volume=p["volume"].where(p.index != 4)), "volume contains null or non-numeric values"),
])
def test_each_rule_is_named(spark, change, message):
    assert message in errors(spark, change(clean_bars()))


def test_missing_rate_rounds_ties_as_printf(spark):
    pdf = clean_bars(512)
    assert "close missing rate 3.12% exceeds 1.00%" in errors(spark, pdf.assign(close=pdf["close"].where(pdf.index >= 16)), max_missing=0.01)
    values = [k * 100.0 / n for n in (7, 32, 64, 320, 800, 4000, 20_000) for k in range(0, n + 1, max(1, n // 320))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['v']:.2f}" for r in got]


def test_null_breaks_a_suspension(spark):
    pdf = clean_bars()
    pdf.loc[10:14, "volume"] = 0.0
    pdf.loc[12, "volume"] = float("nan")
    assert not [e for e in errors(spark, pdf) if e.startswith("suspended")]


def test_one_file_per_code(spark, tmp_path):
    pdf = panel(3, 5)
    for code, g in pdf.groupby("code"):
        g.drop(columns="code").to_parquet(tmp_path / f"{code}.parquet")
    pdf.drop(columns="code").head(2).to_parquet(tmp_path / "index.parquet")
    got = store.read_bars(spark, str(tmp_path))
    assert got.count() == len(pdf) and {r["code"] for r in got.select("code").distinct().collect()} == set(pdf["code"])


def test_component_lists_in_both_encodings(spark, tmp_path):
    text = "成分券代码,成分券名称,所属行业\nsz000001,平安,银行\n600000.0,浦发,\n"
    for encoding in ("utf-8-sig", "gb18030"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        got = rows(landing.components(landing.read_lists(spark, str(path)), "HS300"), "code")
        assert got["code"].tolist() == ["000001", "600000"] and got["name"].tolist() == ["平安", "浦发"]
        assert got["market"].tolist() == ["SZ", "SH"] and got["sector"].tolist() == ["银行", "Unknown"]
    bad = spark.createDataFrame([("x", "")], "code string, name string")
    assert landing.incomplete_components(landing.components(bad, "HS300")).count() == 1


def test_lists_of_both_encodings_in_one_folder(spark, tmp_path):
    """The first foreign byte stands in the last of many lines; headers differ by file."""
    many = "".join(f"{i:06d},n{i}\n" for i in range(1, 3001))
    (tmp_path / "a.csv").write_bytes(("\ufeffcode,name\n" + many + "003001,末\n").encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(("name, Symbol \r\n" + "".join(f"n{i},{i:06d}\r\n" for i in range(5000, 8000)) + '"末, 二",008000\r\n').encode("gb18030"))
    (tmp_path / "c.csv").write_bytes("code,name\n000001,x\n,y\n000003,\n".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    lists = landing.components(landing.read_lists(spark, str(tmp_path)), "X")
    good, rejected = landing.accepted_lists(lists)
    got = {r["code"]: r["name"] for r in good.collect()}
    assert len(got) == 6002 and got["003001"] == "末" and got["008000"] == "末, 二" and got["005000"] == "n5000"
    assert [(r["file"].rsplit("/", 1)[1], r["bad"], r["rows"]) for r in rejected.collect()] == [("c.csv", 2, 3)]


def test_headers_are_searched():
    columns = ["\ufeffStock Code", "name", "CSRC Industry", "Industry"]
    assert landing.find_header(columns, ("code", "symbol")) == columns[0]
    assert landing.find_header(columns, ("industry",)) == "Industry"
    assert landing.find_header(columns, ("none",), 1) == "name"
    with pytest.raises(ValueError):
        landing.find_header(columns, ("none",), 9)


def test_touched_partitions_alone_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "date date, symbol string, v int, seq int"
    day = lambda m, d: pd.Timestamp(2020, m, d).date()
    month = F.trunc("date", "month")
    put = lambda rows_: store.upsert_table(spark, path, spark.createDataFrame(rows_, kind), ["date", "symbol"], ["seq"], "month", month)
    files = lambda: {(str(r["month"]), r["f"]) for r in spark.read.parquet(path).select("month", F.input_file_name().alias("f")).collect()}
    put([(day(1, 1), "a", 1, 0), (day(2, 1), "a", 2, 0), (day(3, 1), "a", 3, 0)])
    before = files()
    for _ in range(2):  # again, as after a crash
        put([(day(2, 1), "a", 9, 1), (day(2, 1), "a", 5, 0), (day(2, 3), "b", 7, 0), (day(4, 1), "a", 4, 0)])
        got = {(str(r["date"]), r["symbol"]): r["v"] for r in spark.read.parquet(path).collect()}
        assert got == {("2020-01-01", "a"): 1, ("2020-02-01", "a"): 9, ("2020-02-03", "b"): 7, ("2020-03-01", "a"): 3, ("2020-04-01", "a"): 4}
    after = files()
    assert {f for f in before if f[0] != "2020-02-01"} <= after and not {f for f in before if f[0] == "2020-02-01"} & after


def test_price_payload(spark):
    long = '["2024-01-03","10","11","12","9","100","a","b","5000","c","0.7"]'
    short = '["2024-01-02","10","10.5","11","9","200"]'
    text = 'kline_x={"code":0,"data":{"sz000001":{"qfqday":[' + long + "," + short + ',["2024-01-04","1"]]}}};'
    failed = '{"code":1,"msg":"no","data":{}}'
    df = spark.createDataFrame([("000001", text), ("000002", failed)], "code string, payload string")
    got = rows(landing.kline_bars(df), "date")
    assert got["close"].tolist() == [10.5, 11.0] and got["amount"].tolist() == [2100.0, 5000.0]
    assert got["turnover"].tolist() == [0.0, 0.7] and got["low"].tolist() == [9.0, 9.0]


def test_universe_forms(spark):
    flat = [{"code": "1", "name": "a", "sector": "Tech", "index_source": ["HS300", "CSI500"]}, {"code": "600001", "index_source": "HS300|ChiNext"}]
    got = rows(landing.universe_rows(spark, flat), "code")
    assert got["code"].tolist() == ["000001", "600001"] and got["market"].tolist() == ["SZ", "SH"]
    assert [list(x) for x in got["index_source"]] == [["HS300", "CSI500"], ["HS300", "ChiNext"]]
    grouped = landing.universe_rows(spark, {"Energy": [{"code": "2"}]}).first()
    assert grouped["sector"] == "Energy"


def test_codes_are_never_truncated(spark):
    got = spark.createDataFrame([(7,), (1234567,)], "k bigint").select(market.pad_code("k").alias("c")).collect()
    assert [r["c"] for r in got] == ["000007", "1234567"]


def test_sector_keywords(spark):
    df = spark.createDataFrame([("白酒",), ("半导体设备",), ("Oil services",), ("别的",)], "t string")
    assert [r["s"] for r in df.select(dq.sector_of("t").alias("s")).collect()] == ["Consumer", "Technology", "Energy", "Other"]


def test_contracts(spark):
    with pytest.raises(ValueError, match="no column roe"):
        store.check_contract(spark.range(1), ["id", "roe"])
    df = spark.createDataFrame([("x", "2024-13-01")], "n string, d string")
    assert dq.coerce(df, ["n"], ["d"]).first() == (None, None)
    with pytest.raises(Exception):
        dq.coerce(df, ["n"], strict=True).collect()


def test_merge_is_idempotent(spark):
    bars = spark.createDataFrame(panel(2, 4)).drop("turnover")
    again = store.merge_bars(store.merge_bars(bars, bars), bars)
    assert again.count() == 8 and again.exceptAll(bars).count() == 0


def test_bars_use_only_hash_aggregates(spark, small):
    plan = market.bars(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
