"""Scans, sinks and data quality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.groups import keep_last, new_path
from ..operators import cross_section as xs
from ..operators import quality as dq
from ..operators import timeseries as ts
from ..sources import landing, market, store
from .kit import H, ask, code_of, cte, full, query

QUERIES: dict = {}
SQL: dict = {}
_OHLC = "r:open r:high r:low r:close r:volume r:amount r:turnover"


def _scratch(spark) -> str:
    return new_path(spark)


@query(QUERIES, "panel_store_round_trip")
def panel_store_round_trip(spark, sf_dir):
    """Bars written by year and read back for three years only."""
    path = _scratch(spark)
    store.write_panel(market.bars(spark, sf_dir), path)
    return store.read_panel(spark, path, [1996, 1997, 1998])


SQL["panel_store_round_trip"] = ask(
    "bars", "SELECT * FROM bars WHERE year(date) IN (1996, 1997, 1998)", f"code date {_OHLC}"
)


@query(QUERIES, "benchmark_by_code")
def benchmark_by_code(spark, sf_dir):
    return store.read_benchmark(market.benchmarks(spark, sf_dir), "2-HIGH")


SQL["benchmark_by_code"] = ask("benches", "SELECT date, close FROM benches WHERE index_code = '2-HIGH'", "date r:close")


@query(QUERIES, "component_csv_scan")
def component_csv_scan(spark, sf_dir):
    """Five lists of suppliers under two sets of headers, with suffixed codes. Two are in another
    encoding, first seen in their last line; one has a member without a name and is rejected."""
    members = market.universe(spark, sf_dir).withColumn("part", F.col("code").cast("long") % 5)
    last = members.groupBy("part").agg(F.max("code").alias("last"))
    members = members.join(last, "part")
    name = F.when(F.col("code") != F.col("last"), F.col("name")).when(F.col("part") == 4, "").when(F.col("part") >= 2, F.concat(F.lit("华"), "name"))
    line = F.concat_ws(",", F.concat(F.lit("SZ"), "code"), F.coalesce(name, F.col("name")), "industry")
    path = _scratch(spark)
    for k in range(5):
        head, encoding = ("code,name,industry", "gb18030") if k in (2, 3) else ("证券代码,证券简称,行业", "utf-8")
        lines = members.filter(F.col("part") == k).repartitionByRange("code").sortWithinPartitions("code").select(line.alias("line"))
        lines.mapInArrow(_encoded(head, encoding), "value binary").select(F.col("value").cast("string")).write.text(f"{path}/list={k}")
    lists = landing.components(landing.read_lists(spark, path), "HS300")
    whole = lists.withColumn("file", F.regexp_extract("file", r"list=(\d+)", 1))
    return landing.accepted_lists(whole)[0].drop("file")


def _encoded(head, encoding):
    """Lines as bytes of an encoding, under a header in every file."""
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head.encode(encoding)])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.encode(encoding) for t in batch.column("line").to_pylist()], pa.binary())], ["value"])

    return run


_MARKET = "CASE WHEN substr(code, 1, 1) IN ('5', '6', '9') THEN 'SH' WHEN substr(code, 1, 1) IN ('4', '8') THEN 'BJ' ELSE 'SZ' END"
SQL["component_csv_scan"] = ask(
    "universe",
    f"""SELECT code, CASE WHEN part IN (2, 3) AND row_number() OVER (PARTITION BY part ORDER BY code DESC) = 1 THEN '华' || name ELSE name END AS name,
          'HS300' AS index_source, {_MARKET} AS market, industry AS sector
        FROM (SELECT *, CAST(code AS BIGINT) % 5 AS part FROM universe) WHERE part <> 4""",
    "code name index_source market sector",
)


@query(QUERIES, "industry_snapshot_scan")
def industry_snapshot_scan(spark, sf_dir):
    """Snapshot with other headers, blank sectors and industries, and codes that come again."""
    members = market.universe(spark, sf_dir)
    key = F.col("code").cast("long") % 7
    path = _scratch(spark)
    rows = members.select(
        F.concat("code", F.when(key == 1, ".0").otherwise("")).alias("Stock Code"),
        F.when(key == 2, " ").otherwise(F.col("sector")).alias("sector"),
        F.when(key == 3, "").otherwise(F.col("industry")).alias("CSRC Industry"),
        F.lit(1).alias("version"),
    )
    again = members.filter(key >= 5).select(
        F.col("code").alias("Stock Code"), F.when(key == 6, "nan").otherwise(F.lit("Revised")).alias("sector"),
        F.col("industry").alias("CSRC Industry"), F.lit(2).alias("version"),
    )
    rows.unionByName(again).write.option("header", True).csv(path)
    df = spark.read.csv(path, header=True)
    return landing.industry_snapshot(df.withColumn("version", F.col("version").cast("int")), "version")


SQL["industry_snapshot_scan"] = ask(
    "universe",
    """SELECT code, CASE WHEN CAST(code AS BIGINT) % 7 = 5 THEN 'Revised' ELSE sector END AS sector,
         CASE WHEN CAST(code AS BIGINT) % 7 = 3 THEN 'Unknown' ELSE industry END AS industry
       FROM universe WHERE CAST(code AS BIGINT) % 7 <> 2""",
    "code sector industry",
)


@query(QUERIES, "kline_payload_scan")
def kline_payload_scan(spark, sf_dir):
    """Price payloads, one text per code as a feed delivers them, parsed back to bars."""
    bars = market.bars(spark, sf_dir)
    row = F.array(*[F.col(c).cast("string") for c in ("date", "open", "close", "high", "low", "volume")])
    # A code has one row per session, so its payload is bounded by the calendar.
    lists = bars.groupBy("code").agg(F.collect_list(row).alias("rows"))
    symbol = landing.market_symbol("code")
    doc = F.to_json(
        F.struct(
            F.lit(0).alias("code"),
            F.map_from_arrays(F.array(symbol), F.array(F.struct(F.col("rows").alias("qfqday")))).alias("data"),
        )
    )
    payloads = lists.select("code", F.concat(F.lit("kline="), doc, F.lit(";")).alias("payload"))
    return landing.kline_bars(payloads)


SQL["kline_payload_scan"] = ask(
    "bars",
    "SELECT code, date, open, high, low, close, volume, close * volume AS amount, CAST(0 AS DOUBLE) AS turnover FROM bars",
    f"code date {_OHLC}",
)


@query(QUERIES, "vendor_column_map")
def vendor_column_map(spark, sf_dir):
    """Chinese headers, text values, a bad date and a superseded copy of every row."""
    names = {v: k for k, v in landing.PRICE_HEADERS.items()}
    bars = market.bars(spark, sf_dir)
    text = bars.select("code", *[F.col(c).cast("string").alias(names[c]) for c in names])
    old = text.withColumn(names["close"], F.lit("n/a")).withColumn("seq", F.lit(0))
    bad = text.withColumn(names["date"], F.lit("--")).withColumn("seq", F.lit(2))
    both = text.withColumn("seq", F.lit(1)).unionByName(old).unionByName(bad)
    return landing.vendor_prices(both, seq="seq")


SQL["vendor_column_map"] = ask("bars", "SELECT * FROM bars", f"code date {_OHLC}")


@query(QUERIES, "incremental_bar_merge")
def incremental_bar_merge(spark, sf_dir):
    """History to 1999 joined by a refetch from 1998 on whose rows carry double volume."""
    bars = market.bars(spark, sf_dir)
    stored = bars.filter(F.col("date") < "1999-01-01")
    fetched = bars.filter(F.col("date") >= "1998-01-01").withColumn("volume", F.col("volume") * 2)
    return store.merge_bars(stored, fetched)


SQL["incremental_bar_merge"] = ask(
    "bars",
    """SELECT * REPLACE (CASE WHEN date >= DATE '1998-01-01' THEN volume * 2 ELSE volume END AS volume) FROM bars""",
    f"code date {_OHLC}",
)


@query(QUERIES, "incremental_request_start")
def incremental_request_start(spark, sf_dir):
    stored = market.bars(spark, sf_dir).filter(F.col("date") < "1999-01-01")
    return store.request_start(market.universe(spark, sf_dir), stored, "1995-01-09")


SQL["incremental_request_start"] = ask(
    "bars universe",
    """SELECT code, CASE WHEN lo IS NULL OR lo > DATE '1995-01-09' THEN DATE '1995-01-09'
         ELSE CAST(hi + INTERVAL 1 DAY AS DATE) END AS start
       FROM universe LEFT JOIN (SELECT code, min(date) AS lo, max(date) AS hi FROM bars WHERE date < DATE '1999-01-01' GROUP BY code)
       USING (code)""",
    "code start",
)


@query(QUERIES, "ledger_day_overwrite")
def ledger_day_overwrite(spark, sf_dir):
    """Daily performance appended twice; the second run replaces its days only."""
    path = _scratch(spark)
    daily = market.bars(spark, sf_dir).groupBy(F.year("date").alias("day")).agg((F.sum("amount") / 1e6).alias("equity"))
    store.append_ledger(daily, path, "day")
    store.append_ledger(daily.filter(F.col("day") >= 1999).withColumn("equity", F.col("equity") / 2), path, "day")
    return spark.read.parquet(path).select("day", "equity")


SQL["ledger_day_overwrite"] = ask(
    "bars",
    """SELECT year(date) AS day, sum(amount) / 1e6 / CASE WHEN year(date) >= 1999 THEN 2 ELSE 1 END AS equity
       FROM bars GROUP BY 1""",
    "i:day r:equity",
)


@query(QUERIES, "statistics_csv_sink")
def statistics_csv_sink(spark, sf_dir):
    path = _scratch(spark)
    stats = market.bars(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("bars"), F.avg("close").alias("mean_close"))
    store.write_statistics(stats, path)
    return spark.read.csv(path, header=True, schema="code string, bars bigint, mean_close double")


SQL["statistics_csv_sink"] = ask(
    "bars", "SELECT code, count(*) AS bars, avg(close) AS mean_close FROM bars GROUP BY code", "code i:bars r:mean_close"
)


@query(QUERIES, "ad_hoc_sql")
def ad_hoc_sql(spark, sf_dir):
    store.register_views({"mill_bars": market.bars(spark, sf_dir), "mill_universe": market.universe(spark, sf_dir)})
    return spark.sql(
        """SELECT u.sector, year(b.date) AS year, avg(b.close) AS mean_close, sum(b.volume) AS volume
           FROM mill_bars b JOIN mill_universe u ON u.code = b.code GROUP BY u.sector, year(b.date)"""
    )


SQL["ad_hoc_sql"] = ask(
    "bars universe",
    "SELECT sector, year(date) AS year, avg(close) AS mean_close, sum(volume) AS volume FROM bars JOIN universe USING (code) GROUP BY 1, 2",
    "sector i:year r:mean_close r:volume",
)


@query(QUERIES, "market_cap_input")
def market_cap_input(spark, sf_dir):
    return market.market_caps(market.bars(spark, sf_dir)).select("date", "code", "market_cap")


SQL["market_cap_input"] = ask(
    "bars",
    """SELECT date, code, close * sum(volume) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS market_cap FROM bars""",
    "date code r:market_cap",
)


@query(QUERIES, "universe_table")
def universe_table(spark, sf_dir):
    return market.universe(spark, sf_dir).withColumn("market", dq.infer_market("code"))


SQL["universe_table"] = ask("universe", f"SELECT *, {_MARKET} AS market FROM universe", "code name industry sector market")

# ---------------------------------------------------------------- quality


@query(QUERIES, "code_normalization")
def code_normalization(spark, sf_dir):
    keys = market.table(spark, sf_dir, "customer").select("c_custkey")
    return keys.select(
        "c_custkey", market.pad_code("c_custkey").alias("padded"),
        dq.normalize_code(F.concat(F.lit("sh"), market.pad_code("c_custkey"), F.lit(""))).alias("suffix"),
        dq.normalize_code(F.concat((F.col("c_custkey") + 100000).cast("string"), F.lit(".0"))).alias("decimal"),
    )


SQL["code_normalization"] = ask(
    "",
    f"""SELECT c_custkey, {code_of('c_custkey')} AS padded, right({code_of('c_custkey')}, 6) AS suffix,
        right(CAST(c_custkey + 100000 AS VARCHAR), 6) AS decimal FROM customer""",
    "c_custkey padded suffix decimal",
)


@query(QUERIES, "coerced_numbers")
def coerced_numbers(spark, sf_dir):
    """Event properties as text, some not numeric; bad values become NULL."""
    raw = market.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")).alias("k"),
        F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.col("ts").cast("date").cast("string")).alias("day"),
    )
    return dq.coerce(raw, ["k"], ["day"]).withColumn("day", F.col("day").cast("string"))


SQL["coerced_numbers"] = ask(
    "",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
       CASE WHEN event_id % 7 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events""",
    "event_id r:k day",
)


@query(QUERIES, "non_finite_to_null")
def non_finite_to_null(spark, sf_dir):
    raw = market.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"),
    )
    return xs.finite_columns(raw, ["value"])


SQL["non_finite_to_null"] = ask(
    "", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN value END AS value FROM events", "event_id r:value"
)


@query(QUERIES, "bar_validation")
def bar_validation(spark, sf_dir):
    """Rules on weekly bars; thin weeks stand for suspensions, early closes are missing."""
    bars = market.bars(spark, sf_dir).select(
        "code", "date", F.col("date").alias("seq"), "open",
        F.when(F.month("date") == 2, F.col("low")).otherwise(F.col("high")).alias("high"), "low",
        F.when(F.col("volume") < 3, None).otherwise(F.col("close")).alias("close"),
        F.greatest(F.col("volume") - 30, F.lit(0.0)).alias("volume"),
    )
    return dq.validate_bars(bars, min_rows=300, max_missing=0.01, suspension_days=6).select(
        "code", F.explode("errors").alias("error")
    )


cte(
    "dirty",
    """SELECT code, date, open, CASE WHEN month(date) = 2 THEN low ELSE high END AS high, low,
       CASE WHEN volume >= 3 THEN close END AS close, greatest(volume - 30, 0) AS volume FROM bars""",
    "bars",
)
cte(
    "streaks",
    f"""SELECT code, max(len) AS streak FROM (SELECT code, run, count(CASE WHEN s THEN 1 END) AS len FROM (
          SELECT code, s, sum(CASE WHEN s THEN 0 ELSE 1 END) {H[:-1]} ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT code, date, coalesce(volume <= 0, false) AS s FROM dirty)) GROUP BY code, run) GROUP BY code""",
    "dirty",
)
SQL["bar_validation"] = ask(
    "dirty streaks",
    """WITH t AS (SELECT code, count(*) AS n, count(*) - count(close) AS nc, bool_or(coalesce(high < greatest(open, close), false)) AS hb,
            bool_or(coalesce(low > least(open, close), false)) AS lb, any_value(streak) AS streak FROM dirty JOIN streaks USING (code) GROUP BY code)
       SELECT code, 'only ' || n || ' rows; at least 300 trading days required' AS error FROM t WHERE n < 300
       UNION ALL SELECT code, printf('close missing rate %.2f%% exceeds 1.00%%', nc * 100.0 / n) FROM t WHERE nc * 1.0 / n > 0.01
       UNION ALL SELECT code, 'close contains null or non-numeric values' FROM t WHERE nc > 0
       UNION ALL SELECT code, 'suspended trading detected: ' || streak || ' consecutive zero-volume days' FROM t WHERE streak >= 6
       UNION ALL SELECT code, 'high is below open or close' FROM t WHERE nc = 0 AND hb
       UNION ALL SELECT code, 'low is above open or close' FROM t WHERE nc = 0 AND lb""",
    "code error",
)


@query(QUERIES, "suspension_streaks")
def suspension_streaks(spark, sf_dir):
    bars = market.bars(spark, sf_dir)
    return dq.longest_streak(bars, F.col("volume") <= 30)


SQL["suspension_streaks"] = ask("streaks", "SELECT * FROM streaks", "code i:streak")


@query(QUERIES, "research_readiness")
def research_readiness(spark, sf_dir):
    bars = market.bars(spark, sf_dir).filter(F.col("date") >= "1995-02-01")
    checked = dq.validate_bars(bars.withColumn("seq", F.col("date")), min_rows=290)
    features = ts.build_factors(bars, ["trend_120"]).filter(F.col("trend_120").isNotNull())
    return dq.research_readiness(market.universe(spark, sf_dir), bars, checked, features)


SQL["research_readiness"] = ask(
    "universe bars",
    """SELECT *, stocks > 0 AND valid_ratio >= 0.95 AND feature_ratio >= 0.95 AS research_ready FROM (
         SELECT count(*) AS stocks, count(n) AS available_histories, count(CASE WHEN n >= 290 THEN 1 END) AS valid,
           count(CASE WHEN n >= 120 THEN 1 END) AS feature_stocks, avg(n) AS average_days,
           (count(*) - count(n)) * 1.0 / count(*) AS missing_ratio, count(CASE WHEN n >= 290 THEN 1 END) * 1.0 / count(*) AS valid_ratio,
           count(CASE WHEN n >= 120 THEN 1 END) * 1.0 / count(*) AS feature_ratio
         FROM universe LEFT JOIN (SELECT code, count(*) AS n FROM bars WHERE date >= DATE '1995-02-01' GROUP BY code) USING (code))""",
    "i:stocks i:available_histories i:valid i:feature_stocks r:average_days r:missing_ratio r:valid_ratio r:feature_ratio research_ready",
)


def _components(spark, sf_dir):
    """Three overlapping index lists over the suppliers."""
    members = market.universe(spark, sf_dir)
    key = F.col("code").cast("bigint")
    sector = F.when(key % 4 == 0, "Unknown").otherwise(F.col("sector"))
    lists = [
        members.filter(key % 2 == 0).withColumns({"index_source": F.lit("HS300"), "seq": F.lit(0), "sector": sector}),
        members.filter(key % 3 == 0).withColumns({"index_source": F.lit("CSI500"), "seq": F.lit(1)}),
        members.filter(key % 5 == 0).withColumns({"index_source": F.lit("ChiNext"), "seq": F.lit(2)}),
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


cte(
    "components",
    """SELECT code, name, CASE WHEN CAST(code AS BIGINT) % 4 = 0 THEN 'Unknown' ELSE sector END AS sector, 'HS300' AS index_source, 0 AS seq
         FROM universe WHERE CAST(code AS BIGINT) % 2 = 0
       UNION ALL SELECT code, name, sector, 'CSI500', 1 FROM universe WHERE CAST(code AS BIGINT) % 3 = 0
       UNION ALL SELECT code, name, sector, 'ChiNext', 2 FROM universe WHERE CAST(code AS BIGINT) % 5 = 0""",
    "universe",
)


@query(QUERIES, "multi_index_universe")
def multi_index_universe(spark, sf_dir):
    merged = dq.merge_universe(_components(spark, sf_dir))
    return merged.withColumn("index_source", F.array_join("index_source", "|"))


SQL["multi_index_universe"] = ask(
    "components",
    """SELECT code, arg_min(name, seq) AS name, coalesce(arg_min(sector, seq) FILTER (WHERE sector <> 'Unknown'), 'Unknown') AS sector,
       string_agg(index_source, '|' ORDER BY seq) AS index_source FROM components GROUP BY code""",
    "code name sector index_source",
)


@query(QUERIES, "universe_index_counts")
def universe_index_counts(spark, sf_dir):
    return dq.index_membership(dq.merge_universe(_components(spark, sf_dir)))


SQL["universe_index_counts"] = ask(
    "components", 'SELECT index_source AS "index", count(DISTINCT code) AS members FROM components GROUP BY 1', '"index" i:members'
)


@query(QUERIES, "universe_sector_counts")
def universe_sector_counts(spark, sf_dir):
    return dq.sector_counts(dq.merge_universe(_components(spark, sf_dir)))


SQL["universe_sector_counts"] = ask(
    "components",
    """SELECT sector, count(*) AS members, count(*) * 1.0 / sum(count(*)) OVER () AS share,
       sum(CASE WHEN sector = 'Unknown' THEN count(*) ELSE 0 END) OVER () * 1.0 / sum(count(*)) OVER () < 0.05 AS known_enough
       FROM (SELECT code, coalesce(arg_min(sector, seq) FILTER (WHERE sector <> 'Unknown'), 'Unknown') AS sector FROM components GROUP BY code)
       GROUP BY sector""",
    "sector i:members r:share known_enough",
)


@query(QUERIES, "keyword_sectors")
def keyword_sectors(spark, sf_dir):
    """Sector keywords over whole document texts."""
    docs = market.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", dq.sector_of("text").alias("sector"))


SQL["keyword_sectors"] = ask(
    "",
    "SELECT doc_id, CASE "
    + " ".join(
        f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{sector}'" for sector, words in dq.SECTOR_RULES
    )
    + " ELSE 'Other' END AS sector FROM documents",
    "doc_id sector",
)


@query(QUERIES, "sector_precedence")
def sector_precedence(spark, sf_dir):
    members = market.universe(spark, sf_dir)
    key = F.col("code").cast("bigint")
    supplied = members.select(
        "code", F.when(key % 3 == 0, None).otherwise(F.col("industry")).alias("industry"),
        F.when(key % 2 == 0, " ").otherwise(F.col("sector")).alias("supplied_sector"),
    )
    overrides = members.filter(key % 11 == 0).select("code", F.lit("Pinned").alias("sector"))
    mapped = market.table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 10).select(
        F.col("n_name").alias("industry"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("sector")
    )
    return dq.resolve_sector(supplied, overrides, mapped).select("code", "sector")


SQL["sector_precedence"] = ask(
    "universe",
    """SELECT code, CASE WHEN k % 11 = 0 THEN 'Pinned' ELSE coalesce('Region ' || n.n_regionkey, label, 'Unknown') END AS sector
       FROM (SELECT code, CAST(code AS BIGINT) AS k, nullif(trim(coalesce(CASE WHEN CAST(code AS BIGINT) % 3 <> 0 THEN industry END,
               CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN ' ' ELSE sector END)), '') AS label FROM universe) u
       LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON n.n_name = u.label""",
    "code sector",
)


@query(QUERIES, "keep_last_per_key")
def keep_last_per_key(spark, sf_dir):
    """Last order line per (order, line) key, by ship date then part."""
    lines = market.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    kept = keep_last(lines, ["l_orderkey", "l_linenumber"], F.struct(F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")))
    return kept.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_partkey")


SQL["keep_last_per_key"] = ask(
    "",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (
         PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rk FROM lineitem) WHERE rk = 1""",
    "l_orderkey i:l_linenumber l_shipdate l_partkey",
)


@query(QUERIES, "dataset_summary")
def dataset_summary(spark, sf_dir):
    return dq.dataset_summary(market.bars(spark, sf_dir))


SQL["dataset_summary"] = ask(
    "bars",
    """SELECT count(*) AS rows, count(DISTINCT code) AS stocks, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date
       FROM bars""",
    "i:rows i:stocks i:dates first_date last_date",
)


@query(QUERIES, "common_latest_snapshot")
def common_latest_snapshot(spark, sf_dir):
    return dq.common_snapshot(market.bars(spark, sf_dir).select("date", "code", "close"))


SQL["common_latest_snapshot"] = ask(
    "bars", "SELECT date, code, close FROM bars WHERE date = (SELECT min(m) FROM (SELECT max(date) AS m FROM bars GROUP BY code))",
    "date code r:close",
)


@query(QUERIES, "stale_features", text=("feature_date",))
def stale_features(spark, sf_dir):
    bars = market.bars(spark, sf_dir)
    built = ts.build_factors(bars.filter(F.col("date") < "2001-10-29"), ["trend_120"])
    return dq.stale_features(bars, built.filter(F.col("trend_120").isNotNull()))


SQL["stale_features"] = ask(
    "bars",
    f"""SELECT * FROM (SELECT code, max(date) AS raw_date FROM bars GROUP BY code) LEFT JOIN (
          SELECT code, max(date) AS feature_date FROM (SELECT code, date, {full('avg', 'close', 120)} AS t FROM bars WHERE date < DATE '2001-10-29')
          WHERE t IS NOT NULL GROUP BY code) USING (code) WHERE feature_date IS NULL OR raw_date > feature_date""",
    "code raw_date s:feature_date",
)


@query(QUERIES, "latest_classification")
def latest_classification(spark, sf_dir):
    """Newest usable label per part from its order lines: flag pair, else status."""
    lines = market.table(spark, sf_dir, "lineitem")
    history = lines.select(
        F.col("l_partkey").cast("string").alias("code"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", "l_linestatus")).otherwise(" ").alias("fine"),
        F.when(F.col("l_linenumber") % 3 == 0, "nan").otherwise(F.col("l_linestatus")).alias("coarse"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return dq.latest_classification(history, ["fine", "coarse"], "seq")


SQL["latest_classification"] = ask(
    "",
    """SELECT code, arg_max(label, seq) AS industry FROM (
         SELECT CAST(l_partkey AS VARCHAR) AS code, row(l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS seq,
           CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linestatus WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS label
         FROM lineitem) WHERE label IS NOT NULL GROUP BY code""",
    "code industry",
)


@query(QUERIES, "snapshot_acceptance")
def snapshot_acceptance(spark, sf_dir):
    return dq.accepted_snapshots(_components(spark, sf_dir), {"HS300": 40, "CSI500": 40, "ChiNext": 10})


SQL["snapshot_acceptance"] = ask(
    "components",
    """SELECT index_source, count(*) AS rows, count(*) >= CASE index_source WHEN 'ChiNext' THEN 10 ELSE 40 END AS accepted
       FROM components GROUP BY 1""",
    "index_source i:rows accepted",
)


@query(QUERIES, "missing_histories")
def missing_histories(spark, sf_dir):
    """Members without a bar in the first two weeks."""
    early = market.bars(spark, sf_dir).filter(F.col("date") < "1995-01-16")
    return dq.missing_codes(market.universe(spark, sf_dir), early).select("code", "name")


SQL["missing_histories"] = ask(
    "universe bars",
    "SELECT code, name FROM universe WHERE code NOT IN (SELECT code FROM bars WHERE date < DATE '1995-01-16')",
    "code name",
)


@query(QUERIES, "universe_restriction")
def universe_restriction(spark, sf_dir):
    chosen = market.universe(spark, sf_dir).filter(F.col("sector") == "ASIA")
    return dq.only_universe(market.bars(spark, sf_dir).select("date", "code", "close"), chosen)


SQL["universe_restriction"] = ask(
    "universe bars",
    "SELECT date, code, close FROM bars WHERE code IN (SELECT code FROM universe WHERE sector = 'ASIA')",
    "date code r:close",
)
