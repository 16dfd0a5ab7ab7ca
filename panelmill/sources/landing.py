"""Parsers of landed files: component lists, industry snapshots, price payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import durable, keep_last
from ..operators.quality import infer_market, normalize_code

# Header aliases, first present non-empty one wins.
CODE_FIELDS = ("code", "symbol", "证券代码", "成分券代码", "成分股代码", "股票代码")
NAME_FIELDS = ("name", "证券简称", "成分券名称", "成分股名称", "股票简称", "简称")
MARKET_FIELDS = ("market", "exchange", "市场", "交易所")
SECTOR_FIELDS = ("sector", "industry", "industry_classification", "industry_name", "行业", "所属行业")

# Vendor price headers.
PRICE_HEADERS = {
    "日期": "date",
    "开盘": "open",
    "最高": "high",
    "最低": "low",
    "收盘": "close",
    "成交量": "volume",
    "成交额": "amount",
    "换手率": "turnover",
}

BAR_SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "turnover")]
)


def _field(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-empty alias of a field; headers are compared trimmed and lower-cased. Rows of
    ``read_lists`` bring their own header."""
    if {"header", "cells"} <= set(df.columns):
        found = [F.get("cells", F.array_position("header", F.lit(n.lower())).cast("int") - 1) for n in names]
    else:
        present = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}
        found = [F.col(f"`{present[n.lower()]}`").cast("string") for n in names if n.lower() in present]
    found = [F.nullif(F.trim(c), F.lit("")) for c in found]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _decoded(encoding: str):
    def decode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda b: b.decode(encoding), na_action="ignore")

    # Filters on its result may not move below the join that says which lines are foreign.
    return F.pandas_udf(decode, "string").asNondeterministic()


def read_lists(spark: SparkSession, path: str, foreign: str = "gb18030") -> DataFrame:
    """``file, seq, header, cells``: the records of all CSV files under a path.

    A file is UTF-8 where every one of its lines is, and ``foreign`` otherwise: the check is an
    aggregate over whole files, wherever the first foreign byte stands. Lines are read as bytes
    (no line end is part of a character in either encoding), so a file is never held whole.
    Every file has its own header. ``seq`` is the order inside a file. Quoted line breaks are
    not part of these lists.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"),
        "value",
    )
    lines = durable(lines.withColumn("value", F.col("value").cast("binary")))
    # A row per file.
    plain = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("plain"))
    marked = lines.join(plain, "file")
    text = marked.filter("plain").withColumn("text", F.col("value").cast("string")).unionByName(
        marked.filter("not plain").withColumn("text", _decoded(foreign)("value"))
    )
    text = durable(text.select("file", "seq", F.regexp_replace("text", "^\ufeff|\r$", "").alias("text")).filter("text <> ''"))
    heads = text.groupBy("file").agg(F.min_by("text", "seq").alias("head"), F.min("seq").alias("first"))
    widths = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    fields = ", ".join(f"c{i} string" for i in range(widths))
    split = lambda c: F.from_csv(c, fields)
    cells = F.array(*[F.col(f"r.c{i}") for i in range(widths)])
    header = F.array(*[F.coalesce(F.lower(F.trim(F.col(f"h.c{i}"))), F.lit("")) for i in range(widths)])
    records = text.join(heads, "file").filter(F.col("seq") > F.col("first"))
    records = records.select("file", "seq", split("head").alias("h"), split("text").alias("r"))
    return records.select("file", "seq", header.alias("header"), cells.alias("cells"))


def components(df: DataFrame, index_source: str | Column) -> DataFrame:
    """Normalised members of index lists (S4); rows of ``read_lists`` keep their file."""
    code = F.coalesce(normalize_code(_field(df, CODE_FIELDS)), F.lit(""))
    keep = ["file"] if "cells" in df.columns else []
    rows = df.select(
        code.alias("code"),
        _field(df, NAME_FIELDS).alias("name"),
        (F.lit(index_source) if isinstance(index_source, str) else index_source).alias("index_source"),
        *keep,
        _field(df, MARKET_FIELDS).alias("_market"),
        _field(df, SECTOR_FIELDS).alias("_sector"),
    )
    return rows.select(
        "code", "name", "index_source",
        F.upper(F.coalesce("_market", infer_market("code"))).alias("market"),
        F.coalesce("_sector", F.lit("Unknown")).alias("sector"),
        *keep,
    )


def accepted_lists(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the lists without a bad record, and ``file, bad, rows`` of the others: one
    member without code or name rejects its whole file (S4)."""
    judged = members.groupBy("file").agg(
        F.count_if((F.col("code") == "") | F.col("name").isNull()).alias("bad"), F.count(F.lit(1)).alias("rows")
    )
    rejected = judged.filter("bad > 0")
    return members.join(rejected.select("file"), "file", "left_anti"), rejected


def incomplete_components(df: DataFrame) -> DataFrame:
    """Members without code or name; a list with any must be rejected."""
    return df.filter((F.col("code") == "") | F.col("name").isNull())


# Headers of industry tables, in order of preference.
SNAPSHOT_HEADERS = {
    "code": ("code", "symbol", "证券代码", "股票代码"),
    "sector": ("sector", "行业门类"),
    "industry": ("industry", "所属行业", "行业"),
}


def find_header(columns: Sequence[str], wanted: Sequence[str], fallback: int | None = None) -> str:
    """The column meant by a header (S16): an equal name before one that contains it, both
    without case and blanks, in order of ``wanted``; else the column at ``fallback``."""
    def plain(text: str) -> str:
        return text.lstrip("\ufeff").lower().replace(" ", "").strip()

    for test in (str.__eq__, str.__contains__):
        hit = next((c for w in wanted for c in columns if test(plain(c), plain(w))), None)
        if hit is not None:
            return hit
    if fallback is None or fallback >= len(columns):
        raise ValueError(f"no column of the table stands for {wanted[0]}")
    return columns[fallback]


def industry_snapshot(df: DataFrame, *seq: str) -> DataFrame:
    """``code, sector, industry`` of a saved snapshot (S16): headers are searched, rows without
    code or sector are dropped, a blank industry is ``Unknown``. With ``seq`` the last usable
    row of a code wins."""
    named = {name: find_header(df.columns, wanted) for name, wanted in SNAPSHOT_HEADERS.items()}

    def text(name: str) -> Column:
        t = F.trim(F.col(f"`{named[name]}`").cast("string"))
        return F.when((t != "") & (F.lower(t) != "nan"), t)

    rows = df.select(
        normalize_code(F.col(f"`{named['code']}`")).alias("code"), text("sector").alias("sector"),
        F.coalesce(text("industry"), F.lit("Unknown")).alias("industry"), *seq,
    )
    rows = rows.filter((F.col("code") != "") & F.col("sector").isNotNull())
    return keep_last(rows, ["code"], *seq).drop(*seq) if seq else rows


def vendor_prices(df: DataFrame, headers: Mapping[str, str] = PRICE_HEADERS, seq: str | None = None) -> DataFrame:
    """Vendor columns to the bar contract (S6): rename, coerce, drop bad dates, last wins."""
    renamed = df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})
    numbers = [f.name for f in BAR_SCHEMA.fields if f.name not in ("code", "date")]
    rows = renamed.select(
        *(["code"] if "code" in renamed.columns else []),
        F.col("date").try_cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in numbers],
        *([seq] if seq else []),
    ).filter(F.col("date").isNotNull())
    if seq is None:
        return rows
    keys = ["code", "date"] if "code" in rows.columns else ["date"]
    return keep_last(rows, keys, seq).drop(seq)


def kline_bars(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Bars from JSON or ``name={...}`` price payloads.

    ``payloads``: ``code`` and the text. Rows are ``[date, open, close, high, low, volume,
    ...]`` with amount at position 8 and turnover at 10 when present; a missing amount is
    close x volume, a missing turnover 0.
    """
    body = F.regexp_replace(F.rtrim(F.trim(F.col(text))), r";$", "")
    body = F.regexp_replace(body, r"^[^{=]*=\s*", "")
    day = "map<string,struct<qfqday:array<array<string>>,day:array<array<string>>>>"
    parsed = payloads.select("code", F.from_json(body, f"struct<code:int,data:{day}>").alias("_p"))
    good = parsed.filter(F.coalesce(F.col("_p.code"), F.lit(0)) == 0)
    quotes = good.select("code", F.explode(F.map_values("_p.data")).alias("_q"))
    lists = quotes.select(
        "code",
        F.explode(F.when(F.size("_q.qfqday") > 0, F.col("_q.qfqday")).otherwise(F.col("_q.day"))).alias("_r"),
    ).filter(F.size("_r") >= 6)

    def at(i: int, kind: str = "double") -> Column:
        return F.get("_r", F.lit(i)).try_cast(kind)

    return lists.select(
        "code", at(0, "date").alias("date"), at(1).alias("open"), at(3).alias("high"), at(4).alias("low"),
        at(2).alias("close"), at(5).alias("volume"),
        F.when(F.size("_r") > 8, at(8)).otherwise(at(2) * at(5)).alias("amount"),
        F.when(F.size("_r") > 10, at(10)).otherwise(0.0).alias("turnover"),
    ).filter(F.col("date").isNotNull())


def market_symbol(code: Column | str) -> Column:
    """Exchange-prefixed symbol."""
    return F.concat(F.lower(infer_market(code)), code)


def universe_rows(spark: SparkSession, stocks: Sequence[Mapping] | Mapping[str, Sequence[Mapping]]) -> DataFrame:
    """Universe from a parsed configuration: a flat list or ``{category: [...]}``."""
    flat = (
        [{**s, "sector": s.get("sector") or cat} for cat, group in stocks.items() for s in group]
        if isinstance(stocks, Mapping)
        else list(stocks)
    )

    def sources(v) -> list[str]:
        return [] if v is None else [p for p in v.split("|") if p] if isinstance(v, str) else [str(x) for x in v]

    rows = [
        (
            str(s["code"]), s.get("name"), s.get("market"), s.get("sector") or "Unknown",
            s.get("industry") or "Unknown", sources(s.get("index_source")),
        )
        for s in flat
    ]
    schema = "code string, name string, market string, sector string, industry string, index_source array<string>"
    df = spark.createDataFrame(rows, schema)
    code = F.when(F.length("code") < 6, F.lpad("code", 6, "0")).otherwise(F.col("code"))
    return df.withColumn("code", code).withColumn("market", F.upper(F.coalesce("market", infer_market("code"))))
