"""Validation of bars, universes and classifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, two_decimals
from ..functions.groups import keep_first

BAR_COLUMNS = ("date", "open", "high", "low", "close", "volume")

# First matching keyword decides the sector.
SECTOR_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Financials", ("银行", "保险", "证券", "金融", "bank", "insurance", "brokerage")),
    ("Healthcare", ("医药", "医疗", "生物", "保健", "health", "pharma", "medical")),
    ("Technology", ("半导体", "电子", "软件", "计算机", "通信", "互联网", "元件", "technology", "software", "semiconductor")),
    ("Consumer", ("食品", "饮料", "白酒", "家电", "零售", "服装", "纺织", "旅游", "酒店", "餐饮", "美容", "consumer", "food", "beverage")),
    ("Real Estate", ("房地产", "物业", "real estate")),
    ("Energy", ("煤炭", "石油", "天然气", "油气", "energy", "coal", "oil", "gas")),
    ("Utilities", ("电力", "水务", "供气", "环保", "utility", "utilities")),
    ("Materials", ("化工", "有色", "钢铁", "建材", "水泥", "玻璃", "橡胶", "塑料", "材料", "materials", "chemicals")),
    ("Industrials", ("机械", "设备", "工程", "建筑", "运输", "物流", "船舶", "航空", "军工", "工业", "industrial", "machinery")),
)


def normalize_code(value: Column | str) -> Column:
    """Trailing six digits of a code, after dropping a ``.0`` suffix; '' if none."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    text = F.regexp_replace(text, r"^(\d+)\.0$", "$1")
    return F.regexp_extract(text, r"(\d{6})$", 1)


def infer_market(code: Column | str) -> Column:
    """Market from the first digit."""
    first = F.substring(code, 1, 1)
    return F.when(first.isin("5", "6", "9"), "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")


def sector_of(text: Column | str) -> Column:
    """Broad sector by keyword, ``Other`` when nothing matches."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for sector, words in SECTOR_RULES:
        hit = low.rlike("|".join(words))
        out = F.when(hit, sector) if out is None else out.when(hit, sector)
    return out.otherwise("Other")


def coerce(df: DataFrame, numeric: Sequence[str], dates: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Cast text to numbers and dates; bad values become NULL, or raise when strict."""
    def conv(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if strict else F.col(name).try_cast(kind)

    return df.withColumns(
        {**{n: conv(n, "double") for n in numeric}, **{d: conv(d, "date") for d in dates}}
    )


def longest_streak(df: DataFrame, flag: Column, key: str = "code", order: str = "date") -> DataFrame:
    """Longest run of consecutive flagged rows per key; NULL breaks a run."""
    w = Window.partitionBy(key).orderBy(order)
    on = F.coalesce(flag, F.lit(False))
    runs = df.select(
        key, on.alias("_on"),
        F.sum(F.when(on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
    )
    lengths = runs.groupBy(key, "_run").agg(F.count(F.when(F.col("_on"), 1)).alias("_len"))
    return lengths.groupBy(key).agg(F.max("_len").alias("streak"))


def validate_bars(
    bars: DataFrame,
    seq: str = "seq",
    min_rows: int = 501,
    max_missing: float = 0.05,
    suspension_days: int = 5,
) -> DataFrame:
    """``code, errors``: every broken rule per instrument, empty when clean.

    ``seq`` is the arrival order. One aggregate evaluates all rules.
    """
    w = Window.partitionBy("code").orderBy(seq)
    df = bars.withColumns(
        {
            "_back": F.col("date") < F.lag("date").over(w),
            "_high": F.col("high") < F.greatest("open", "close"),
            "_low": F.col("low") > F.least("open", "close"),
        }
    )
    null = {c: F.count(F.when(F.col(c).isNull(), 1)) for c in BAR_COLUMNS}
    stats = df.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        *[null[c].alias(f"null_{c}") for c in BAR_COLUMNS],
        F.max(F.coalesce("_back", F.lit(False))).alias("back"),
        (F.count("date") > F.countDistinct("date")).alias("dup"),
        F.max(F.coalesce("_high", F.lit(False))).alias("high_bad"),
        F.max(F.coalesce("_low", F.lit(False))).alias("low_bad"),
    )
    stats = stats.join(longest_streak(bars, F.col("volume") <= 0, order=seq), "code")
    missing = [
        F.when(
            F.col(f"null_{c}") / F.col("n") > max_missing,
            F.format_string(
                f"{c} missing rate %s%% exceeds {max_missing * 100:.2f}%%",
                two_decimals(F.col(f"null_{c}") * 100.0 / F.col("n")),
            ),
        )
        for c in BAR_COLUMNS
    ]
    dated = F.col("null_date") == 0
    price_gap = (F.col("null_open") + F.col("null_high") + F.col("null_low")) > 0
    whole = ~price_gap & (F.col("null_close") == 0)
    rules = [
        F.when(
            F.col("n") < min_rows,
            F.format_string(f"only %d rows; at least {min_rows} trading days required", F.col("n")),
        ),
        *missing,
        F.when(~dated, F.lit("date contains null or invalid values")),
        F.when(dated & F.col("back"), F.lit("dates are not in ascending order")),
        F.when(dated & F.col("dup"), F.lit("dates contain duplicates")),
        F.when(F.col("null_close") > 0, F.lit("close contains null or non-numeric values")),
        F.when(F.col("null_volume") > 0, F.lit("volume contains null or non-numeric values")),
        F.when(
            F.col("streak") >= suspension_days,
            F.format_string("suspended trading detected: %d consecutive zero-volume days", F.col("streak")),
        ),
        F.when(price_gap, F.lit("open, high, or low contains null or non-numeric values")),
        F.when(whole & F.col("high_bad"), F.lit("high is below open or close")),
        F.when(whole & F.col("low_bad"), F.lit("low is above open or close")),
    ]
    return stats.select("code", F.array_compact(F.array(*rules)).alias("errors"))


def research_readiness(
    universe: DataFrame, bars: DataFrame, validation: DataFrame, features: DataFrame, minimum: float = 0.95
) -> DataFrame:
    """One row: coverage of a universe by histories, clean histories and features."""
    days = bars.groupBy("code").agg(F.count(F.lit(1)).alias("_days"))
    good = validation.select("code", (F.size("errors") == 0).alias("_ok"))
    built = features.select("code").distinct().withColumn("_feat", F.lit(True))
    df = universe.select("code").distinct().join(days, "code", "left").join(good, "code", "left").join(built, "code", "left")
    has = F.col("_days").isNotNull()
    df = df.agg(
        F.count(F.lit(1)).alias("stocks"),
        F.count("_days").alias("available_histories"),
        F.count(F.when(F.col("_ok"), 1)).alias("valid"),
        F.count(F.when(has & F.col("_feat"), 1)).alias("feature_stocks"),
        F.coalesce(F.avg("_days"), F.lit(0.0)).alias("average_days"),
    )

    def share(c: Column) -> Column:
        return F.coalesce(ratio(c, F.col("stocks")), F.lit(0.0))

    df = df.withColumns(
        {
            "missing_ratio": share(F.col("stocks") - F.col("available_histories")),
            "valid_ratio": share(F.col("valid")),
            "feature_ratio": share(F.col("feature_stocks")),
        }
    )
    ready = (F.col("stocks") > 0) & (F.col("valid_ratio") >= minimum) & (F.col("feature_ratio") >= minimum)
    return df.withColumn("research_ready", ready)


def index_membership(universe: DataFrame) -> DataFrame:
    """Members per index source."""
    return (
        universe.select("code", F.explode("index_source").alias("index"))
        .groupBy("index").agg(F.count(F.lit(1)).alias("members"))
    )


def sector_counts(universe: DataFrame, max_unknown: float = 0.05) -> DataFrame:
    """Members per sector, its share and whether unknowns stay below the limit."""
    counts = universe.groupBy("sector").agg(F.count(F.lit(1)).alias("members"))
    total = counts.agg(
        F.sum("members").alias("_all"),
        F.sum(F.when(F.col("sector") == "Unknown", F.col("members")).otherwise(0)).alias("_unknown"),
    )
    return counts.join(F.broadcast(total)).select(
        "sector", "members", ratio("members", "_all").alias("share"),
        (ratio("_unknown", "_all") < max_unknown).alias("known_enough"),
    )


def resolve_sector(
    members: DataFrame, overrides: DataFrame, industry_sectors: DataFrame, default: str = "Unknown"
) -> DataFrame:
    """Code override, else mapped industry, else the supplied label, else default.

    ``overrides``: ``code, sector``; ``industry_sectors``: ``industry, sector``.
    """
    label = F.nullif(F.trim(F.coalesce("industry", "supplied_sector")), F.lit(""))
    df = members.withColumn("_label", label)
    df = df.join(overrides.select("code", F.col("sector").alias("_o")), "code", "left")
    mapped = industry_sectors.select(F.col("industry").alias("_label"), F.col("sector").alias("_m"))
    df = df.join(mapped, "_label", "left")
    return df.withColumn("sector", F.coalesce("_o", "_m", "_label", F.lit(default))).drop("_label", "_o", "_m")


def dataset_summary(panel: DataFrame) -> DataFrame:
    """Rows, instruments, sessions and their span."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("code").alias("stocks"),
        F.countDistinct("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def common_snapshot(panel: DataFrame) -> DataFrame:
    """Rows at the earliest of the per-code last dates."""
    last = panel.groupBy("code").agg(F.max("date").alias("_last")).agg(F.min("_last").alias("date"))
    return panel.join(F.broadcast(last), "date")


def stale_features(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Codes whose bars are newer than their features, or that have none."""
    raw = bars.groupBy("code").agg(F.max("date").alias("raw_date"))
    feat = features.groupBy("code").agg(F.max("date").alias("feature_date"))
    return raw.join(feat, "code", "left").filter(
        F.col("feature_date").isNull() | (F.col("raw_date") > F.col("feature_date"))
    )


def latest_classification(history: DataFrame, levels: Sequence[str], seq: str) -> DataFrame:
    """Newest non-empty industry name per code, most detailed level first."""
    def clean(c: str) -> Column:
        t = F.trim(F.col(c))
        bad = (t == "") | F.lower(t).isin("nan", "none") | t.rlike(r"^\d+$")
        return F.when(~bad, t)

    named = history.withColumn("_name", F.coalesce(*[clean(c) for c in levels]))
    return named.filter(F.col("_name").isNotNull()).groupBy("code").agg(
        F.max_by("_name", seq).alias("industry")
    )


def accepted_snapshots(components: DataFrame, minimums: Mapping[str, int]) -> DataFrame:
    """Row count per index and whether it reaches the minimum."""
    counts = components.groupBy("index_source").agg(F.count(F.lit(1)).alias("rows"))
    need = F.create_map(*[F.lit(x) for pair in minimums.items() for x in pair])
    return counts.withColumn("accepted", F.col("rows") >= F.coalesce(F.try_element_at(need, F.col("index_source")), F.lit(1)))


def merge_universe(components: DataFrame) -> DataFrame:
    """One row per code over several index lists (A10).

    ``components``: ``code, name, sector, index_source, seq``; sources keep their order, the
    first known sector wins.
    """
    known = F.when(F.col("sector") != "Unknown", F.col("sector"))
    per_source = components.groupBy("code", "index_source").agg(
        F.min("seq").alias("_s"),
        F.min_by("name", "seq").alias("_name"),
        F.min_by(known, F.when(known.isNotNull(), F.col("seq"))).alias("_sector"),
    )
    # At most one row per index list is left of each code.
    ordered = F.array_sort(F.collect_list(F.struct("_s", "index_source", "_sector", "_name")))
    merged = per_source.groupBy("code").agg(ordered.alias("_rows"))
    sectors = F.filter(F.transform("_rows", lambda r: r["_sector"]), lambda s: s.isNotNull())
    return merged.select(
        "code",
        F.element_at(F.transform("_rows", lambda r: r["_name"]), 1).alias("name"),
        F.coalesce(F.try_element_at(sectors, F.lit(1)), F.lit("Unknown")).alias("sector"),
        F.transform("_rows", lambda r: r["index_source"]).alias("index_source"),
    )


def missing_codes(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Universe members without history."""
    return universe.join(bars.select("code").distinct(), "code", "left_anti")


def only_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Panel rows of universe members."""
    return panel.join(universe.select("code").distinct(), "code", "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """De-duplicate keeping the first arrival."""
    return keep_first(df, keys, seq)


def rows_at_latest_date(panel: DataFrame) -> DataFrame:
    """Rows of the newest session."""
    last = panel.agg(F.max("date").alias("date"))
    return panel.join(F.broadcast(last), "date")
