"""Point-in-time joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import keep_last


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` (``<`` when strict) per ``by``.

    Both sides are stacked and a running ``last`` carries the right row forward: one
    exchange on ``by`` and one sort, no theta join. The whole row is carried, so a NULL
    inside the newest row stays NULL. With an empty ``by`` both sides must be date series.
    """
    payload = F.struct(*[F.col(v) for v in values])
    side = 1 if strict else -1
    a = left.withColumns({"_t": F.col(left_on), "_side": F.lit(0)}).withColumn(
        "_row", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    )
    b = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_t"), F.lit(side).alias("_side"), payload.alias("_row")
    )
    both = a.unionByName(b, allowMissingColumns=True)
    w = (
        Window.partitionBy(*by)
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(w)).filter(F.col("_side") == 0)
    # Every row of b is dropped by its side marker, including unmatched keys.
    return found.select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def carry_basket(holdings: DataFrame, dates: DataFrame) -> DataFrame:
    """Latest basket for every date (J6): ``date`` plus the holding columns, where
    ``basket_date`` is the rebalance in force.

    Only the calendar meets the rebalance dates in a range; the holdings then join on the
    exact basket date.
    """
    starts = holdings.select(F.col("date").alias("basket_date")).distinct()
    days = dates.select("date").distinct()
    in_force = asof_join(
        days, starts, [], "date", "basket_date", ["basket_date"]
    ).filter(F.col("basket_date").isNotNull())
    basket = holdings.withColumnRenamed("date", "basket_date")
    return F.broadcast(in_force).join(basket, "basket_date")


def fill_sessions(bars: DataFrame, dates: DataFrame, columns: Sequence[str] = ("open", "close")) -> DataFrame:
    """Bars on every session from a code's first one on, last known close in gaps.

    Each bar covers the session indexes up to the next bar of its code, so rows are added
    only for gaps and no code x calendar product is formed.
    """
    cal = dates.select("date").distinct().withColumn(
        "_idx", F.row_number().over(Window.orderBy("date")) - 1
    )
    size = cal.agg(F.count(F.lit(1)).cast("int").alias("_size"))
    cal_b = F.broadcast(cal)
    w = Window.partitionBy("code").orderBy("date")
    carried = list(dict.fromkeys([*columns, "close"]))
    spans = (
        bars.select("code", "date", *carried)
        .join(cal_b, "date")
        .join(F.broadcast(size))
        .withColumn("_next", F.coalesce(F.lead("_idx").over(w), F.col("_size")))
    )
    dense = spans.withColumnRenamed("date", "_bar_date").withColumn(
        "_i", F.explode(F.sequence(F.col("_idx"), F.col("_next") - 1))
    )
    back = F.broadcast(cal.select(F.col("date"), F.col("_idx").alias("_i")))
    real = F.col("_i") == F.col("_idx")
    return dense.join(back, "_i").select(
        "code",
        "date",
        *[F.when(real, F.col(c)).otherwise(F.col("close")).alias(c) for c in columns],
        real.alias("traded"),
    )


def latest_per_code(bars: DataFrame, as_of: str, value: str = "close") -> DataFrame:
    """Last positive value per code on or before a date."""
    past = bars.filter((F.col("date") <= F.lit(as_of).cast("date")) & (F.col(value) > 0))
    return past.groupBy("code").agg(
        F.max_by(value, "date").alias("price"), F.max("date").alias("price_date")
    )


def price_at(left: DataFrame, bars: DataFrame, date: str, price: str, out: str) -> DataFrame:
    """Positive price at (date, code), NULL where there is none."""
    lookup = bars.filter(F.col(price) > 0).select(
        "code", F.col("date").alias(date), F.col(price).alias(out)
    )
    return left.join(lookup, ["code", date], "left")


def left_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Left join that first reduces the right side to one row per key.

    A single value is reduced by an aggregate that combines before the shuffle and sorts
    nothing; several must come from one row, which a ranking picks.
    """
    values = [c for c in right.columns if c not in (*keys, seq)]
    if len(values) != 1:
        return left.join(keep_last(right, keys, seq), list(keys), "left")
    value = F.when(F.count(seq) == 0, F.max(values[0])).otherwise(F.max_by(values[0], seq))
    newest = right.groupBy(*keys).agg(value.alias(values[0]), F.max(seq).alias(seq)).select(right.columns)
    return left.join(newest, list(keys), "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: the cardinality check of a validated join."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def covered_by_fallback(primary: DataFrame, fallback: DataFrame, key: str = "code") -> DataFrame:
    """Primary rows, plus fallback rows for keys the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def common_sessions(scores: DataFrame, prices: DataFrame, benchmark: DataFrame, min_codes: int = 5) -> DataFrame:
    """Dates with enough scored and priced names and an index level."""
    def busy(df: DataFrame) -> DataFrame:
        return (
            df.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= min_codes).select("date")
        )

    return (
        busy(scores)
        .join(busy(prices), "date", "left_semi")
        .join(benchmark.select("date").distinct(), "date", "left_semi")
    )


def balanced_dates(panel: DataFrame) -> DataFrame:
    """Dates on which every code of the panel has a row."""
    total = panel.agg(F.countDistinct("code").alias("_all"))
    per_date = panel.groupBy("date").agg(F.countDistinct("code").alias("_n"))
    return per_date.join(F.broadcast(total), F.col("_n") == F.col("_all")).select("date")
