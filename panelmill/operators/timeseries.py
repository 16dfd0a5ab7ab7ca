"""Per-instrument rolling factors.

All factors requested together share one exchange on ``code`` and one sort on ``date``:
the first projection derives the one-session changes, the second evaluates every frame.
Factors are NULL until their window is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_code, finite, lagged, ratio, require_columns, rolling, trailing

# Sessions per year used to annualise.
SESSIONS_PER_YEAR = 252

FactorFn = Callable[[], Column]


# Window lengths built from one another: each is a multiple of the one before.
BLOCKS = (5, 20, 60, 120)
# Inputs whose means come from block sums.
TOTALLED = ("close", "amount", "volume", "turnover", "ret_1")
PRICES = ("open", "high", "low", "close", "volume", "amount", "turnover")


def finite_bars(bars: DataFrame) -> DataFrame:
    """NaN and infinities of the bar columns become NULL, so they count as missing sessions
    of their windows and of no other."""
    return bars.withColumns({x: finite(x) for x in PRICES if x in bars.columns and _is_real(bars, x)})


def _is_real(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("double", "float")


def with_changes(bars: DataFrame) -> DataFrame:
    """Add one-session lags, returns and the block statistics that the factors read.

    A window of 120 rows is two of 60, one of 60 is three of 20, one of 20 is four of 5: sums
    add up along that ladder by lags over one sort, so the cost of a window does not grow with
    its length. Nothing is ever subtracted: a missing, non-finite or extreme value touches the
    windows that hold it and leaves with them. Unused columns are pruned by the optimizer.
    """
    bars = finite_bars(bars)
    df = bars.withColumns(
        {
            "prev_close": lagged("close"),
            "ret_1": ratio("close", lagged("close")) - 1,
            "volume_change": ratio("volume", lagged("volume")) - 1,
            "amount_change": ratio("amount", lagged("amount")) - 1,
        }
    )
    return with_blocks(df, [x for x in TOTALLED if x in df.columns], {"ret_1": ("ret_1", "ret_1")})


def with_blocks(df: DataFrame, sums: Sequence[str], products: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Block statistics over the last n rows for every n of BLOCKS, NULL unless all are present.

    ``_s{n}_{x}``: sum of x. ``_c{n}_{name}``: sum of (a - mean a)(b - mean b) for the columns
    (a, b) of a product, merged from shorter blocks by the spread of their means; a and b must
    be among ``sums`` and NULL in the same rows.
    """
    w, b = trailing(BLOCKS[0]), BLOCKS[0]
    level = {f"_s{b}_{x}": F.when(F.count(x).over(w) == b, F.sum(x).over(w)) for x in sums}
    for name, (x, y) in products.items():
        level[f"_c{b}_{name}"] = F.when(F.count(x).over(w) == b, F.covar_pop(x, y).over(w) * b)
    df = df.withColumns(level)
    for small, big in zip(BLOCKS, BLOCKS[1:], strict=False):
        parts = range(big // small)
        back = lambda c, k, small=small: F.lag(c, k * small).over(by_code()) if k else F.col(c)
        df = df.withColumns({f"_s{big}_{x}": sum((back(f"_s{small}_{x}", k) for k in parts), F.lit(0.0)) for x in sums})
        level = {}
        for name, (x, y) in products.items():
            inside = sum((back(f"_c{small}_{name}", k) for k in parts), F.lit(0.0))
            apart = [(back(f"_s{small}_{c}", k) / small - F.col(f"_s{big}_{c}") / big) for k in parts for c in (x, y)]
            between = sum((u * v for u, v in zip(apart[::2], apart[1::2], strict=True)), F.lit(0.0))
            level[f"_c{big}_{name}"] = inside + between * small
        df = df.withColumns(level)
    return df


def mean_of(name: str, n: int) -> Column:
    """Rolling mean, NULL until n values are present."""
    return F.col(f"_s{n}_{name}") / n if n in BLOCKS else rolling(F.avg, name, n)


def momentum(n: int) -> Column:
    return ratio("close", lagged("close", n)) - 1


def trend(n: int) -> Column:
    return ratio("close", mean_of("close", n)) - 1


def volatility(n: int) -> Column:
    """Sample deviation of the last n returns."""
    return F.sqrt(F.col(f"_c{n}_ret_1") / (n - 1)) if n in BLOCKS else rolling(F.stddev_samp, "ret_1", n)


def drawdown(n: int) -> Column:
    return ratio("close", rolling(F.max, "close", n)) - 1


def volume_ratio(n: int) -> Column:
    return ratio("volume", mean_of("volume", n))


def rsi(n: int = 14) -> Column:
    """Simple-mean relative strength; 100 when there was no loss."""
    gain = rolling(F.avg, F.when(F.col("ret_1").isNotNull(), F.greatest("ret_1", F.lit(0.0))), n)
    loss = rolling(F.avg, F.when(F.col("ret_1").isNotNull(), F.greatest(-F.col("ret_1"), F.lit(0.0))), n)
    return F.when(loss == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + ratio(gain, loss)))


def bollinger_position(n: int = 20, width: float = 2.0) -> Column:
    """Place of the close inside mean +/- width population deviations."""
    mean, std = rolling(F.avg, "close", n), rolling(F.stddev_pop, "close", n)
    band = 2 * width * std
    flat = rolling(F.max, "close", n) == rolling(F.min, "close", n)
    return F.when(~flat, (F.col("close") - (mean - width * std)) / F.nullif(band, F.lit(0.0)))


def true_range() -> Column:
    # greatest skips NULL, so the first session falls back to high - low.
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.col("prev_close")),
        F.abs(F.col("low") - F.col("prev_close")),
    )


def atr(n: int = 14) -> Column:
    return rolling(F.avg, true_range(), n)


def volatility_breakout(n: int = 20) -> Column:
    return ratio("close", rolling(F.max, "high", n)) - 1


def with_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Join the index returns and add the co-moments that the betas read.

    The index has one row per session, so it is broadcast.
    """
    df = panel.join(F.broadcast(market_returns(market)), "date", "left")
    both = F.col("ret_1").isNotNull() & F.col("market_return").isNotNull()
    df = df.withColumns({"_r": F.when(both, F.col("ret_1")), "_m": F.when(both, F.col("market_return"))})
    return with_blocks(df, ["_r", "_m"], {"rm": ("_r", "_m"), "mm": ("_m", "_m")})


def beta(n: int) -> Column:
    """Rolling covariance over market variance (population), full windows only."""
    variance, mean = F.col(f"_c{n}_mm") / n, F.col(f"_s{n}__m") / n
    # A market that does not move leaves rounding noise.
    moves = variance > (variance + mean * mean) * 1e-13
    return F.when(moves, F.col(f"_c{n}_rm") / n / variance)


FACTORS: dict[str, FactorFn] = {
    "ret_1": lambda: F.col("ret_1"),
    "momentum_5": lambda: momentum(5),
    "momentum_20": lambda: momentum(20),
    "momentum_60": lambda: momentum(60),
    "momentum_120": lambda: momentum(120),
    "trend_20": lambda: trend(20),
    "trend_60": lambda: trend(60),
    "trend_120": lambda: trend(120),
    "volatility_20": lambda: volatility(20),
    "volatility_60": lambda: volatility(60),
    "annual_volatility_20": lambda: volatility(20) * math.sqrt(SESSIONS_PER_YEAR),
    "liquidity_20": lambda: mean_of("amount", 20),
    "log_liquidity_20": lambda: F.log1p(mean_of("amount", 20)),
    "volume_ratio_20": lambda: volume_ratio(20),
    "volume_ratio": lambda: volume_ratio(20),
    "turnover_5": lambda: mean_of("turnover", 5),
    "turnover_20": lambda: mean_of("turnover", 20),
    "drawdown_60": lambda: drawdown(60),
    "drawdown_depth_60": lambda: -drawdown(60),
    "max_drawdown_60": lambda: drawdown(60),
    "max_drawdown_120": lambda: drawdown(120),
    "rsi_14": rsi,
    "bollinger_position": bollinger_position,
    "atr_14": atr,
    "volatility_breakout_20": volatility_breakout,
    "turnover_ma20": lambda: mean_of("turnover", 20),
    "amount_ma20": lambda: mean_of("amount", 20),
    "volume_change": lambda: F.col("volume_change"),
    "amount_change": lambda: F.col("amount_change"),
    "beta_60": lambda: beta(60),
    "beta_120": lambda: beta(120),
    "macd": lambda: F.col("macd"),
    "macd_signal": lambda: F.col("macd_signal"),
    "macd_histogram": lambda: F.col("macd_histogram"),
}
MACD_COLUMNS = frozenset({"macd", "macd_signal", "macd_histogram"})

# Names of the standard scoring set, as logical factor -> column here.
SCORING_FACTORS: dict[str, str] = {
    "momentum_5": "momentum_5",
    "momentum_20": "momentum_20",
    "momentum_60": "momentum_60",
    "trend_20": "trend_20",
    "trend_60": "trend_60",
    "volatility": "volatility_20",
    "liquidity": "liquidity_20",
    "turnover": "turnover_20",
    "drawdown": "drawdown_60",
}

# The broad research set.
RESEARCH_FACTORS: tuple[str, ...] = (
    "momentum_5", "momentum_20", "momentum_60", "momentum_120",
    "trend_20", "trend_60", "trend_120",
    "volatility_20", "volatility_60", "atr_14", "rsi_14", "macd",
    "turnover_5", "turnover_20", "amount_change", "volume_ratio",
    "beta_60", "beta_120", "max_drawdown_60", "max_drawdown_120",
)


def register_factor(name: str, fn: FactorFn) -> None:
    """Add a factor (U1): ``fn`` returns a Column over the panel of ``with_changes``,
    usually built with ``rolling``, ``lagged`` and ``ratio``."""
    if not name:
        raise ValueError("a factor needs a name")
    FACTORS[name] = fn


def build_factors(
    bars: DataFrame,
    names: Iterable[str] | Mapping[str, str],
    market: DataFrame | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """``date, code, <keep>, <factors>`` for an enabled list.

    ``names`` may map output name -> factor. ``market`` is ``date, close`` of an index,
    needed by the betas; it has one row per session and is broadcast.
    """
    wanted = dict(names) if isinstance(names, Mapping) else {n: n for n in names}
    unknown = sorted(set(wanted.values()) - set(FACTORS))
    if unknown:
        raise ValueError(f"unknown factor(s): {', '.join(unknown)}")
    require_columns(bars, "date", "code", "close", *keep)
    panel = with_changes(macd(finite_bars(bars)) if MACD_COLUMNS & set(wanted.values()) else bars)
    if market is not None:
        panel = with_market(panel, market)
    return panel.select(
        "date", "code", *keep, *[FACTORS[f]().alias(out) for out, f in wanted.items()]
    )


def market_returns(market: DataFrame) -> DataFrame:
    """``date, market_return`` of an index; one row per session."""
    w = Window.orderBy("date")
    return market.select("date", (ratio("close", F.lag("close").over(w)) - 1).alias("market_return"))


def ema(df: DataFrame, x: str, span: int, out: str, block: int = 512) -> DataFrame:
    """Exponential mean y = a x + (1 - a) y', a = 2 / (span + 1), first value as seed,
    NULL before ``span`` observations. Rows without a value are skipped and stay NULL.

    The recursion is a weighted prefix sum. Weights are rebased every ``block`` rows so
    they cannot overflow; a value two blocks back carries (1 - a) ** block, below double
    precision, so the carry of the previous block is enough.
    """
    a = 2.0 / (span + 1)
    q = 1.0 - a
    if block * -math.log(q) < 37:
        raise ValueError("block too short for this span")
    # Partition by presence as well, so leading NULL rows do not take positions.
    seen = f"_{out}_seen"
    hist = Window.partitionBy("code", seen).orderBy("date")
    pos, blk, local, tail = (f"_{out}_{k}" for k in ("pos", "blk", "local", "tail"))
    within = (
        Window.partitionBy("code", seen, blk)
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    step = df.withColumn(seen, F.col(x).isNotNull())
    step = step.withColumn(pos, F.row_number().over(hist) - 1)
    step = step.withColumn(blk, F.floor(F.col(pos) / block)).withColumn(pos, F.col(pos) % block)
    first = (F.col(pos) == 0) & (F.col(blk) == 0)
    weight = F.when(first, 1.0).otherwise(a) * F.pow(F.lit(q), -F.col(pos))
    step = step.withColumn(
        local, F.sum(F.col(x) * weight).over(within) * F.pow(F.lit(q), F.col(pos))
    )
    step = step.withColumn(
        tail,
        F.last(F.when(F.col(pos) == block - 1, F.col(local)), ignorenulls=True).over(
            hist.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    value = F.col(local) + F.coalesce(F.col(tail) * F.pow(F.lit(q), F.col(pos) + 1), F.lit(0.0))
    count = F.col(blk) * block + F.col(pos) + 1
    return step.withColumn(out, F.when(F.col(seen) & (count >= span), value)).drop(
        seen, pos, blk, local, tail
    )


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Add ``macd, macd_signal, macd_histogram``."""
    df = ema(ema(bars, "close", fast, "_fast"), "close", slow, "_slow")
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def breadth(bars: DataFrame, window: int = 20) -> DataFrame:
    """``date, breadth``: share of instruments above their own moving mean (F16)."""
    above = finite_bars(bars).select("date", (F.col("close") > rolling(F.avg, "close", window)).alias("_above"))
    return (
        above.filter(F.col("_above").isNotNull())
        .groupBy("date")
        .agg(F.avg(F.col("_above").cast("double")).alias("breadth"))
    )


def latest_breadth(bars: DataFrame, as_of: str, window: int = 20) -> DataFrame:
    """One row: breadth over the last bar of each instrument up to ``as_of``."""
    flagged = finite_bars(bars).filter(F.col("date") <= F.lit(as_of).cast("date")).select(
        "code", "date", (F.col("close") > rolling(F.avg, "close", window)).alias("_above")
    )
    last = flagged.groupBy("code").agg(F.max_by("_above", "date").alias("_above"))
    return last.agg(F.coalesce(F.avg(F.col("_above").cast("double")), F.lit(0.5)).alias("breadth"))


