"""Shared shaping of query results and composition of the checking SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimals kept below and from 1000 on: about nine significant digits either way.
DIGITS, LARGE, LARGE_DIGITS = 6, 1000, 2
# Moves exact decimal ties off the rounding boundary, the same way in both engines.
NUDGE = 1.000000000001


def rounded(x):
    """Rounding in plain double arithmetic; ``round`` goes through a decimal per value."""
    scale = F.when(F.abs(x) < LARGE, F.lit(10.0**DIGITS)).otherwise(F.lit(10.0**LARGE_DIGITS))
    r = F.rint(x * scale) / scale
    return F.when(r == 0, F.lit(0.0)).otherwise(r)  # no negative zero


def tidy(df: DataFrame) -> DataFrame:
    """Integers become bigint and doubles are rounded, as in the SQL of ``ask``."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double") * F.lit(NUDGE))
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(registry: dict, name: str, text: tuple[str, ...] = ()):
    """Register a query; its result is tidied. Columns in ``text`` become strings."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            df = tidy(fn(spark, sf_dir))
            return df.withColumns({c: F.col(c).cast("string") for c in text}) if text else df

        registry[name] = run
        return fn

    return wrap


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def _resolve(names, seen: list[str]) -> None:
    for name in names:
        if name not in seen:
            _resolve(CTES[name][1], seen)
            if name not in seen:
                seen.append(name)


def ask(needs: str, body: str, columns: str) -> str:
    """``WITH`` the needed parts, run ``body`` and shape the columns.

    A column ``x`` passes through, ``r:x`` is rounded, ``i:x`` is a bigint, ``s:x`` text.
    """
    order: list[str] = []
    _resolve(needs.split(), order)
    shaped = []
    for item in columns.split():
        kind, _, name = item.rpartition(":")
        if kind == "r":
            half = 0.5 * 10**-DIGITS
            x = f"CAST({name} AS DOUBLE) * CAST({NUDGE!r} AS DOUBLE)"
            shaped.append(
                f"CASE WHEN abs({name}) < {half:.10f} THEN CAST(0 AS DOUBLE) WHEN abs({x}) < {LARGE} "
                f"THEN round({x}, {DIGITS}) ELSE round({x}, {LARGE_DIGITS}) END AS {name}"
            )
        elif kind == "i":
            shaped.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "s":
            shaped.append(f"CAST({name} AS VARCHAR) AS {name}")
        else:
            shaped.append(name)
    parts = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    head = f"WITH {parts}\n" if parts else ""
    return f"{head}SELECT {', '.join(shaped)} FROM ({body}) answer"


def full(agg: str, x: str, n: int) -> str:
    """Rolling aggregate over a full window of n rows per code."""
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


H = "OVER (PARTITION BY code ORDER BY date)"

_CODE = "CASE WHEN length({k}) < 6 THEN lpad({k}, 6, '0') ELSE {k} END"


def code_of(key: str) -> str:
    return _CODE.format(k=f"CAST({key} AS VARCHAR)")


def week_of(ts: str) -> str:
    return f"CAST(date_trunc('week', {ts}) AS DATE)"


cte(
    "trades",
    f"""
    SELECT {code_of('l_suppkey')} AS code, {week_of('l_shipdate')} AS date,
           100 + l_extendedprice / l_quantity / 1000 AS price, l_quantity AS quantity,
           l_extendedprice AS amount,
           row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq
    FROM lineitem""",
)
cte(
    "bars",
    """
    SELECT code, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, seq) AS close, sum(quantity) AS volume, sum(amount) AS amount,
           sum(quantity) / 1024 AS turnover
    FROM trades GROUP BY code, date""",
    "trades",
)
cte(
    "bench",
    f"""SELECT {week_of('o_orderdate')} AS date, 1000 + avg(o_totalprice) / 1000 AS close
    FROM orders GROUP BY 1""",
)
cte(
    "benches",
    f"""SELECT o_orderpriority AS index_code, {week_of('o_orderdate')} AS date,
           1000 + avg(o_totalprice) / 1000 AS close FROM orders GROUP BY 1, 2""",
)
cte(
    "universe",
    f"""
    SELECT {code_of('s_suppkey')} AS code, s_name AS name, coalesce(n_name, 'Unknown') AS industry,
           coalesce(r_name, 'Unknown') AS sector
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "changes",
    f"""
    SELECT *, lag(close) {H} AS prev_close, close / lag(close) {H} - 1 AS ret_1,
           volume / lag(volume) {H} - 1 AS volume_change, amount / lag(amount) {H} - 1 AS amount_change
    FROM bars""",
    "bars",
)
cte(
    "scoring",
    f"""
    SELECT date, code, open, high, low, close, volume, amount, prev_close, ret_1,
           close / lag(close, 5) {H} - 1 AS momentum_5,
           close / lag(close, 20) {H} - 1 AS momentum_20,
           close / lag(close, 60) {H} - 1 AS momentum_60,
           close / ({full('avg', 'close', 20)}) - 1 AS trend_20,
           close / ({full('avg', 'close', 60)}) - 1 AS trend_60,
           {full('stddev_samp', 'ret_1', 20)} AS volatility,
           {full('avg', 'amount', 20)} AS liquidity,
           {full('avg', 'turnover', 20)} AS turnover,
           close / ({full('max', 'close', 60)}) - 1 AS drawdown
    FROM changes""",
    "changes",
)

SCORING = (
    "momentum_5 momentum_20 momentum_60 trend_20 trend_60 volatility liquidity turnover drawdown"
).split()
