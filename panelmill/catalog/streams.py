"""Streaming queries, each run to the end of its input."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.groups import durable, new_path
from ..sources import market
from ..streaming import bars as sb
from ..streaming.maturity import matured_labels
from ..streaming.state import rocksdb, running_state
from .kit import ask, cte, query

QUERIES: dict = {}
SQL: dict = {}


def _events(spark, sf_dir):
    schema = market.table(spark, sf_dir, "events").schema
    stream = sb.file_stream(spark, sf_dir, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


# ---------------------------------------------------------------- windows over late ticks

RUNS = 4
LATE = "2 hours"


def deliveries(spark, sf_dir):
    """Ticks in four deliveries by day; one in 40 comes a delivery late, one in 97 two."""
    events = market.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.min(F.to_date("ts")).alias("first"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"))
    late = F.when(F.col("event_id") % 97 == 0, 2).when(F.col("event_id") % 40 == 0, 1).otherwise(0)
    turn = F.floor(F.datediff(F.to_date("ts"), F.col("first")) * RUNS / F.col("days")) + late
    ticks = events.join(F.broadcast(first)).select(
        market.pad_code("user_id").alias("code"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.lit(1.0).alias("quantity"), F.least(turn, F.lit(RUNS - 1)).alias("turn"),
    )
    ticks = durable(ticks)
    return [ticks.filter(F.col("turn") == k).drop("turn") for k in range(RUNS)]


@query(QUERIES, "stream_tumbling_bars")
def stream_tumbling_bars(spark, sf_dir):
    df = sb.emitted(deliveries(spark, sf_dir), lambda ticks: sb.tumbling_bars(ticks, late=LATE))
    return df.withColumn("start", F.col("start").cast("date"))


_USER = "CASE WHEN length(CAST(user_id AS VARCHAR)) < 6 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE CAST(user_id AS VARCHAR) END"
# A delivery finds closed what lies two hours before the newest tick of the earlier ones.
cte(
    "delivered",
    f"""SELECT *, least({RUNS - 1}, (CAST(ts AS DATE) - first) * {RUNS} // days
          + CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS turn
        FROM events, (SELECT CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1 AS days FROM events)""",
)
cte(
    "bounds",
    f"""SELECT t.turn, max(d.ts) - INTERVAL 2 HOUR AS closed FROM range(0, {RUNS + 1}) t(turn) LEFT JOIN delivered d ON d.turn < t.turn GROUP BY 1""",
    "delivered",
)
_OPEN = "(closed IS NULL OR finish > closed)"
SQL["stream_tumbling_bars"] = ask(
    "delivered bounds",
    f"""SELECT CAST(ts AS DATE) AS start, {_USER} AS code, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount
        FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS finish FROM delivered) JOIN bounds USING (turn)
        WHERE {_OPEN} AND finish <= (SELECT closed FROM bounds WHERE turn = {RUNS}) GROUP BY 1, 2""",
    "start code r:open r:high r:low r:close r:volume r:amount",
)


@query(QUERIES, "stream_sliding_mean")
def stream_sliding_mean(spark, sf_dir):
    df = sb.emitted(deliveries(spark, sf_dir), lambda ticks: sb.sliding_mean(ticks, late=LATE))
    return df.withColumn("start", F.col("start").cast("date"))


SQL["stream_sliding_mean"] = ask(
    "delivered bounds",
    f"""SELECT CAST(finish - INTERVAL 3 DAY AS DATE) AS start, {_USER} AS code, avg(value) AS mean_price, count(*) AS ticks
        FROM (SELECT *, date_trunc('day', ts) + (3 - k) * INTERVAL 1 DAY AS finish FROM delivered, range(0, 3) r(k)) JOIN bounds USING (turn)
        WHERE {_OPEN} AND finish <= (SELECT closed FROM bounds WHERE turn = {RUNS}) GROUP BY 1, 2""",
    "start code r:mean_price i:ticks",
)


@query(QUERIES, "stream_late_ticks")
def stream_late_ticks(spark, sf_dir):
    """Ticks that came after their day was closed, set aside and counted per code."""
    parts = deliveries(spark, sf_dir)
    path, files, state = (new_path(spark) for _ in range(3))
    sb.deliver(parts, lambda stream: sb.run_available(stream, sb.late_ticks(path, late=LATE), checkpoint=state), files)
    late = sb.set_aside(spark, path, parts[0].schema)
    return late.groupBy("code").agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("price"))


SQL["stream_late_ticks"] = ask(
    "delivered bounds",
    f"""SELECT {_USER} AS code, count(*) AS ticks, sum(value) AS price
        FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS finish FROM delivered) JOIN bounds USING (turn)
        WHERE NOT {_OPEN} GROUP BY 1""",
    "code i:ticks r:price",
)


# ---------------------------------------------------------------- reruns


@query(QUERIES, "stream_first_arrivals")
def stream_first_arrivals(spark, sf_dir):
    """The event feed doubled, a part of it again, and all of it a last time; every event counts once."""
    events = market.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, files, state = (new_path(spark) for _ in range(3))
    again = events.filter(F.dayofmonth("ts") <= 10)
    write = sb.first_arrivals(path, ["event_id"], ["ts"])
    sb.deliver([events.unionByName(events), again, events], lambda s: sb.run_available(s, write, checkpoint=state), files)
    once = spark.read.parquet(path)
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


SQL["stream_first_arrivals"] = ask(
    "", "SELECT event_type, count(*) AS events, sum(value) AS value FROM events GROUP BY 1", "event_type i:events r:value"
)


@query(QUERIES, "stream_bar_ingest")
def stream_bar_ingest(spark, sf_dir):
    """Bars land, then a later delivery doubles the volumes from 2000 on."""
    root = new_path(spark)
    bars = market.bars(spark, sf_dir)
    bars.write.parquet(f"{root}/landing")
    stream = sb.file_stream(spark, f"{root}/landing", bars.schema)
    sb.ingest(stream, f"{root}/log", f"{root}/state")
    late = bars.filter(F.col("date") >= "2000-01-01").withColumn("volume", F.col("volume") * 2)
    late.write.mode("append").parquet(f"{root}/landing")
    sb.ingest(stream, f"{root}/log", f"{root}/state")
    return sb.ingested(spark, f"{root}/log").select(*bars.columns)


SQL["stream_bar_ingest"] = ask(
    "bars",
    "SELECT * REPLACE (CASE WHEN date >= DATE '2000-01-01' THEN volume * 2 ELSE volume END AS volume) FROM bars",
    "code date r:open r:high r:low r:close r:volume r:amount r:turnover",
)


# ---------------------------------------------------------------- running state

# Deliveries end before these dates; weeks are counted from the first Monday of 1992.
ENDS = ("1995-01-01", "1998-01-01")
STATE_LATE = "35 days"


def bar_deliveries(spark, sf_dir):
    """Bars in three deliveries, some late by less than the bound and some by more, some
    without a close; a last row of no code moves the watermark past all of them."""
    bars = market.bars(spark, sf_dir).select("code", "date", "close")
    week = (F.datediff("date", F.lit("1992-01-06").cast("date")) / 7).cast("long") + F.col("code").cast("long")
    turn, left = F.lit(0), F.lit(None)
    for end in ENDS:
        day = F.lit(end).cast("date")
        turn = turn + (F.col("date") >= day).cast("int")
    for end in reversed(ENDS):
        left = F.when(F.col("date") < F.lit(end).cast("date"), F.datediff(F.lit(end).cast("date"), "date")).otherwise(left)
    late = F.when((left <= 28) & (week % 5 == 0), 1).when((left > 70) & (week % 61 == 0), 1).otherwise(0)
    bars = bars.select(
        "code", "date", F.lit(0).alias("seq"), F.when(week % 23 != 0, F.col("close")).alias("close"), (turn + late).alias("turn")
    )
    bars = durable(bars)
    parts = [bars.filter(F.col("turn") == k).drop("turn") for k in range(len(ENDS) + 1)]
    beat = bars.agg(F.max("date").alias("date")).select(
        F.lit("").alias("code"), F.date_add("date", 365).alias("date"), F.lit(0).alias("seq"), F.lit(None).cast("double").alias("close")
    )
    return [*parts, beat]


@query(QUERIES, "stream_running_state")
def stream_running_state(spark, sf_dir):
    with rocksdb(spark):
        rows = sb.emitted(bar_deliveries(spark, sf_dir), lambda bars: running_state(bars, late=STATE_LATE))
    return rows.filter(F.col("code") != "")


_SEEN = "FILTER (WHERE close IS NOT NULL)"
_RUN = "OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
_MEAN = f"list_reduce(list(close) {_SEEN} {_RUN}, lambda m, v: m * (1 - (2.0::DOUBLE / 13)) + v * (2.0::DOUBLE / 13))"
_BEHIND = f"CASE WHEN date < DATE '{ENDS[0]}' THEN DATE '{ENDS[0]}' - date WHEN date < DATE '{ENDS[1]}' THEN DATE '{ENDS[1]}' - date END"
cte(
    "state_turns",
    f"""SELECT code, date, CASE WHEN k % 23 <> 0 THEN close END AS close,
          CAST(date >= DATE '{ENDS[0]}' AS INT) + CAST(date >= DATE '{ENDS[1]}' AS INT)
          + CASE WHEN behind <= 28 AND k % 5 = 0 THEN 1 WHEN behind > 70 AND k % 61 = 0 THEN 1 ELSE 0 END AS turn
        FROM (SELECT *, (date - DATE '1992-01-06') // 7 + CAST(code AS BIGINT) AS k, {_BEHIND} AS behind FROM bars)""",
    "bars",
)
SQL["stream_running_state"] = ask(
    "state_turns",
    f"""WITH kept AS (
          SELECT code, date, close FROM state_turns t
          JOIN (SELECT g.turn, max(d.date) - 35 AS closed FROM range(0, 3) g(turn) LEFT JOIN state_turns d ON d.turn < g.turn GROUP BY 1) b USING (turn)
          WHERE closed IS NULL OR date > closed)
        SELECT code, date, close, CASE WHEN count(close) {_RUN} >= 12 THEN {_MEAN} END AS ema, max(close) {_RUN} AS peak,
          close / max(close) {_RUN} - 1 AS drawdown FROM kept""",
    "code date r:close r:ema r:peak r:drawdown",
)


@query(QUERIES, "stream_label_maturity")
def stream_label_maturity(spark, sf_dir):
    """Sign-ups as decisions, later purchases of the same user as exits."""
    events = _events(spark, sf_dir)
    code = market.pad_code("user_id")
    decisions = events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("decision_id"), code.alias("code"), F.col("ts").alias("decided_at"),
        (F.col("value") + 100).alias("entry_price"),
    )
    exits = events.filter(F.col("event_type") == "purchase").select(
        code.alias("exit_code"), F.col("ts").alias("exit_at"), (F.col("value") + 100).alias("exit_price")
    )
    df = sb.table_of(matured_labels(decisions, exits))
    return df.select("decision_id", "code", F.col("exit_at").cast("date").alias("exit_date"), "entry_price", "exit_price", "future_return")


SQL["stream_label_maturity"] = ask(
    "",
    f"""SELECT d.event_id AS decision_id, d.code, CAST(x.ts AS DATE) AS exit_date, d.value + 100 AS entry_price, x.value + 100 AS exit_price,
        (x.value + 100) / (d.value + 100) - 1 AS future_return
        FROM (SELECT *, {_USER} AS code FROM events WHERE event_type = 'signup') d
        JOIN (SELECT *, {_USER} AS code FROM events WHERE event_type = 'purchase') x
          ON x.code = d.code AND x.ts > d.ts AND x.ts <= d.ts + INTERVAL 3 DAY""",
    "decision_id code exit_date r:entry_price r:exit_price r:future_return",
)
