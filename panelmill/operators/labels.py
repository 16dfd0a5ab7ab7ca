"""Forward-looking labels, rebalance calendars, splits and past-only calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_code, ratio
from ..functions.groups import stored, with_group_stats
from .joins import asof_join


def in_calendar():
    """Order of a table with one row per session; cheap at any scale."""
    return Window.orderBy("date")


def calendar(dates: DataFrame) -> DataFrame:
    """``date, idx`` with idx counting sessions from 0."""
    return dates.select("date").distinct().withColumn("idx", F.row_number().over(in_calendar()) - 1)


def forward_return(panel: DataFrame, h: int, out: str = "future_return") -> DataFrame:
    """Return over the next h observations of the code (L1)."""
    return panel.withColumn(out, ratio(F.lead("close", h).over(by_code()), "close") - 1)


def cross_section_excess(panel: DataFrame, label: str = "future_return", out: str = "label") -> DataFrame:
    """Label minus its date mean (L2)."""
    df = with_group_stats(stored(panel), ("date",), {"_mean": F.avg(label)})
    return df.withColumn(out, F.col(label) - F.col("_mean")).drop("_mean")


def benchmark_excess(panel: DataFrame, benchmark: DataFrame, h: int) -> DataFrame:
    """Own forward return minus that of the index (L3); the index is one row per session."""
    index = benchmark.select(
        "date",
        (ratio(F.lead("close", h).over(in_calendar()), "close") - 1).alias("benchmark_future_return"),
    )
    df = forward_return(panel, h).join(F.broadcast(index), "date", "left")
    return df.withColumn(
        "future_excess_return", F.col("future_return") - F.col("benchmark_future_return")
    )


def rebalance_events(dates: DataFrame, every: int, start: int = 0) -> DataFrame:
    """Every k-th session as signal with its entry and exit session.

    ``event, signal_date, entry_date, exit_date``; exit is NULL at the end of the calendar.
    """
    cal = calendar(dates)
    w = Window.orderBy("idx")
    events = cal.select(
        "idx",
        F.col("date").alias("signal_date"),
        F.lead("date", 1).over(w).alias("entry_date"),
        F.lead("date", every + 1).over(w).alias("exit_date"),
    )
    return events.filter(
        (F.col("idx") >= start) & ((F.col("idx") - start) % every == 0) & F.col("entry_date").isNotNull()
    ).select(((F.col("idx") - start) / every).cast("int").alias("event"), "idx", "signal_date", "entry_date", "exit_date")


def weekly_sessions(dates: DataFrame) -> DataFrame:
    """First session of each Saturday-to-Friday week."""
    week = F.date_trunc("week", F.date_add("date", 2)).cast("date")
    return dates.select("date").distinct().groupBy(week.alias("week")).agg(F.min("date").alias("date")).select("date")


def event_labels(
    scores: DataFrame, prices: DataFrame, events: DataFrame, score: str = "composite_score"
) -> DataFrame:
    """Open-to-open return of each scored name over one rebalance period (L4).

    ``signal_date, exit_date, code, score, future_return``. The event table has one row per
    rebalance, so it is broadcast; the two price lookups share the partitioning on code.
    """
    closed = F.broadcast(events.filter(F.col("exit_date").isNotNull()))
    day = scores.join(closed, scores.date == closed.signal_date).select(
        "event", "signal_date", "entry_date", "exit_date", "code", F.col(score).alias("score")
    )
    opens = prices.filter(F.col("open") > 0)
    entry = opens.select("code", F.col("date").alias("entry_date"), F.col("open").alias("entry_price"))
    exit_ = opens.select("code", F.col("date").alias("exit_date"), F.col("open").alias("exit_price"))
    both = day.join(entry, ["code", "entry_date"]).join(exit_, ["code", "exit_date"])
    return both.filter(F.col("score").isNotNull()).select(
        "event", "signal_date", "exit_date", "code", "score",
        (F.col("exit_price") / F.col("entry_price") - 1).alias("future_return"),
    )


def calibration(
    labels: DataFrame,
    signals: DataFrame,
    min_obs: int = 30,
    lower: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Past-only straight line score -> return for every signal date.

    Only labels with ``exit_date < signal_date`` count, and with ``lower`` (a column of
    ``signals``) only those signalled on or after it. Labels shrink to one row of moments
    per event; running totals of these rows are an index in time. A signal reads the totals
    as of the last exit before it and, with ``lower``, as of the last signal before that, and
    takes the difference: two as-of lookups, no range join. Labels of a later signal must not
    leave earlier, as on any rebalance grid.

    Adds ``n_obs, training_end, intercept, slope`` to ``signals``; the line is NULL with
    fewer than ``min_obs`` labels or a single distinct score. ``keys`` separate scenarios.
    """
    index = moment_index(labels, keys)
    totals = [c for c in index.columns if c not in (*keys, "_sig", "_exit", "_closes", "_opens")]
    upper, under = {c: f"_u{c}" for c in [*totals, "_exit"]}, {c: f"_l{c}" for c in totals}
    closed = index.filter("_closes").select(*keys, F.col("_exit").alias("_at"), *[F.col(c).alias(x) for c, x in upper.items()])
    table = asof_join(signals, closed, keys, "signal_date", "_at", list(upper.values()), strict=True)
    if lower is None:
        table = table.withColumns({x: F.lit(None).cast(index.schema[c].dataType) for c, x in under.items()})
    else:
        opened = index.filter("_opens").select(*keys, F.col("_sig").alias("_at"), *[F.col(c).alias(x) for c, x in under.items()])
        table = asof_join(table, opened, keys, lower, "_at", list(under.values()), strict=True)
    # What is excluded ends no later than what is known.
    some = F.coalesce(F.col("_u_pos") > F.coalesce("_l_pos", F.lit(0)), F.lit(False))

    def within(c: str) -> Column:
        return F.when(some, F.col(upper[c]) - F.coalesce(F.col(under[c]), F.lit(0)))

    varies = (within("_mixed") > 0) | (F.col("_u_turns") > F.coalesce("_l_next_turns", F.lit(0)))
    fit = table.select(
        *signals.columns,
        F.coalesce(within("_n"), F.lit(0)).alias("n_obs"),
        F.when(some, F.col("_u_exit")).alias("training_end"),
        *[within(c).alias(c) for c in ("_sx", "_sy", "_sxy", "_sxx")],
        F.when(some, varies).alias("_varies"),
    )
    slope = (F.col("n_obs") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.nullif(
        F.col("n_obs") * F.col("_sxx") - F.col("_sx") * F.col("_sx"), F.lit(0.0)
    )
    fit = fit.withColumn("slope", F.when((F.col("n_obs") >= min_obs) & F.col("_varies"), slope))
    return fit.withColumn(
        "intercept", (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("n_obs")
    ).select(*signals.columns, "n_obs", "training_end", "intercept", "slope")


def moment_index(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running moments of labels in order of time, one row per event.

    ``_n, _sx, _sy, _sxy, _sxx`` are totals up to the row, ``_pos`` its place. ``_mixed``
    counts rows with several scores and ``_turns`` changes of score from row to row, so a
    difference of two rows tells whether scores vary in between. ``_closes`` and ``_opens``
    mark the last row of an exit and of a signal date.
    """
    x, y = F.col("score"), F.col("future_return")
    sums = {"_n": F.count(F.lit(1)), "_sx": F.sum(x), "_sy": F.sum(y), "_sxy": F.sum(x * y), "_sxx": F.sum(x * x)}
    events = labels.groupBy(*keys, F.col("signal_date").alias("_sig"), F.col("exit_date").alias("_exit")).agg(
        *[agg.alias(name) for name, agg in sums.items()], F.min("score").alias("_lo"), F.max("score").alias("_hi")
    )
    order = Window.partitionBy(*keys).orderBy("_exit", "_sig")
    turn = F.coalesce(F.col("_lo") != F.lag("_hi").over(order), F.lit(False))
    events = events.withColumns({"_mixed": (F.col("_lo") < F.col("_hi")).cast("long"), "_turns": turn.cast("long")})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = events.select(
        *keys, "_sig", "_exit",
        *[F.sum(c).over(so_far).alias(c) for c in (*sums, "_mixed", "_turns")],
        F.row_number().over(order).alias("_pos"),
    )
    return totals.withColumns(
        {
            "_next_turns": F.lead("_turns").over(order),
            "_closes": F.coalesce(F.lead("_exit").over(order) != F.col("_exit"), F.lit(True)),
            "_opens": F.coalesce(F.lead("_sig").over(order) != F.col("_sig"), F.lit(True)),
        }
    )


def ordered_split(
    dates: DataFrame, train: float = 0.6, validation: float = 0.2, purge: int = 20
) -> DataFrame:
    """``date, part`` over whole dates with a purge gap after train and validation."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation ratios must be positive and sum to less than one")
    cal = calendar(dates).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_valid = F.floor(F.col("_n") * F.lit(validation))
    i = F.col("idx")
    part = (
        F.when(i < n_train, "train")
        .when((i >= n_train + purge) & (i < n_train + purge + n_valid), "validation")
        .when(i >= n_train + 2 * purge + n_valid, "test")
    )
    return cal.select("date", part.alias("part")).filter(F.col("part").isNotNull())


def purged_split(
    dates: DataFrame, train: float, validation: float, purge: int = 0
) -> DataFrame:
    """The second split variant: fixed cut points, purge before each cut."""
    cal = calendar(dates).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    n, i = F.col("_n"), F.col("idx")
    a0 = F.greatest(F.lit(2), F.floor(n * F.lit(train)))
    b = F.least(F.greatest(a0 + 2, F.floor(n * F.lit(train + validation))), n - 2)
    a = F.least(a0, n - 4)
    part = (
        F.when(i < F.greatest(F.lit(1), a - purge), "train")
        .when((i >= a) & (i < F.greatest(a + 1, b - purge)), "validation")
        .when(i >= b, "test")
    )
    return cal.select("date", part.alias("part")).filter(F.col("part").isNotNull())


def rolling_periods(
    dates: DataFrame,
    train_years: int = 3,
    validation_months: int = 6,
    test_months: int = 6,
    step_months: int = 6,
) -> DataFrame:
    """Rolling train / validation / test spans with the dates each holds.

    ``period, part, start_date, end_date, sessions``: parts are half-open month spans from
    the first date; numbering stops at the first period with an empty part.
    """
    span = dates.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    total = train_years * 12 + validation_months + test_months
    steps = F.sequence(
        F.lit(0),
        F.greatest(F.lit(0), F.ceil(F.months_between("last", "first") / step_months).cast("int")),
    )
    starts = span.select("last", "first", F.explode(steps).alias("period")).withColumn(
        "_start", F.add_months("first", F.col("period") * step_months)
    )
    cuts = [0, train_years * 12, train_years * 12 + validation_months, total]
    spans = F.array(
        *[
            F.struct(
                F.lit(name).alias("part"),
                F.add_months("_start", F.lit(cuts[i])).alias("lo"),
                F.add_months("_start", F.lit(cuts[i + 1])).alias("hi"),
            )
            for i, name in enumerate(("train", "validation", "test"))
        ]
    )
    parts = starts.select("period", F.explode(spans).alias("s")).select("period", "s.*")
    days = dates.select("date").distinct()
    held = (
        F.broadcast(parts)
        .join(days, (F.col("date") >= F.col("lo")) & (F.col("date") < F.col("hi")), "left")
        .groupBy("period", "part")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("date").alias("sessions"))
    )
    empty = held.filter(F.col("sessions") == 0).agg(F.min("period").alias("_gap"))
    return (
        held.join(F.broadcast(empty))
        .filter(F.col("_gap").isNull() | (F.col("period") < F.col("_gap")))
        .drop("_gap")
    )


def chronology_breaks(parts: DataFrame, order: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Periods whose parts overlap in time (L9); empty when the order holds."""
    def edge(fn, column: str, part: str) -> Column:
        return fn(F.when(F.col("part") == part, F.col(column)))

    checks = [
        edge(F.max, "end_date", a) >= edge(F.min, "start_date", b) for a, b in zip(order, order[1:])
    ]
    bad = checks[0]
    for c in checks[1:]:
        bad = bad | c
    return parts.groupBy("period").agg(bad.alias("overlap")).filter("overlap")
