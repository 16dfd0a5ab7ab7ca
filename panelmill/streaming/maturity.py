"""Label maturity as a stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matured_labels(
    decisions: DataFrame, exits: DataFrame, horizon: str = "3 days", late: str = "1 day"
) -> DataFrame:
    """Decisions joined with the prices of their code inside the horizon (ST4).

    ``decisions``: ``decision_id, code, decided_at, entry_price``; ``exits``: ``exit_code,
    exit_at, exit_price``. Watermarks on both sides bound the state to the horizon.
    """
    left = decisions.withWatermark("decided_at", late)
    right = exits.withWatermark("exit_at", late)
    due = (
        (F.col("code") == F.col("exit_code"))
        & (F.col("exit_at") > F.col("decided_at"))
        & (F.col("exit_at") <= F.col("decided_at") + F.expr(f"INTERVAL {horizon}"))
    )
    return left.join(right, due, "inner").select(
        "decision_id", "code", "decided_at", "exit_at", "entry_price", "exit_price",
        (F.col("exit_price") / F.col("entry_price") - 1).alias("future_return"),
    )
