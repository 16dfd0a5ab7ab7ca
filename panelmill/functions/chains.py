"""Chains of successors in a table, without walking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import durable

# Fixed value: positions in one bitmap of the aggregates below.
BLOCK = 32768


def on_chain(links: DataFrame, keys: Sequence[str], node: str, after: str) -> DataFrame:
    """``keys, node`` of the rows on the chain from the least node of each key.

    Pointer jumping: after k rounds the nodes within 2**k steps are found, and every row
    knows the node 2**k steps on. A round is two equi-joins on (keys, node), so a chain of n
    rows takes log2(n) rounds and no group is walked. ``after`` is greater than ``node``;
    a NULL, or a node without a row, ends the chain.
    """
    steps = durable(links.select(*keys, node, after))
    found = durable(steps.groupBy(*keys).agg(F.min(node).alias(node)))
    present = steps.select(*keys, F.col(node).alias("_there"))
    while True:
        ahead = found.join(steps, [*keys, node]).select(*keys, F.col(after).alias("_there"))
        ahead = durable(ahead.join(present, [*keys, "_there"], "left_semi").withColumnRenamed("_there", node))
        if ahead.isEmpty():
            return found
        found = durable(found.union(ahead))
        further = steps.select(*keys, F.col(node).alias(after), F.col(after).alias("_further"))
        steps = durable(steps.join(further, [*keys, after]).select(*keys, node, F.col("_further").alias(after)))


def positions_bitmap(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """``keys, _block, _bits``: the positions (0 and up) present for each key as bitmaps."""
    return (
        df.select(*keys, F.floor(F.col(position) / BLOCK).cast("long").alias("_block"), (F.col(position) % BLOCK).cast("long").alias("_bit"))
        .groupBy(*keys, "_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )


def first_position(bits: Column, block: Column, low: Column, high: Column) -> Column:
    """The least position from ``low`` to ``high`` that is set in a block's bitmap, or NULL."""
    start = F.greatest(low, block * BLOCK)
    end = F.least(high, block * BLOCK + BLOCK - 1)
    octet = lambda at: F.ascii(F.decode(F.substring(bits, (at % BLOCK / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    is_set = lambda at: F.call_function("shiftright", octet(at), (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(start <= end, F.get(F.filter(F.sequence(start, end), is_set), F.lit(0)))
