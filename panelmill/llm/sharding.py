"""Balanced label propagation: linked documents move towards their neighbours' shards.

A link is shared membership of a group (``members``: id, group), so a group of n documents
costs n rows and never its pairs. Linked documents start in equal shares over all shards. In
each round every document looks at where its groups' members are and asks for a shard that
holds many of them. Who leaves a shard makes room in it: what is admitted are cycles of moves
(swaps are the shortest) and paths to free room, largest groups first. A round counts if fewer
links are cut after it; after one that does not, groups ask for a shard with room for all of them,
then for any of theirs at random, until several such rounds in a row. Documents without links then
fill the rooms left. Law ``rows``: shard sizes differ by one at most.

A group larger than a shard starts side by side and asks for as many shards as it fills.
Only built-in functions are used. No group, shard or hot key is brought into one task: votes are
counts per (group, shard) with map-side combining, and queues are numbered over range slices.

Defined cases: null ids are documents like any other (their order among equals is arbitrary);
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, saved


def quotas(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def _at(values: list[int], index: Column) -> Column:
    """values[index] for a column of indexes."""
    return F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), index.cast("int") + 1)


def _place(ends: list[int], at: str) -> Column:
    """The shard whose end is the first above ``at``."""
    limits = F.expr(f"array({', '.join(f'{e}L' for e in ends)})")
    return F.size(F.filter(limits, lambda e: e <= F.col(at))).cast("int")


def flows(asked: np.ndarray, room: list[int]) -> np.ndarray:
    """How many of asked[s, t], who want to go from s to t, may go: what enters a shard is at most
    what leaves it and its room. Cycles are taken out until none is left, each with an arc, of
    which there are n_shards squared; then rooms are filled, and who fills one leaves another."""
    n = len(room)
    left = np.array(asked, np.int64)
    np.fill_diagonal(left, 0)
    start = left.copy()
    left -= np.minimum(left, left.T)
    ended, walked = np.zeros(n, bool), np.zeros(n, bool)
    for s in range(n):
        path = [] if ended[s] else [s]
        walked[path] = True
        while path:
            ways = np.flatnonzero((left[path[-1]] > 0) & ~ended)
            if not len(ways):
                ended[path[-1]], walked[path[-1]] = True, False
                path.pop()
                continue
            back = ways[walked[ways]]
            if not len(back):
                path.append(int(ways[0]))
                walked[path[-1]] = True
                continue
            at = path.index(back[0])
            loop = path[at:]
            arcs = (loop, [*loop[1:], loop[0]])
            left[arcs] -= left[arcs].min()
            walked[loop[1:]] = False
            path = path[: at + 1]
    free = np.array(room)
    while len(found := np.argwhere((left > 0) & (free > 0))):
        s, t = found[0]
        some = min(left[s, t], free[t])
        left[s, t] -= some
        free[t] -= some
        free[s] += some
    return start - left


def _votes(placed: DataFrame) -> tuple[DataFrame, int]:
    """Members per group and shard, and the number of (ordered) pairs of members in one shard."""
    votes = saved(placed.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size")))
    return votes, int(votes.agg(F.sum(F.col("_n").cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)"))).first()[0] or 0)


def balanced_shards(nodes: DataFrame, group: str, n_shards: int, patience: int = 4, salts: int = 32) -> DataFrame:
    """``nodes`` with ``shard`` (int). ``group``: column naming a node's group; null: no links.

    Returns all rows and columns of ``nodes``; rounds go on until ``patience`` of them in a row
    cut no fewer links.
    """
    work = saved(nodes.withColumn("_row", F.monotonically_increasing_id()))
    total = work.count()
    quota = quotas(total, n_shards)
    fits = max(1, total // n_shards)
    sizes = work.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    # Salted: a group of a third of all rows meets its size in as many tasks as there are salts.
    spread = sizes.select(group, "_size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    narrow = work.select("_row", group, (F.col("_row") % salts).cast("int").alias("_salt"))
    linked = saved(narrow.join(spread, [group, "_salt"]).select("_row", F.xxhash64(group).alias("_group"), "_size"))
    counts = np.array(quotas(linked.count(), n_shards))
    large = F.col("_size") >= fits
    order = [F.desc(F.when(large, F.col("_size")).otherwise(0)), F.when(large, F.col("_group")).otherwise(0), F.xxhash64("_row"), "_row"]
    active = saved(numbered(linked, [], order, "_n").select("_row", "_group", "_size", _place(counts.cumsum().tolist(), "_n").alias("shard")))
    discard(linked)
    columns, settled, turn, stalled = active.columns, [], 0, 0
    votes, together = _votes(active)
    while stalled < patience:
        # Per group its shards, most members first; at most n_shards entries.
        tie = F.xxhash64("_group", "shard", F.lit(turn))
        room = np.array(quota) - counts
        score = F.col("_n")
        if stalled == 1:
            score = score + F.when(F.col("_size") - F.col("_n") <= _at(room.tolist(), F.col("shard")), F.lit(total)).otherwise(F.lit(0))
        elif stalled:
            score = score * F.pmod(tie, F.lit(1 << 20))
        ranked = votes.groupBy("_group").agg(
            F.max("_size").alias("_all"),
            F.reverse(F.array_sort(F.collect_list(F.struct(score.alias("_score"), tie.alias("_tie"), "shard")))).alias("_votes"),
        )
        wanted = F.ceil(F.col("_all") / fits).cast("int")
        ranked = ranked.filter(F.size("_votes") > wanted).select(
            "_group", F.slice(F.col("_votes.shard"), 1, wanted).alias("_best"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
        )
        goal = F.element_at("_best", (F.pmod(F.xxhash64("_row", F.lit(turn)), F.size("_best")) + 1).cast("int"))
        asked = saved(
            active.withColumn("_salt", (F.col("_row") % salts).cast("int"))
            .join(ranked, ["_group", "_salt"], "left")
            .select(*columns, F.when(F.array_contains("_best", F.col("shard")), F.col("shard")).otherwise(goal).alias("_goal"))
        )
        if not stalled:  # groups in no more shards than they fill stay where they are
            settled.append(asked.filter("_goal is null").select(*columns))
            active = asked.filter("_goal is not null").select(*columns)
            votes = votes.join(ranked.select("_group").distinct(), "_group", "left_semi")
            together = int(votes.agg(F.sum(F.col("_n").cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)"))).first()[0] or 0)
        turn += 1
        movers = asked.filter("_goal <> shard")
        wishes = np.zeros((n_shards, n_shards), np.int64)
        for r in movers.groupBy("shard", "_goal").agg(F.count(F.lit(1)).alias("n")).collect():  # n_shards squared
            wishes[r["shard"], r["_goal"]] = r["n"]
        if not wishes.any():
            break
        flow = flows(wishes, room.tolist())
        if not flow.any():
            stalled += 1
            continue
        queue = numbered(movers, ["shard", "_goal"], [F.desc("_size"), "_group", "_row"], "_place")
        may = F.col("_place") < _at(flow.reshape(-1).tolist(), F.col("shard") * n_shards + F.col("_goal"))
        after = queue.withColumn("shard", F.when(may, F.col("_goal")).otherwise(F.col("shard"))).select(*columns)
        after = saved(after.unionByName(asked.filter("_goal = shard").select(*columns)))
        votes_after, together_after = _votes(after)
        if together_after > together:
            active, votes, together, stalled = after, votes_after, together_after, 0
            counts = counts + flow.sum(0) - flow.sum(1)
        else:
            discard(after, votes_after)
            stalled += 1
    placed = active
    for table in settled:
        placed = placed.unionByName(table)
    placed = saved(placed)
    # Documents without links take the rooms left, in shard order.
    ends = (np.array(quota) - counts).cumsum().tolist()
    alone = work.select("_row").join(placed.select("_row"), "_row", "left_anti")
    filled = numbered(alone, [], [F.xxhash64("_row"), "_row"], "_n").select("_row", _place(ends, "_n").alias("shard"))
    return work.join(filled.unionByName(placed.select("_row", "shard")), "_row").drop("_row")


def shard_documents(docs: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Groups are equal texts (SHA-256). A null text has 16 bytes of size, the checksum of no bytes
    (0) and no links.
    """
    nodes = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("_text"),
    )
    shards = balanced_shards(nodes, "_text", n_shards).drop("_text")
    slotted = numbered(shards, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
