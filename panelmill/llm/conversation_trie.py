"""The prefix trie of conversations, by adaptive radix trees over slices of sorted keys.

A turn becomes a fixed-width big-endian id, the leading bytes of a SHA-256 of its role and text; a
conversation's key is the ids of its turns, one after another. Distinct keys are sorted into slices,
and every slice is one radix tree: layouts for 4, 16, 48 and 256 children that grow with need, and
paths without branches kept as one byte string. Only depths that end a turn become nodes.

A node lies in one slice, or is a common prefix of the keys on both sides of a slice's edge. The
first kind is finished in its tree. The second (``open``) is summed over slices: at most as many
rows an edge as the keys beside it share turns, whatever the size of a group, because a hot prefix
is spread over many slices and equal conversations are one key with a number.

``rebuilt`` grafts the first turns of another conversation onto each one.

Bounds: a slice holds about ``slice_bytes`` of keys. The driver sees the first and last key of
every slice, no more. Ids that share a key reach its digest in order, ``CHUNK`` ids a row; a SHA-256
is sequential, so those rows of one key stream through one task. A conversation's key is a cell of
``WIDTH`` bytes a turn.

Defined cases: turns are ordered by turn (null first), role and text, and repeated rows stay
repeated turns; a null role or text is empty; rows without conv_id belong to no conversation and
are left out; remainders of negative ids take the sign of the id; an empty table gives no nodes;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WIDTH = 16  # bytes of a turn id
CHUNK = 12  # 2**CHUNK ids in a row of a digest
WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256().hexdigest()


# --- keys -------------------------------------------------------------------------------------


def turn_id() -> Column:
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.substring(F.unhex(F.sha2(named, 256)), 1, WIDTH)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (0-based place), tid, words; the order needs no task to hold a conversation."""
    order = ["conv_id", "turn", "role", "text"]
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *empty)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
            "conv_id", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("pos"),
            turn_id().alias("tid"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
        )
    )
    runs = ranged.groupBy("conv_id", "slice").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv_id", "slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return saved(ranged.join(offsets, ["conv_id", "slice"]).select("conv_id", (F.col("pos") + F.col("shift")).alias("at"), "tid", "words"))


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Turns of the conversations after grafting: conv_id, part, at, tid, words in order of (part,
    at). Conversation c takes the first h turns of c - c % block, h = crc32(c) % most, in place of
    its own first h; part -1 is one row a conversation without a turn."""
    numbered = ordered_turns(turns)
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    members = numbered.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), taken)
    heads = numbered.filter(F.col("at") < most - 1).withColumnRenamed("conv_id", "base")
    grafted = members.join(heads, "base").filter("at < h").select("conv_id", F.lit(0).alias("part"), "at", "tid", "words")
    own = numbered.select("conv_id", F.lit(1).alias("part"), "at", "tid", "words", taken).filter("at >= h").drop("h")
    none = members.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("tid"), F.lit(None).cast("long").alias("words"))
    return none.union(grafted).union(own)


def keys(turns: DataFrame) -> DataFrame:
    """conv_id, key, words (a binary of long per turn) from turns as ``rebuilt`` gives them."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "tid", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ids, words = None, [], []
        for batch in batches:
            done = []
            for c, tid, n_words in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "tid", "words")), strict=True):
                if c != conv:
                    if conv is not None:
                        done.append((conv, b"".join(ids), np.array(words, "<i8").tobytes()))
                    conv, ids, words = c, [], []
                if tid:
                    ids.append(tid)
                    words.append(n_words)
            if done:
                yield _batch(done, ["conv_id", "key", "words"], [pa.int64(), pa.binary(), pa.binary()])
        if conv is not None:
            yield _batch([(conv, b"".join(ids), np.array(words, "<i8").tobytes())], ["conv_id", "key", "words"], [pa.int64(), pa.binary(), pa.binary()])

    return rows.mapInArrow(run, "conv_id long, key binary, words binary")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def distinct_keys(members: DataFrame) -> DataFrame:
    """key, words, conv_id (smallest), n, ends (digest of the ids in order) of every key."""
    chunks = members.groupBy("key", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(
        F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
    )
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["key", "words", "conv_id", "n", "ends"], [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest = None, None
        for batch in batches:
            done = []
            for key, words, conv, count, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "conv_id", "n", "ids")), strict=True):
                if row and row[0] == key:
                    row[3] += count
                    digest.update(b"," + ids.encode())
                    continue
                if row:
                    done.append((*row, digest.hexdigest()))
                row, digest = [key, words, conv, count], hashlib.sha256(ids.encode())
            if done:
                yield _batch(done, names, kinds)
        if row:
            yield _batch([(*row, digest.hexdigest())], names, kinds)

    ordered = chunks.repartition(n, "key").sortWithinPartitions("key", "chunk").drop("chunk")
    return ordered.mapInArrow(run, "key binary, words binary, conv_id long, n long, ends string")


# --- the radix tree of a slice ----------------------------------------------------------------


class Few:
    """Children of a node with few of them: labels in order, 4 or 16 at most."""

    def __init__(self, size: int, labels=(), nodes=()):
        self.size, self.labels, self.nodes = size, bytearray(labels), list(nodes)

    def get(self, label: int) -> Node | None:
        at = self.labels.find(label)
        return self.nodes[at] if at >= 0 else None

    def put(self, label: int, node: Node) -> Few | Indexed:
        at = self.labels.find(label)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.labels) == self.size:
            return (Few(16, self.labels, self.nodes) if self.size == 4 else Indexed(self)).put(label, node)
        at = sum(k < label for k in self.labels)
        self.labels.insert(at, label)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.labels, self.nodes, strict=True)


class Indexed:
    """17 to 48 children: a byte for every label says which slot holds its child."""

    def __init__(self, few: Few):
        self.slot, self.nodes = bytearray(256), []
        for label, node in few:
            self.put(label, node)

    def get(self, label: int) -> Node | None:
        at = self.slot[label]
        return self.nodes[at - 1] if at else None

    def put(self, label: int, node: Node) -> Indexed | Full:
        at = self.slot[label]
        if at:
            self.nodes[at - 1] = node
        elif len(self.nodes) == 48:
            return Full(self).put(label, node)
        else:
            self.nodes.append(node)
            self.slot[label] = len(self.nodes)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, self.nodes[at - 1]) for label, at in enumerate(self.slot) if at)


class Full:
    """A place for every label."""

    def __init__(self, indexed: Indexed):
        self.nodes: list[Node | None] = [None] * 256
        for label, node in indexed:
            self.nodes[label] = node

    def get(self, label: int) -> Node | None:
        return self.nodes[label]

    def put(self, label: int, node: Node) -> Full:
        self.nodes[label] = node
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, node) for label, node in enumerate(self.nodes) if node is not None)


class Node:
    """``path``: bytes after the label that led here, shared by all below; ``end``: the key that ends here."""

    __slots__ = ("path", "children", "end")

    def __init__(self, path: bytes = b"", end: Key | None = None):
        self.path, self.children, self.end = path, Few(4), end


@dataclass
class Key:
    key: bytes
    words: np.ndarray
    conv: int
    n: int
    ends: str


def insert(root: Node, item: Key) -> None:
    node, at, key = root, 0, item.key
    above: tuple[Node, int] | None = None
    while True:
        path = node.path
        if not key.startswith(path, at):
            same = next((k for k, (a, b) in enumerate(zip(path, key[at : at + len(path)], strict=False)) if a != b), len(key) - at)
            fork = Node(path[:same])
            node.path = path[same + 1 :]
            fork.children = fork.children.put(path[same], node)
            # Only the root has nothing above it, and its path is empty.
            above[0].children = above[0].children.put(above[1], fork)
            node, path = fork, fork.path
        at += len(path)
        if at == len(key):
            node.end = item
            return
        below = node.children.get(key[at])
        if below is None:
            node.children = node.children.put(key[at], Node(key[at + 1 :], item))
            return
        above, node, at = (node, key[at]), below, at + 1


@dataclass
class Below:
    """What hangs below a depth that is no node itself: sums of the finished nodes under it."""

    sample: Key
    n: int = 0
    conv: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    first: bool = False
    last: bool = False
    waiting: list[int] = field(default_factory=list)  # finished nodes that lack their parent

    def add(self, other: Below) -> None:
        self.n += other.n
        self.conv = other.conv if self.conv is None else min(self.conv, other.conv)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.first |= other.first
        self.last |= other.last
        if len(other.waiting) > len(self.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting


NODE_COLUMNS = (
    "slice int, open boolean, prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
_NAMES = [c.split()[0] for c in NODE_COLUMNS.split(", ")]
_KINDS = [pa.int32(), pa.bool_(), pa.binary(), *[pa.int64()] * 8, pa.string()]


class Slice:
    """The tree of a slice and its nodes. ``shared``: how many turns its first key has in common
    with the slice before, and its last key with the slice after."""

    def __init__(self, number: int, shared: tuple[int, int]):
        self.number, self.shared, self.root = number, shared, Node()
        self.lowest: bytes | None = None
        self.highest = b""
        self.rows: list[list] = []

    def add(self, item: Key) -> None:
        """Keys may come in any order."""
        self.lowest = item.key if self.lowest is None else min(self.lowest, item.key)
        self.highest = max(self.highest, item.key)
        insert(self.root, item)

    def _node(self, depth: int, below: Below, end: Key | None) -> Below:
        """Emit the node at a turn-aligned depth; what it adds to the depth above."""
        words = int(below.sample.words[depth - 1]) if depth else 0
        ends = end.ends if end else None
        if (below.first and depth <= self.shared[0]) or (below.last and depth <= self.shared[1]):
            prefix = below.sample.key[: depth * WIDTH]
            for row in below.waiting:
                self.rows[row][2] = prefix
            self.rows.append([self.number, True, prefix, below.conv, depth, None, below.n, below.children, below.leaves, below.saved, words, ends])
            return Below(below.sample, below.n, below.conv, first=below.first, last=below.last)
        for row in below.waiting:
            self.rows[row][5] = below.conv
        leaves = below.leaves or 1
        saved_here = below.saved + (below.n - 1) * words
        self.rows.append([self.number, False, None, below.conv, depth, None, below.n, below.children, leaves, saved_here, words, ends])
        return Below(below.sample, below.n, below.conv, 1, leaves, saved_here, below.first, below.last, [len(self.rows) - 1])

    def nodes(self) -> list[list]:
        """All nodes, children before parents; the walk keeps its own stack."""
        results: list[Below] = []
        # (tree node, bytes before its label and path, children seen)
        stack: list[tuple[Node, int, bool]] = [(self.root, 0, False)]
        while stack:
            node, above, seen = stack.pop()
            depth = above + len(node.path) + (node is not self.root)
            below = list(node.children)
            if not seen:
                stack.append((node, above, True))
                stack.extend((child, depth, False) for _, child in below)
                continue
            parts = results[len(results) - len(below) :]
            del results[len(results) - len(below) :]
            end = node.end
            total = Below(end or parts[0].sample)
            if end:
                total.n, total.conv = end.n, end.conv
                total.first, total.last = end.key == self.lowest, end.key == self.highest
            for part in parts:
                total.add(part)
            for at in range(depth, above if node is not self.root else -1, -1):
                if at % WIDTH == 0:
                    total = self._node(at // WIDTH, total, end if at == depth else None)
            results.append(total)
        return self.rows


def tree_nodes(distinct: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """Nodes of the trie over distinct keys: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    distinct = saved(distinct)
    spark = distinct.sparkSession
    size = distinct.agg(F.sum(F.length("key") + F.length("words") + 100)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // slice_bytes))
    sliced = saved(distinct.repartitionByRange(n, "key").withColumn("slice", F.spark_partition_id()))
    edges = sorted(sliced.groupBy("slice").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    shared = _shared_turns([(e.slice, bytes(e.low), bytes(e.high)) for e in edges])
    columns = ["slice", "key", "words", "conv_id", "n", "ends"]
    ordered = sliced.select(*columns).repartition(n, "slice").sortWithinPartitions("slice", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Slice | None = None
        for batch in batches:
            for number, key, words, conv, count, ends in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if tree is None or number != tree.number:
                    if tree:
                        yield from _emitted(tree)
                    tree = Slice(number, shared.get(number, (0, 0)))
                tree.add(Key(key, np.frombuffer(words, "<i8"), conv, count, ends))
        if tree:
            yield from _emitted(tree)

    return _merged(saved(ordered.mapInArrow(run, NODE_COLUMNS)))


def _emitted(tree: Slice) -> Iterator[pa.RecordBatch]:
    rows = tree.nodes()
    for at in range(0, len(rows), 10_000):
        yield _batch([tuple(r) for r in rows[at : at + 10_000]], _NAMES, _KINDS)


def _shared_turns(edges: list[tuple[int, bytes, bytes]]) -> dict[int, tuple[int, int]]:
    """Common whole turns of neighbouring slices' keys; slices that share none are left out."""
    common = [0]
    for (_, _, high), (_, low, _) in zip(edges, edges[1:], strict=False):
        most = min(len(high), len(low))
        a, b = (np.frombuffer(k, np.uint8, most) for k in (high, low))
        differ = np.flatnonzero(a != b)
        common.append((int(differ[0]) if len(differ) else most) // WIDTH)
    common.append(0)
    return {number: (common[k], common[k + 1]) for k, (number, _, _) in enumerate(edges) if common[k] or common[k + 1]}


def _merged(nodes: DataFrame) -> DataFrame:
    """Finished nodes, those below an open one, and the open ones summed over slices."""
    opened = nodes.filter("open")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = saved(
        opened.groupBy("prefix", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("ends").alias("ends"), *(F.sum(c).alias(c) for c in sums)
        )
    )
    parent = F.expr(f"substring(prefix, 1, length(prefix) - {WIDTH})")
    inner = whole.filter("depth > 0")
    open_children = inner.groupBy(parent.alias("prefix")).agg(F.count(F.lit(1)).alias("more"))
    counted = whole.join(open_children, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # What a node gives to each of its ancestors and to itself.
    given = counted.select(
        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        "prefix", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("up"),
    )
    totals = (
        given.groupBy(F.expr(f"substring(prefix, 1, cast(up * {WIDTH} as int))").alias("prefix"))
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    above = inner.select("prefix", parent.alias("up")).join(whole.select(F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up").drop("up")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    digest = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    merged = counted.drop("n_leaves", "saved_tokens").join(totals, "prefix").join(above, "prefix", "left")
    # A slice has its own copy of the open nodes above its finished ones, so no prefix is a hot key.
    local = opened.select("slice", "prefix").join(whole.select("prefix", F.col("conv_id").alias("parent")), "prefix")
    hanging = nodes.filter("not open and prefix is not null").join(local, ["slice", "prefix"]).withColumn("parent_conv_id", F.col("parent"))
    inside = nodes.filter("not open and prefix is null")
    return inside.select(*columns, digest).union(hanging.select(*columns, digest)).union(merged.select(*columns, digest))


def trie(turns: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations of a table of turns."""
    return tree_nodes(distinct_keys(keys(rebuilt(turns))), slice_bytes)
