"""Best-fit packing planned on the histogram of lengths.

A document is the ids of its text and END. Only documents longer than a sequence are cut, into
pieces of a sequence; their first piece is what is left over. How many pieces of each length
there are is all that best fit needs: a plan over at most ``capacity`` counts, longest first,
deals runs of equal pieces into runs of equally filled sequences. Every piece has a rank within
its length, and takes the slot that the plan holds for that rank.

``slots`` and ``plan`` are bounded by ``capacity``, not by the corpus: a length opens at most two
runs of sequences and splits at most one, and a run takes at most ``capacity`` pieces one upon
the other. Ranks are running counts inside a task plus the counts of the tasks before it, so a
length that half of all pieces share is no group of its own.

Defined cases: a null text is empty (one piece, END alone); rows with equal ids are separate
documents; an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .tokens import transducer

END = 2  # the id after every document
CAPACITY = 1024
_RANK_BITS = 48


@dataclass(frozen=True)
class Plan:
    """Runs of slots, in order of (length, rank): pieces of ``length`` with ranks from ``rank`` on
    lie at ``offset`` in the sequences from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def keys(self) -> np.ndarray:
        return (self.length << _RANK_BITS) | self.rank


def plan(lengths: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, over the numbers of pieces of every length."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: (first sequence, how many)
    runs: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted(lengths, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit sequences of {capacity}")
        left, rank, space = lengths[length], 0, length
        while left:
            # The least space that takes a piece; it only grows while pieces of one length are dealt.
            while space < capacity and not room[space]:
                space += 1
            each = space // length
            if room[space]:
                first, many = room[space].pop()
            else:
                first, many = opened, -(-left // each)
                opened += many
            # Best fit stays with a sequence until no further piece of this length fits.
            full = min(many, left // each)
            for k in range(each if full else 0):
                runs.append((length, rank, first, capacity - space + k * length))
                rank += full
            left -= full * each
            if full:
                room[space - each * length].append((first, full))
                first, many = first + full, many - full
            if many and 0 < left < each:
                for k in range(left):
                    runs.append((length, rank, first, capacity - space + k * length))
                    rank += 1
                room[space - left * length].append((first, 1))
                first, many, left = first + 1, many - 1, 0
            if many:
                room[space].append((first, many))
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(4)), sequences=opened)


PIECES = "piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id and the pieces of every document; ``nth`` counts pieces of a length in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    names = ["doc_id", *(c.split()[0] for c in PIECES.split(", "))]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen, task = transducer(vocabulary), Counter(), TaskContext.get().partitionId()
        end = END.to_bytes(4, "little")
        for batch in batches:
            owner, out = [], []
            for row, text in enumerate(batch.column("text")):
                ids = machine.ids(text.as_py()) + end
                n = len(ids) // 4
                at, length = 0, (n - 1) % capacity + 1
                part = 0
                while at < n:
                    owner.append(row)
                    crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                    out.append((part, at, length, crc, task, seen[length]))
                    seen[length] += 1
                    at, length, part = at + length, capacity, part + 1
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            ids_column = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_column, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {kind}, {PIECES}")


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of a written table with the slots planned for them: sequence_id and offset."""
    spark = cut.sparkSession
    held = saved(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))  # at most ``capacity`` rows a task
    lengths = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(lengths, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table.keys()
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1
            found = [pa.array(table.sequence[at] + rank - table.rank[at]), pa.array(table.offset[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(saved(pieces(docs, vocabulary, capacity)), capacity)
