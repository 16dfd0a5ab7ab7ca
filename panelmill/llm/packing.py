"""Vector bin packing of tokenised examples into training sequences.

Every example has a demand vector: tokens, segments (one) and loss-bearing tokens. A sequence is
a bin with a limit on each. From a pool of waiting pieces the dot-product heuristic takes the one
whose demand, relative to the limits, has the largest dot product with what the open bin has left;
where none fits whole, the best one is cut to fill the bin. A bin that must close short of its
length (segment or loss limit, or an empty pool) is cut back to a power of two, and what was cut
off goes back to the pool, so no sequence needs padding.

Tasks pack their own rows and share nothing: no shuffle, and a lost task is packed anew with the
same result. A task holds its pool and one document.

Defined cases: a null text is empty (one token, the end of document); rows with equal ids are
separate documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import transducer

END = 0  # the id after every document


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 32
    loss_tokens: int = 1024


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    loss: np.ndarray  # running count of loss-bearing ids of the document, from ``start``
    doc_tokens: int

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, int(self.loss[-1] - self.loss[0])

    def split(self, n: int) -> tuple[Piece, Piece]:
        left = Piece(self.doc, self.start, self.ids[:n], self.loss[: n + 1], self.doc_tokens)
        return left, Piece(self.doc, self.start + n, self.ids[n:], self.loss[n:], self.doc_tokens)


class Packer:
    """Yields finished sequences (lists of pieces) while examples are added."""

    def __init__(self, limits: Limits, pool: int = 512):
        self.limits, self.size = limits, pool
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool: list[Piece] = []
        self.demand = np.zeros((pool + 64, 3))

    def add(self, doc, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[Piece]]:
        running = np.concatenate(([0], np.cumsum(loss)))
        rest = Piece(doc, 0, ids, running, len(ids))
        whole = min(self.limits.tokens, self.limits.loss_tokens)
        while len(rest.ids) >= self.limits.tokens:  # full sequences of one document
            full, rest = rest.split(1 << (whole.bit_length() - 1) if whole < self.limits.tokens else self.limits.tokens)
            yield [full]
        if len(rest.ids):
            self._wait(rest)
        while len(self.pool) >= self.size:
            yield from self._fill()

    def rest(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self._fill()

    def _wait(self, piece: Piece) -> None:
        if len(self.pool) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pool)] = piece.demand()
        self.pool.append(piece)

    def _take(self, at: int) -> Piece:
        piece = self.pool[at]
        last = len(self.pool) - 1
        self.pool[at] = self.pool[last]
        self.demand[at] = self.demand[last]
        self.pool.pop()
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        left, bin_ = self.caps.copy(), []
        while self.pool and left.min() >= 1:
            demand = self.demand[: len(self.pool)]
            value = (demand / self.caps) @ (left / self.caps)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                piece = self._take(int(np.where(fits, value, -1.0).argmax()))
            else:
                piece = self._take(int(value.argmax()))
                # Up to the token limit, and to the last id the loss limit allows.
                n = min(int(left[0]), int(np.searchsorted(piece.loss, piece.loss[0] + left[2], "right")) - 1, len(piece.ids))
                if not n:
                    self._wait(piece)
                    break
                if n < len(piece.ids):
                    piece, rest = piece.split(n)
                    self._wait(rest)
            bin_.append(piece)
            left -= piece.demand()
        total = sum(len(p.ids) for p in bin_)
        keep = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        back: list[Piece] = []
        while total > keep:
            piece = bin_.pop()
            total -= len(piece.ids)
            if total < keep:
                kept, piece = piece.split(keep - total)
                bin_.append(kept)
                total = keep
            back.append(piece)
        for piece in back:
            self._wait(piece)
        yield bin_


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def packed(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    loss_tokens. A document is the ids of its text and END; all but END bear loss."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, packer = transducer(vocabulary), Packer(limits)
        out = None
        for batch in batches:
            out = out or _Pieces(batch.schema.field("doc_id").type, TaskContext.get().partitionId())
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(machine.ids(text.as_py()) + END.to_bytes(4, "little"), "<u4")
                loss = np.ones(len(ids), np.int64)
                loss[-1] = 0
                for sequence in packer.add(doc, ids, loss):
                    out.add(sequence)
            yield out.batch()
        if out:
            for sequence in packer.rest():
                out.add(sequence)
            yield out.batch()

    return rows.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


class _Pieces:
    """Rows of finished sequences; ids of sequences carry the task in their high bits."""

    def __init__(self, kind, task: int):
        self.kind, self.next, self.rows = kind, task << 33, []

    def add(self, sequence: list[Piece]) -> None:
        offset = 0
        for p in sequence:
            crc = zlib.crc32(p.ids.tobytes())
            self.rows.append((p.doc, p.start, len(p.ids), crc, p.doc_tokens, self.next, offset, int(p.loss[-1] - p.loss[0])))
            offset += len(p.ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        kinds = [self.kind, *[pa.int64()] * (len(names) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
