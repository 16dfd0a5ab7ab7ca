"""Which 64-bit keys occur in two documents or more, without a row per key.

Tasks pack the keys of many documents into one binary row per bucket of the key space; a bucket
sorts what it gets and answers with (document, key) rows for shared keys only. A key that a task
sees in several of its own documents is known to be shared: the task answers for them itself and
sends the bucket one entry, so a key held by a third of all documents costs an entry a task.

Documents are named by ``rid``, a 64-bit hash of id and text: repeated rows share it, and answers
for one are right for the other. Keys are compared by their upper 48 bits within a bucket; a
collision makes a key look shared, which later exact steps undo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, buckets, text_slices

SLICE = 1 << 19  # bytes of text hashed at once
FLUSH_KEYS, FLUSH_DOCS = 1 << 20, 60_000  # what a task gathers before it sends

ENTRY, ANSWER, FACTS = 0, 1, 2
ALONE = 0xFFFF  # owner of an entry that needs no answer


def rid() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def short(keys: np.ndarray) -> np.ndarray:
    """The 48 bits a key goes by."""
    return keys >> U64(16)


def _packed(keys: np.ndarray) -> bytes:
    return (keys >> U64(32)).astype("<u2").tobytes() + (keys & U64(0xFFFFFFFF)).astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    high, low = np.frombuffer(data, "<u2", n), np.frombuffer(data, "<u4", n, 2 * n)
    return high.astype(U64) << U64(32) | low


_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("docs", pa.binary())])


class _Flush:
    """Keys of the documents a task has read since it last sent."""

    def __init__(self, n_buckets: int, salt: int):
        self.n, self.turn = n_buckets, salt
        self.clear()

    def clear(self) -> None:
        self.keys, self.owners, self.rids, self.facts, self.size = [], [], [], [], 0

    def add(self, rids: list[int], keys: np.ndarray, owners: np.ndarray, facts: np.ndarray | None) -> None:
        self.keys.append(keys)
        self.owners.append(owners + len(self.rids))
        self.rids += rids
        self.size += len(keys)
        if facts is not None:
            self.facts.append(facts)

    def full(self) -> bool:
        return self.size >= FLUSH_KEYS or len(self.rids) >= FLUSH_DOCS

    def takes(self, n: int) -> bool:
        """Whether n documents more leave every owner a number below ALONE."""
        return len(self.rids) + n <= ALONE

    def rows(self) -> pa.RecordBatch:
        assert len(self.rids) <= ALONE, f"{len(self.rids)} documents do not fit 16-bit numbers"
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners).astype("<u2")
        rids = np.array(self.rids, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        out: list[tuple] = []
        if len(keys):
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            count = np.diff(np.concatenate((np.flatnonzero(first), [len(keys)])))
            many = np.repeat(count > 1, count)
            self.turn += 1
            out.append(self._row(self.turn % self.n, ANSWER, short(keys[many]), owners[many], rids))
            entry, owner = keys[first], np.where(count > 1, ALONE, owners[first]).astype("<u2")
            bucket = (entry & U64(0xFFFF)).astype(np.int64) % self.n
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(self.n + 1))
            for b in range(self.n):
                here = order[ends[b] : ends[b + 1]]
                if len(here):
                    out.append(self._row(b, ENTRY, short(entry[here]), owner[here], rids))
        if self.facts:
            self.turn += 1
            out.append((self.turn % self.n, FACTS, np.concatenate(self.facts).astype("<i8").tobytes(), b"", rids.tobytes()))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW)

    @staticmethod
    def _row(bucket: int, kind: int, keys: np.ndarray, owners: np.ndarray, rids: np.ndarray) -> tuple:
        used, local = np.unique(owners[owners != ALONE], return_inverse=True)
        packed = np.full(len(owners), ALONE, "<u2")
        packed[owners != ALONE] = local
        return bucket, kind, _packed(keys), packed.tobytes(), rids[used].tobytes()


def shared_keys(docs: DataFrame, keys_of: Callable, n_facts: int = 0) -> DataFrame:
    """Rows (rid, key, facts). ``docs``: rid long and text binary. ``keys_of(texts)`` returns the
    distinct (keys, owners) of a list of texts and, with ``n_facts``, an array of so many longs per
    text, which comes back as ``facts`` in a row of its own with a null key."""
    n = buckets(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = None
        for batch in batches:
            for rids, texts in text_slices(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), SLICE, FLUSH_DOCS):
                flush = flush or _Flush(n, rids[0] % n)
                if not flush.takes(len(rids)):
                    yield flush.rows()
                flush.add(rids, *keys_of(texts))
                if flush.full():
                    yield flush.rows()
        if flush is not None and flush.rids:
            rows = flush.rows()
            if rows.num_rows:
                yield rows

    def answer(rows: pa.Table) -> pa.Table:
        keys, owners, found, facts, told = [], [], [], [], []
        for kind, packed, own, docs_ in zip(*(rows.column(c).to_pylist() for c in ("kind", "keys", "owners", "docs")), strict=True):
            rids = np.frombuffer(docs_, np.int64)
            if kind == FACTS:
                facts.append(np.frombuffer(packed, "<i8").reshape(len(rids), -1))
                told.append(rids)
                continue
            own = np.frombuffer(own, "<u2")
            asks = own != ALONE
            named = np.zeros(len(own), np.int64)
            named[asks] = rids[own[asks]]
            if kind == ANSWER:
                found.append((named, _unpacked(packed)))
            else:
                keys.append(_unpacked(packed))
                owners.append((named, asks))
        if keys:
            every = np.concatenate(keys)
            named, asks = (np.concatenate(x) for x in zip(*owners, strict=True))
            order = np.argsort(every, kind="stable")
            every = every[order]
            same = every[1:] == every[:-1]
            hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            hit &= asks[order]
            found.append((named[order][hit], every[hit]))
        ids = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
        shared = np.concatenate([f[1] for f in found] or [np.empty(0, U64)])
        out = pa.table({"rid": ids, "key": shared.view(np.int64), "facts": pa.nulls(len(ids), pa.list_(pa.int64()))})
        if facts:
            values = np.concatenate(facts)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.int64()))
            out = pa.concat_tables([out, pa.table({"rid": np.concatenate(told), "key": pa.nulls(len(values), pa.int64()), "facts": lists})])
        return out

    sent = docs.select("rid", "text").mapInArrow(send, "bucket int, kind int, keys binary, owners binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(answer, "rid long, key long, facts array<long>")
