"""Passages that an earlier document already holds, by prefix doubling over sampled positions.

A byte is repeated when a string of ``LENGTH`` bytes that covers it also starts in a document with
a smaller id. Names of byte strings grow by doubling: the name of 2h bytes at a position follows
from the pair of names of h bytes at the position and h further, as suffix sorting by prefix
doubling does, and a position whose name no other document has leaves the race. Every string goes
through two rounds:

1. Names of 20 bytes at sampled positions. In each window of LENGTH bytes the position with the
   least mixed name is its anchor. Equal windows have their anchor at the same place, so windows
   can only be equal where anchors are; anchors no other document has are dropped.
2. Names of LENGTH bytes. All windows of one anchor in one document are neighbours; their bytes go
   to the bucket of the anchor, which names them, sorts (name, document) pairs and answers with
   the range of windows that a smaller document has as well. The covered bytes of one anchor are
   one range, since its windows overlap.

Runs that a task holds in several documents are sent once, with the smallest of these, and answered
by the task for the others. Nothing is gathered per key beyond a bucket of the key space.

Defined cases: a null text is empty; texts shorter than LENGTH have nothing to remove; documents
with equal ids do not count as smaller, so repeated rows are equal; documents with a null id keep
all bytes and are nobody's earlier document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, buckets, gram_hashes, joined, mixed, sliding, text_slices
from .shared_keys import SLICE, rid, shared_keys, short

LENGTH = 50
GRAM = 20
SPREAD = LENGTH - GRAM + 1  # sampled positions a window chooses its anchor from
FLUSH_BYTES = 3 << 20
NAME = 0xC2B2AE3D27D4EB4F


class Anchors:
    """Anchors of a list of texts: mixed name, text, position, first and last window (offsets in
    the joined buffer)."""

    def __init__(self, texts: list[bytes]):
        self.data, self.at = joined(texts)
        n = len(self.data)
        if n < LENGTH:
            self.key, self.owner, self.place, self.first, self.last = (np.empty(0, np.int64) for _ in range(5))
            return
        codes = self.data.astype(U64) + U64(1)
        names = mixed(gram_hashes(codes, GRAM)) | U64(1)
        least = sliding(names, SPREAD, np.minimum)
        # Windows that stay inside one text: starts up to LENGTH before its end.
        edges = np.zeros(n + 1, np.int64)
        starts, ends = self.at[:-1], np.maximum(self.at[:-1], self.at[1:] - LENGTH)
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)
        least = np.where(np.cumsum(edges)[: len(least)] > 0, least, U64(0))
        # A position is an anchor where a window that reaches it has its name as the least.
        padded = np.concatenate([np.zeros(SPREAD - 1, U64), least, np.zeros(SPREAD - 1, U64)])[: len(names) + SPREAD - 1]
        self.place = np.flatnonzero(sliding(padded, SPREAD, np.maximum) == names)
        self.key = names[self.place]
        self.owner = np.searchsorted(self.at, self.place, "right") - 1
        self._runs(least)

    def _runs(self, least: np.ndarray) -> None:
        """The windows around each anchor whose least name is the anchor's."""
        self.first, self.last = self.place.copy(), self.place.copy()
        low = np.full(len(self.place), -1)
        high = np.full(len(self.place), -1)
        for back in range(SPREAD):
            start = self.place - back
            ok = (start >= 0) & (start < len(least))
            hit = np.zeros(len(start), bool)
            hit[ok] = least[start[ok]] == self.key[ok]
            high[hit & (high < 0)] = start[hit & (high < 0)]
            low[hit] = start[hit]
        self.first, self.last = low, high


def _anchor_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, None]:
    found = Anchors(texts)
    order = np.lexsort((found.owner, found.key))
    key, owner = found.key[order].astype(U64), found.owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new], None


_RUN = pa.schema(
    [("bucket", pa.int32()), ("own", pa.bool_()), ("rids", pa.binary()), ("docs", pa.binary()), ("key", pa.binary()),
     ("owner", pa.binary()), ("first", pa.binary()), ("size", pa.binary()), ("text", pa.binary())]
)
_RUN_SQL = "bucket int, own boolean, rids binary, docs binary, key binary, owner binary, first binary, size binary, text binary"


class _Runs:
    """Runs of windows at shared anchors that a task has yet to send."""

    def __init__(self, n: int):
        self.n, self.turn = n, 0
        self.clear()

    def clear(self) -> None:
        self.rids, self.docs, self.parts, self.bytes = [], [], [], 0

    def add(self, rids: list[int], docs: list[int], texts: list[bytes], shared: list[np.ndarray]) -> None:
        found = Anchors(texts)
        keep = np.zeros(len(found.key), bool)
        bounds = np.searchsorted(found.owner, np.arange(len(texts) + 1))
        for a, b, keys in zip(bounds[:-1].tolist(), bounds[1:].tolist(), shared, strict=True):
            keep[a:b] = np.isin(short(found.key[a:b].astype(U64)), keys)
        first, last = found.first[keep], found.last[keep]
        self.parts.append((found.key[keep].astype(U64), found.owner[keep] + len(self.rids), first - found.at[found.owner[keep]], last - first + LENGTH, first, found.data))
        self.rids += rids
        self.docs += docs
        self.bytes += int((last - first + LENGTH).sum())

    def rows(self) -> pa.RecordBatch:
        key, owner, first, size = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        text = [p[5][_spread(p[4], p[3])] for p in self.parts]
        text, begin = np.concatenate(text), np.cumsum(size) - size
        docs, rids = np.array(self.docs, np.int64), np.array(self.rids, np.int64)
        out = []
        if len(key):
            # Equal runs: the smallest document speaks for all of them.
            name = _run_names(text, begin, size) ^ mixed(key)
            order = np.lexsort((docs[owner], name))
            new = np.ones(len(order), bool)
            new[1:] = name[order][1:] != name[order][:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            later = docs[owner[order]] > docs[owner[order][lead]]
            told, ask = order[later], np.sort(order[~later])
            self.turn += 1
            if len(told):
                out.append(self._row(self.turn % self.n, True, told, key, owner, first, size, None, None, rids, docs))
            bucket = (mixed(key[ask]) % U64(self.n)).astype(np.int64)
            by = np.lexsort((key[ask], bucket))  # equal anchors side by side compress best
            ends = np.searchsorted(bucket[by], np.arange(self.n + 1))
            for b in range(self.n):
                here = ask[by[ends[b] : ends[b + 1]]]
                if len(here):
                    out.append(self._row(b, False, here, key, owner, first, size, text, begin, rids, docs))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_RUN), _RUN, strict=True)], schema=_RUN)

    @staticmethod
    def _row(bucket, own, at, key, owner, first, size, text, begin, rids, docs) -> tuple:
        used, local = np.unique(owner[at], return_inverse=True)
        body = b"" if text is None else zstandard.compress(text[_spread(begin[at], size[at])].tobytes(), 3)
        # Equal windows have equal anchors, so of the anchor the bucket only needs a mark to part by.
        mark = b"" if text is None else _planes(mixed(key[at] ^ U64(NAME)) >> U64(48), "<u2")
        return (
            bucket, own, rids[used].tobytes(), _planes(docs[used], "<i8"), mark,
            _planes(local, "<u4"), _planes(first[at], "<u4"), _planes(size[at], "u1"), body,
        )


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers, compressed with their low bytes first and their high bytes last."""
    raw = values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.compress(raw.T.tobytes(), 3)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    """The numbers of ``_planes``."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel().astype(np.int64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [begin, begin + size), one after the other."""
    total = int(size.sum())
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return np.arange(total) + shift


def _run_names(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of whole runs, from the names of their first and last window and their size: the runs
    overlap these two, as a run is shorter than two windows."""
    names = gram_hashes(text.astype(U64) + U64(1), LENGTH)
    return mixed(mixed(names[begin]) + mixed(names[begin + size - LENGTH] + U64(NAME)) * U64(3) + size.astype(U64))


def _answer(rows: pa.Table) -> pa.Table:
    """Ranges of bytes, per document, that a smaller document has as well."""
    rid_, doc, key, first, size, text, out = [], [], [], [], [], [], []
    for row in rows.to_pylist():
        owner = _numbers(row["owner"], "<u4")
        r, d = np.frombuffer(row["rids"], np.int64)[owner], _numbers(row["docs"], "<i8")[owner]
        f, s = _numbers(row["first"], "<u4"), _numbers(row["size"], "u1")
        if row["own"]:
            out.append((r, d, f, f + s))
        else:
            body = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
            for part, value in zip((rid_, doc, key, first, size, text), (r, d, _numbers(row["key"], "<u2"), f, s, body), strict=True):
                part.append(value)
    if key:
        rid_, doc, key, first, size, text = (np.concatenate(x) for x in (rid_, doc, key, first, size, text))
        begin = np.cumsum(size) - size
        # A part of the anchors at a time, about FLUSH_BYTES of text.
        part = key % (len(text) // FLUSH_BYTES + 1)
        for p in range(len(text) // FLUSH_BYTES + 1):
            some = np.flatnonzero(part == p)
            if len(some):
                low, high = _earlier(text[_spread(begin[some], size[some])], size[some], key[some], doc[some])
                hit = high >= 0
                some = some[hit]
                out.append((rid_[some], doc[some], first[some] + low[hit], first[some] + high[hit] + LENGTH))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4
    return pa.table(dict(zip(("rid", "doc_id", "first", "last"), columns, strict=True)))


def _earlier(text: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every run that a smaller document has under the same anchor."""
    names = gram_hashes(text.astype(U64) + U64(1), LENGTH)
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    run = np.repeat(np.arange(len(size)), windows)
    at = _spread(begin, windows)
    name = mixed(names[at] + mixed(key.astype(U64))[run] * U64(NAME))
    by_doc = np.argsort(doc[run], kind="stable")
    order = by_doc[np.argsort(name[by_doc], kind="stable")]
    sorted_name, sorted_doc = name[order], doc[run][order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_name[1:] != sorted_name[:-1]
    least = sorted_doc[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    hit = order[sorted_doc > least]
    inside = at[hit] - begin[run[hit]]
    low, high = np.full(len(size), LENGTH), np.full(len(size), -1)
    np.minimum.at(low, run[hit], inside)
    np.maximum.at(high, run[hit], inside)
    return low, high


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, rid, the text as bytes and the other columns as one, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    return docs.select("doc_id", rid().alias("rid"), F.encode("text", "UTF-8").alias("text"), rest.alias("rest"))


def with_spans(named: DataFrame) -> DataFrame:
    """Rows of ``_named`` with ``spans``: (doc_id, first, last) ranges of repeated bytes [first, last),
    in no order, of the documents that go by the rid of the row.

    Both joins move the same columns of the same rows by rid, so the texts are shuffled once.
    """
    n = 4 * buckets(named.sparkSession)
    able = named.filter("doc_id is not null and text is not null").filter(F.octet_length("text") >= LENGTH)
    shared = shared_keys(able.select("rid", "text"), _anchor_keys).groupBy("rid").agg(F.collect_set("key").alias("keys"))
    marked = named.join(shared, "rid")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(n)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            keys = [np.sort(np.asarray(k.values, np.int64).view(U64)) for k in batch.column("keys")]
            ids = list(zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), keys, strict=True))
            for some, texts in text_slices(ids, (t.as_py() for t in batch.column("text")), SLICE):
                runs.add([s[0] for s in some], [s[1] for s in some], texts, [s[2] for s in some])
                if runs.bytes >= FLUSH_BYTES:
                    yield runs.rows()
        if runs.rids:
            yield runs.rows()

    found = (
        marked.mapInArrow(send, _RUN_SQL).groupBy("bucket").applyInArrow(_answer, "rid long, doc_id long, first long, last long")
    )
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("doc_id", "first", "last")).alias("spans"))
    return named.join(spans, "rid", "left")


def _merged(spans: list[dict] | None, doc: int | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or () if s["doc_id"] == doc):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, list[tuple[int, int]]]]:
    """(text, ranges) of every row."""
    for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
        yield text, _merged(spans.as_py(), doc)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in _rows(batch):
                data, at, kept, removed = memoryview(text.as_buffer() if text.is_valid else b""), 0, hashlib.sha256(), 0
                for first, last in ranges:
                    kept.update(data[at:first])
                    removed += last - first
                    at = last
                kept.update(data[at:])
                out.append((len(data), removed, len(ranges), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names)

    rows = with_spans(_named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the text, in whole characters; documents of which
    nothing is left go."""
    schema = T.StructType(list(docs.schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py().decode() if text.is_valid else None for text in batch.column("text")]
            ranges = [r for _, r in _rows(batch)]
            texts = [kept_text(text, r) if r else text for text, r in zip(texts, ranges, strict=True)]
            some = pa.array([not r or text != "" for text, r in zip(texts, ranges, strict=True)], pa.bool_())
            rest = iter(batch.column("rest").flatten() if len(schema) > 2 else ())
            own = {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}
            columns = [own[f.name] if f.name in own else next(rest) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(some)

    return with_spans(_named(docs)).mapInArrow(cut, schema)


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters that lie whole inside the byte ranges."""
    data = text.encode()
    kept, at = [], 0
    for first, last in spans:
        while first < last and data[first] & 0xC0 == 0x80:  # inside a character
            first += 1
        while first < last < len(data) and data[last] & 0xC0 == 0x80:
            last -= 1
        kept.append(data[at:first])
        at = last
    return b"".join([*kept, data[at:]]).decode()
