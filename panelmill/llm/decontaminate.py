"""Benchmark decontamination with a generalised suffix automaton.

The benchmark is the stated query set. Its items, as word sequences, are inserted into one
suffix automaton per block of at most ``block_words`` words; an automaton has at most two states
a word, which bounds what is built at the driver and broadcast. Documents stream through it word
by word: the automaton tracks the longest suffix read so far that occurs in some item. Where that
length reaches the window, the window's words are hit; the state tells which items hold it.
A larger benchmark costs more passes over the documents, never a larger automaton.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. An item with
fewer words than the window, but not none, is one window of all its words.

Defined cases: a null or empty text has no words and no hits; an item without words matches
nothing; an item without an id marks words and is named nowhere; repeated items and rows count once
and each, in this order; without items nothing is hit; ids of items may have any type; columns named
as the results (n_words, spans, items) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved

SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
RESULTS = ("n_words", "spans", "items")


def _results(benchmark: DataFrame) -> T.StructType:
    item = benchmark.schema["item_id"].dataType
    kinds = (T.LongType(), T.ArrayType(SPAN), T.ArrayType(item))
    return T.StructType([T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True)])


_WORD_BYTES = bytes(b"0123456789abcdefghijklmnopqrstuvwxyz") + bytes(range(128, 256))
LOWER = bytes(
    (b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32) for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


class SuffixAutomaton:
    """All word sequences inside the inserted items, with the windows that mark a hit."""

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self._paths: list[tuple[int, list[int]]] = []
        self.n_words = 0

    def _clone(self, origin: int, word: int, length: int) -> int:
        twin, old = len(self.next), self.next[origin][word]
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.length.append(length)
        self.link[old] = twin
        state = origin
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _step(self, last: int, word: int) -> int:
        """The state of the item read so far, extended by a word."""
        known = self.next[last].get(word)
        if known is not None:
            good = self.length[known] == self.length[last] + 1
            return known if good else self._clone(last, word, self.length[last] + 1)
        fresh = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            known = self.next[state][word]
            if self.length[known] != self.length[state] + 1:
                known = self._clone(state, word, self.length[state] + 1)
            self.link[fresh] = known
        return fresh

    def insert(self, item: object, words: Sequence[bytes]) -> None:
        codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        state = 0
        for code in codes:
            state = self._step(state, code)
        if codes:
            self._paths.append((item, codes))
            self.n_words += len(codes)

    def finish(self) -> SuffixAutomaton:
        """Note the items of every window; to be called once, after the last insertion."""
        self.whole: dict[int, set[int]] = {}  # state of a window -> items
        self.short: dict[int, set[int]] = {}  # state of a whole short item -> items
        for item, codes in self._paths:
            state = 0
            for at, code in enumerate(codes):
                state = self.next[state][code]
                if at + 1 >= self.window:
                    self.whole.setdefault(self._window_state(state), set()).add(item)
            if len(codes) < self.window:
                self.short.setdefault(state, set()).add(item)
        self.least = min((min(self.window, len(codes)) for _, codes in self._paths), default=0)
        # The nearest whole short item among a state and its suffixes.
        self.nearest = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]
        self._paths = []
        return self

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit word ranges [first, last], in order and apart, and the items found."""
        spans: list[list[int]] = []
        items: set[int] = set()
        if not self.least or len(words) < self.least:
            return spans, items
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        # Only runs of benchmark words as long as the shortest window can hold a hit.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        wide = ends - starts >= self.least
        seen: set[int] = set()
        for start, end in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            self._run(codes[start:end].tolist(), start, spans, seen, items)
        for state in seen:
            items |= self.whole[state]
        items.discard(None)
        return _merged(spans), items

    def _run(self, codes: list[int], start: int, spans: list, seen: set, items: set) -> None:
        follow, link, lengths, window = self.next, self.link, self.length, self.window
        state = length = 0
        for at, code in enumerate(codes, start):
            ahead = follow[state].get(code)
            if ahead is None:
                while state and code not in follow[state]:
                    state = link[state]
                length = lengths[state]
                ahead = follow[state].get(code)
                if ahead is None:
                    continue
            state, length = ahead, length + 1
            if length >= window:
                seen.add(self._window_state(state))
                # A span may grow only if it begins where this window begins or before.
                if spans and spans[-1][0] <= at - window + 1 <= spans[-1][1] + 1:
                    spans[-1][1] = at
                else:
                    spans.append([at - window + 1, at])
            if self.short:
                found = self.nearest[state]
                if found == state and lengths[found] > length:
                    found = self.nearest[link[state]]
                while found > 0:
                    items |= self.short[found]
                    spans.append([at - lengths[found] + 1, at])
                    found = self.nearest[link[found]]


def _merged(spans: Iterable[Sequence[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def automata(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton per block of items; a block ends once it has ``block_words`` words."""
    block = SuffixAutomaton(window)
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    for row in items.toLocalIterator():
        block.insert(row.item_id, words_of(row.text.encode()))
        if block.n_words >= block_words:
            yield block.finish()
            block = SuffixAutomaton(window)
    yield block.finish()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000, carry_text: bool = True
) -> DataFrame:
    """``docs`` with n_words, spans (hit word ranges) and items (ids of the items found, sorted)."""
    rows, last = _through_blocks(docs, benchmark, window, block_words)
    schema = rows.schema if carry_text else T.StructType([f for f in rows.schema if f.name != "text"])
    return _streamed(rows, last, schema)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000, max_coverage: float = 0.5
) -> DataFrame:
    """``docs`` without hit spans: rows with more than ``max_coverage`` of their words hit go, the
    others lose the spans, from the first letter to the last."""
    rows, last = _through_blocks(docs, benchmark, window, block_words)
    return _streamed(rows, last, rows.schema, max_coverage).drop(*RESULTS)


def _through_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int):
    """Rows with the results of all blocks but the last, and that one as a broadcast."""
    spark = docs.sparkSession
    rows = docs.drop(*RESULTS).withColumns({f.name: F.lit(None).cast(f.dataType) for f in _results(benchmark)})
    before: SuffixAutomaton | None = None
    for block in automata(benchmark, window, block_words):
        if before is not None:
            rows = saved(_streamed(rows, spark.sparkContext.broadcast(before), rows.schema))
        before = block
    return rows, spark.sparkContext.broadcast(before)


def _streamed(rows: DataFrame, shared, schema: T.StructType, max_coverage: float | None = None) -> DataFrame:
    """Match ``rows`` against one automaton; with ``max_coverage``, clean them as well."""
    keep = [f.name for f in schema if f.name not in RESULTS]
    results = [f for f in rows.schema if f.name in RESULTS]
    item = to_arrow_type(rows.schema["items"].dataType.elementType)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            texts = batch.column("text").cast(pa.binary())
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (old_spans, old_items) in zip(texts, earlier, strict=True):
                words = words_of(text.as_py())
                found, ids = automaton.matches(words)
                if old_spans:
                    found = _merged([*found, *([s["first"], s["last"]] for s in old_spans)])
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in found])
                items.append(sorted(ids.union(old_items or ())))
            span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(item))]
            old = {c: batch.column(c) for c in keep}
            if max_coverage is not None:
                ranges = [[(s["first"], s["last"]) for s in some] for some in spans]
                old["text"] = pa.array(
                    [without_words(t.as_py(), r) if r else t.as_py() for t, r in zip(batch.column("text"), ranges, strict=True)], pa.string()
                )
                few = [sum(b - a + 1 for a, b in r) <= max_coverage * n for r, n in zip(ranges, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*old.values(), *new], [*keep, *RESULTS]).filter(pa.array(few, pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays([*old.values(), *new], [*keep, *RESULTS])

    return rows.mapInArrow(stream, T.StructType([*(f for f in schema if f.name in keep), *results]))


def n_hit():
    """Hit words of a row, from its spans."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")


def without_words(text: str, spans: Sequence[tuple[int, int]]) -> str:
    data = text.encode()
    wordy = np.frombuffer(data.translate(LOWER), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], wordy.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at : starts[first]])
        at = int(ends[last])
    return b"".join([*kept, data[at:]]).decode()
