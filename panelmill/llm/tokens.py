"""Token counts through a compiled tokenizer, in chunks that compose.

The byte-level tokenizer is two deterministic machines in series: one that cuts text into
pre-tokens, and one per pre-token whose transitions emit tokens. ``Transducer`` compiles the
second lazily: a stretch of text from one space to the next, once met, is a transition labelled
with the tokens it emits (their number for counting), so a text costs one table step per word.

Texts are cut into chunks of ``chunk_chars`` characters wherever that falls. What a chunk does to
the machine's state is the map (head, n, tail): n tokens between its first and last safe cut, and
the open ends. A safe cut stands before white space after a printable ASCII character: there the
machine is in its start state whatever came before. Maps compose by joining a tail with the next
head; a running count of chunks with a cut (a prefix scan per document) names the seam that each
open end belongs to, and seams are counted like any text.

Defined cases: null text is empty (0 bytes, 0 tokens); a text without white space is one seam;
repeated rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

# Texts of these bytes only take the quick path: printable ASCII, its white space, and the
# lead and following bytes of the letters U+00C0 to U+027F (without the signs C3 97 and C3 B7).
_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")
_RUNS = (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ")  # a space that does not start its white space
_CUT = re.compile(rb"(?<=[!-~])(?=[ \t\n\r\x0b\x0c])")
MAX_TABLE = 250_000  # transitions kept by a worker; later ones are compiled each time


class Transducer:
    """Tokens of a text by lazily compiled transitions, for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.merges = self._ranked(path)
        self.words: dict[bytes, bytes] = {}  # what a space and these bytes emit
        self.lengths: dict[bytes, int] = {}  # how many tokens that is

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as ranks, where the file stands next to it: quicker to compile from."""
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _emitted(self, text: bytes, plain: bool) -> list[int]:
        if plain and self.merges:
            return self.merges.encode_ordinary(text.decode())
        return self.library.encode(text.decode(), add_special_tokens=False).ids

    def _symbols(self, text: bytes) -> tuple[bool, list[bytes]]:
        """Is the text plain, and its cut before every space; just the text where such a cut may
        fall inside a run of white space."""
        plain = (
            not text.translate(None, _PLAIN)
            and not any(s in text for s in _SIGNS)
            and not any(s in text for s in self.specials)
        )
        if not plain or any(run in text for run in _RUNS):
            return plain, [text]
        return plain, text.split(b" ")

    def ids(self, text: bytes) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        plain, symbols = self._symbols(text)
        first = array("I", self._emitted(symbols.pop(0), plain)).tobytes()
        table = self.words
        try:
            return first + b"".join(map(table.__getitem__, symbols))
        except KeyError:
            fresh = {w: array("I", self._emitted(b" " + w, True)).tobytes() for w in set(symbols).difference(table)}
        if len(table) < MAX_TABLE:
            table.update(fresh)
        return first + b"".join([fresh[w] if w in fresh else table[w] for w in symbols])

    def count(self, text: bytes) -> int:
        plain, symbols = self._symbols(text)
        first = len(self._emitted(symbols.pop(0), plain))
        table = self.lengths
        try:
            return first + sum(map(table.__getitem__, symbols))
        except KeyError:
            fresh = {w: len(self._emitted(b" " + w, True)) for w in set(symbols).difference(table)}
        if len(table) < MAX_TABLE:
            table.update(fresh)
        return first + sum([fresh[w] if w in fresh else table[w] for w in symbols])

    def state_map(self, chunk: bytes) -> tuple[bytes, int, bytes] | None:
        """(head, tokens between the outer safe cuts, tail); None without a safe cut."""
        first = _CUT.search(chunk)
        if first is None:
            return None
        at = len(chunk) - 1
        while at > first.start() and not _CUT.match(chunk, at):
            at -= 1
        return chunk[: first.start()], self.count(chunk[first.start() : at]), chunk[at:]


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer per worker and vocabulary; its table lives on between tasks."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, vocabulary: str, chunk_chars: int = 16_384, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
        .select(
            "doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"),
            F.greatest(F.lit(1), F.ceil(F.length("text") / chunk_chars)).cast("int").alias("n_chunks"), "text",
        )
        .select("doc_id", "row", "n_bytes", "n_chunks", "text", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
        .select(
            "doc_id", "row", "n_bytes", "n_chunks", "chunk",
            F.encode(
                F.when(F.col("n_chunks") == 1, F.col("text")).otherwise(F.expr(f"substring(text, chunk * {chunk_chars} + 1, {chunk_chars})")), "UTF-8"
            ).alias("text"),
        )
    )
    names = ["doc_id", "row", "n_bytes", "n_chunks", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            heads, counts, tails, cuts = [], [], [], []
            for part, text in zip(batch.column("n_chunks").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                found = ("", machine.count(text), "") if part == 1 else machine.state_map(text)
                cuts.append(found is not None)
                head, n, tail = found or (text, 0, None)
                heads.append(head)
                counts.append(n)
                tails.append(tail)
            new = [pa.array(heads, pa.binary()), pa.array(counts, pa.int64()), pa.array(tails, pa.binary()), pa.array(cuts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "head", "n", "tail", "cut"])

    maps = saved(
        chunks.mapInArrow(
            run, f"doc_id {kind}, row long, n_bytes long, n_chunks int, chunk int, head binary, n long, tail binary, cut boolean"
        )
    )
    whole = maps.filter("n_chunks = 1").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    # Which seam an open end belongs to: the chunks with a cut before it.
    order = Window.partitionBy("row").orderBy("chunk")
    scanned = maps.filter("n_chunks > 1").withColumn("after", F.sum(F.col("cut").cast("long")).over(order))
    ends = scanned.select(
        "doc_id", "row", "n_bytes", "n",
        F.explode(
            F.array(
                F.struct((F.col("after") - F.col("cut").cast("long")).alias("seam"), (F.col("chunk") * 2).alias("at"), F.col("head").alias("text")),
                F.struct(F.col("after").alias("seam"), (F.col("chunk") * 2 + 1).alias("at"), F.col("tail").alias("text")),
            )
        ).alias("e"),
        "chunk",
    ).select("doc_id", "row", "n_bytes", F.when(F.col("e.at") % 2 == 0, F.col("n")).otherwise(0).alias("n"), "e.*")
    seams = ends.groupBy("doc_id", "row", "n_bytes", "seam").agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("ends"),
    )
    parts = seams.select("doc_id", "row", "n_bytes", "n", F.col("ends.text").alias("texts"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            counts = [n + machine.count(b"".join(texts)) for n, texts in zip(batch.column("n").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(counts, pa.int64())], [*names[:3], "n"])

    composed = (
        parts.mapInArrow(close, f"doc_id {kind}, row long, n_bytes long, n long")
        .groupBy("doc_id", "row", "n_bytes").agg(F.sum("n").alias("n_tokens")).drop("row")
    )
    return whole.unionByName(composed).withColumn("over_limit", F.col("n_tokens") > limit)
