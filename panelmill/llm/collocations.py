"""Phrase collocations by partitioned mining: shards are mined alone, their union is counted.

Documents become units (one language, one task, at most ``unit_bytes`` of text): a dictionary of
words and the text as codes, written once. Units are dealt to ``shards`` shards, so the share of a
shard, and with it the local support, does not depend on the size of the corpus.

1. Words are counted exactly.
2. Every shard is mined completely, size by size, at the lowered support
   ``ceil(support * words of the shard / words of the language)``: a phrase of the full support
   reaches it in some shard. A phrase is looked at only where both phrases one word shorter were
   frequent in some shard; every part of a phrase is at least as frequent as the phrase.
3. The union of what the shards found is counted over all units, by the phrases' own text.

Mining runs on 64-bit hashes and counts by their upper 48 bits, so that less is shuffled; the union
travels as a bitmap of at most ``2**MAX_BITS`` bits (32 MB) a size, whatever the corpus. Two phrases that share a hash or a bit only add candidates; the last count is exact.

Defined cases: null text is empty and has no words; null language is ``und``; repeated rows count
each; an empty table gives no rows; a text without white space is one word; columns other than
text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, RangeHashes, joined, mixed, new_path, power, saved

LONGEST = 4
MAX_BITS = 28
SENT = U64(0xFFFFFFFFFFFF0000)  # bits of a hash that mining counts by; a bitmap reads the leading MAX_BITS
BLOCK = 15  # bits of a position inside one aggregated bitmap block
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int8)  # 0 inside a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

UNITS = "lang string, shard int, n_words long, codes binary, fresh binary, letters binary, ends binary"


# --- units ------------------------------------------------------------------------------------


def _unit(lang: str, shard: int, texts: list[bytes]) -> tuple | None:
    data = _LOWER[joined(texts)[0]]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[kind == 0]))]
    ).dictionary_encode()
    # A word is fresh where a piece begins: a break stands between it and the word before.
    breaks = np.searchsorted(np.flatnonzero(kind == 2), starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = np.diff(breaks) != 0
    known = words.dictionary
    letters = b"".join(known.to_pylist())
    last = np.cumsum([len(w) for w in known.to_pylist()], dtype=np.int64)
    codes = words.indices.to_numpy(zero_copy_only=False).astype("<i4")
    return lang, shard, len(codes), codes.tobytes(), np.packbits(fresh).tobytes(), letters, last.tobytes()


def encoded(docs: DataFrame, shards: int, unit_bytes: int) -> DataFrame:
    """The units of ``docs``, one row each."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        waiting: dict[str, tuple[list[bytes], list[int]]] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                some, size = waiting.setdefault(lang, ([], [0]))
                some.append(text.as_py())
                size[0] += len(some[-1]) + 1
                total += len(some[-1]) + 1
                if size[0] >= unit_bytes:
                    total -= size[0]
                    yield from _rows([_unit(lang, shard, waiting.pop(lang)[0])])
            if total >= 4 * unit_bytes:
                yield from _rows([_unit(lang, shard, some) for lang, (some, _) in waiting.items()])
                waiting, total = {}, 0
        for lang, (some, _) in waiting.items():
            yield from _rows([_unit(lang, shard, some)])

    return rows.mapInArrow(run, UNITS)


def _written(units: DataFrame) -> DataFrame:
    """The units as a table of one row a row group, so readers hold a unit at a time."""
    spark = units.sparkSession
    path = new_path(spark)
    units.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return spark.read.schema(units.schema).parquet(path)


def _rows(units: list[tuple | None]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in UNITS.split(", ")]
    for unit in units:
        if unit:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(unit, kinds, strict=True)], names)


class Unit:
    """A unit read back, with the phrases that are still alive at every size."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda name: batch.column(name)[row]
        self.lang, self.shard = cell("lang").as_py(), cell("shard").as_py()
        self.codes = np.frombuffer(cell("codes").as_buffer(), "<i4")
        self.fresh = np.unpackbits(np.frombuffer(cell("fresh").as_buffer(), np.uint8), count=len(self.codes)).astype(bool)
        self.letters = cell("letters").as_buffer()
        self.ends = np.frombuffer(cell("ends").as_buffer(), np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        lang = self.lang.encode()
        salt = RangeHashes(np.frombuffer(lang, np.uint8)).of(np.array([0]), np.array([len(lang)]))[0]
        self.hashes = mixed(RangeHashes(np.frombuffer(self.letters, np.uint8)).of(self.starts, self.ends) ^ salt)

    def words(self) -> pa.Array:
        offsets = np.concatenate(([0], self.ends))
        return pa.Array.from_buffers(pa.large_string(), len(self.ends), [None, pa.py_buffer(offsets), self.letters]).cast(pa.string())

    def word(self, code: int) -> bytes:
        return self.letters[int(self.starts[code]) : int(self.ends[code])].to_pybytes()

    def alive(self, unions: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the phrases one word longer than the last union, whose two
        shorter phrases are in it."""
        values = self.hashes[self.codes]
        at = np.flatnonzero(unions[0].has(self.hashes)[self.codes])
        values = values[at]
        for size in range(2, len(unions) + 2):
            if size > 2:
                kept = unions[size - 2].has(values)
                at, values = at[kept], values[kept]
            if len(at) < 2:
                return at[:0], values[:0]
            both = np.flatnonzero(np.diff(at) == 1)
            if size == 2:
                both = both[~self.fresh[at[both] + 1]]
            # (a b) and (b c) make a b c; sizes differ in their factor.
            values = mixed(values[both] * power(2 * size + 1) + self.hashes[self.codes[at[both] + size - 1]])
            at = at[both]
        return at, values


class Bits:
    """A set of hashes as a bitmap over their leading bits: no member is missed."""

    def __init__(self, log: int, bits: np.ndarray):
        self.log, self.bits = log, bits

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values >> U64(64 - self.log)
        return (self.bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bitmap(keys: DataFrame) -> Bits:
    """The keys (long) of a written table; at most 2**MAX_BITS bits reach the driver."""
    log = int(np.clip(int(keys.count() * 32).bit_length(), BLOCK, MAX_BITS))
    place = F.shiftrightunsigned("key", 64 - log)
    blocks = (
        keys.select(F.shiftright(place, BLOCK).alias("block"), place.bitwiseAND(F.lit((1 << BLOCK) - 1)).alias("bit"))
        .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros(1 << (log - 3), np.uint8)
    size = 1 << (BLOCK - 3)
    for row in blocks.collect():
        bits[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return Bits(log, bits)


def _over_units(units: DataFrame, make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from make(Unit(batch, row))

    return units.mapInArrow(run, schema)


# --- mining and counting ----------------------------------------------------------------------


def _word_counts(unit: Unit) -> Iterator[pa.RecordBatch]:
    n = np.bincount(unit.codes, minlength=len(unit.ends))
    words = unit.words()
    for at in range(0, len(n), 50_000):
        part = slice(at, at + 50_000)
        some = words.slice(at, 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array([unit.lang] * len(some)), some, pa.array(unit.hashes[part].view(np.int64)), pa.array(n[part].astype(np.int64))],
            ["lang", "phrase", "key", "n"],
        )


def _local(shared, unit: Unit) -> Iterator[pa.RecordBatch]:
    keys, n = np.unique(unit.alive(shared.value)[1] & SENT, return_counts=True)
    for at in range(0, len(keys), 50_000):
        some = keys[at : at + 50_000].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([unit.lang] * len(some)), pa.array([unit.shard] * len(some), pa.int32()), pa.array(some), pa.array(n[at : at + 50_000].astype(np.int64))],
            ["lang", "shard", "key", "n"],
        )


def _exact(shared, unit: Unit) -> Iterator[pa.RecordBatch]:
    """Occurrences in the unit of every phrase of the union, told apart by their words."""
    unions: list[Bits] = shared.value
    vocabulary = np.int64(len(unit.ends))
    ids = np.zeros(len(unit.codes), np.int64)  # of the phrase that starts here, one word shorter
    ids[:] = unit.codes
    for size in range(2, len(unions) + 1):
        at, values = unit.alive(unions[: size - 1])
        at = at[unions[size - 1].has(values)]
        if not len(at):
            return
        keys = ids[at] * vocabulary + unit.codes[at + size - 1]
        _, first, same, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        ids[at] = same
        for begin in range(0, len(first), 50_000):
            part = slice(begin, begin + 50_000)
            codes = unit.codes[at[first[part]][:, None] + np.arange(size)]
            known = {c: unit.word(c) for c in np.unique(codes).tolist()}
            phrases = [b" ".join([known[c] for c in row]).decode() for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit.lang] * len(phrases)), pa.array(phrases, pa.string()), pa.array([size] * len(phrases), pa.int32()), pa.array(n[part].astype(np.int64))],
                ["lang", "phrase", "size", "n"],
            )


def phrase_counts(docs: DataFrame, support: int, longest: int = LONGEST, shards: int = 8, unit_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of every phrase of at most ``longest`` words that occurs
    ``support`` times or more, (lang, n) words of every language)."""
    if support < 1 or longest < 2:
        raise ValueError("a support of at least one and phrases of at least two words")
    spark = docs.sparkSession
    units = _written(encoded(docs, shards, unit_bytes))
    shares = units.groupBy("lang", "shard").agg(F.sum("n_words").alias("here"))
    totals = saved(shares.groupBy("lang").agg(F.sum("here").alias("n")))
    # A row per language and shard.
    wide = "decimal(38,0)"
    lowered = (F.col("here").cast(wide) * support + F.col("n") - 1) / F.col("n")
    local = saved(shares.join(totals, "lang").select("lang", "shard", F.floor(lowered).cast("long").alias("least")))
    words = saved(
        _over_units(units, _word_counts, "lang string, phrase string, key long, n long")
        .groupBy("lang", "phrase", "key").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    )
    unions = [bitmap(words.select("key"))]
    for _ in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(unions)
        mined = (
            _over_units(units, lambda unit, shared=shared: _local(shared, unit), "lang string, shard int, key long, n long")
            .groupBy("lang", "shard", "key").agg(F.sum("n").alias("n"))
            .join(local, ["lang", "shard"]).filter("n >= least")
        )
        unions = [*unions, bitmap(saved(mined.select("key").distinct()))]
    shared = spark.sparkContext.broadcast(unions)
    longer = (
        _over_units(units, lambda unit: _exact(shared, unit), "lang string, phrase string, size int, n long")
        .groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    )
    return saved(words.select("lang", "phrase", F.lit(1).alias("size"), "f").unionByName(longer)), totals


# --- scores -------------------------------------------------------------------------------------

SCALE = 2_000_000


def collocations(
    docs: DataFrame, support: int = 30, longest: int = LONGEST, inside: int = 80, top: int = 2000, shards: int = 8, unit_bytes: int = 4 << 20
) -> DataFrame:
    """The ``top`` phrases of every language by their lowest-scoring cut: lang, rank, phrase, a,
    l, r, n, score. A phrase is dropped where a longer one that holds it has at least ``inside``
    hundredths of its occurrences.
    """
    counts, totals = phrase_counts(docs, support, longest, shards, unit_bytes)
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")
    cut = lambda first, last: F.array_join(F.slice("words", first, last), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("words")).select(
        "lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("first"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # A part is a phrase of the counts itself: what occurs as often as the whole has full support.
    scored = (
        cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
        .withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = candidates.filter("size > 2").select("lang", "size", "a", F.split("phrase", " ").alias("words"))
    within = (
        longer.select("lang", "size", "a", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("width"))
        .select("lang", "a", "words", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("at"))
        .select("lang", cut(F.col("at"), F.col("width")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    )
    hundred = F.lit(100).cast("decimal(20,0)")
    left = scored.join(within, ["lang", "phrase"], "left").filter(
        F.col("above").isNull() | (hundred * F.col("above") < F.lit(inside).cast("decimal(20,0)") * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (
        left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    )
