"""WARC archives written and read back, with records found by a verified boundary chain.

Writing: one record per page, appended by Spark's text writer (the separator of records is the
line separator), so archives go to any store Spark can write and hold exactly the bytes given.
Among pages with equal payloads the one with the largest page_id is a response, the others are
revisits without a body.

Reading: archives are split wherever the engine likes. The reader cuts at the magic of a record
header, so every piece starts at a candidate record; tasks emit for each its offset in the split
and the successor its Content-Length promises. A payload may contain the magic, even whole
records, so only what is reachable from a file's start counts: within a split the chain of each
entry is followed to the first successor outside; between splits pointers jump, doubling their
reach every round. Candidates off the chain are payload.

Defined cases: a null or empty html is an empty payload; a null url is empty, line breaks in it
are spaces; repeated rows that are the largest of their payload are all responses; pages whose
page_id is null are skipped; an empty table gives no archives and no records; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_path, saved

MAGIC = b"WARC/1.0\r\n"
GAP = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, 4 letters each."""
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(F.sha1(data), 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def with_originals(pages: DataFrame, salts: int = 32) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to: the largest page_id with the same payload,
    null for that page itself."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.filter("page_id is not null").withColumns(
        {"payload_bytes": F.octet_length(body).cast("long"), "_sha1": F.sha1(body), "payload_digest": base32_sha1(body)}
    )
    # Map-side combining keeps a payload shared by a third of all pages to a row a task; only
    # repeated payloads go back to the pages, each in as many places as there are salts.
    originals = (
        narrow.groupBy("_sha1").agg(F.max("page_id").alias("_original"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("_sha1", "_original", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    ids = narrow.select("page_id", "_sha1", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("_salt"))
    revisits = saved(
        ids.join(originals, ["_sha1", "_salt"]).filter("page_id <> _original")
        .select("page_id", F.col("_original").alias("refers_to"), "_sha1").distinct()
    )  # written, so that its size is known when the join below is planned: few need no shuffle of pages
    return narrow.join(revisits, ["page_id", "_sha1"], "left").drop("_sha1")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write page_id, url, html of every page as WARC records."""
    rows = with_originals(pages.select("page_id", "url", "html"))
    html, revisit = F.coalesce("html", F.lit("")), F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(header, F.when(revisit, "").otherwise(html))
    rows.select(record.alias("value")).write.option("lineSep", GAP.decode()).text(path)


NAMES = ("file", "split", "at", "size", "reach", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "whole")
CANDIDATE = (
    "file string, split long, at long, size long, reach long, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, whole boolean"
)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, with the file and split they were read from, in file order."""
    return (
        spark.read.option("lineSep", MAGIC.decode()).text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"),
        )
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, int, bytes]]]:
    """Per batch (file, split, offset in the split, size, bytes). A file's very first piece is what
    stands before its first magic; every other piece follows one, which its size includes."""
    ends: dict[tuple[str, int], int] = {}
    for batch in batches:
        rows = []
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            at = ends.get((file, split))
            bare = at is None and split == 0
            at = at or 0
            size = len(value) + (0 if bare else len(MAGIC))
            ends[file, split] = at + size
            rows.append((file, split, at - bare, size, value))  # -1: before the first magic
        yield rows


def parsed(value: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the length of the header with its blank line; None if it is no header."""
    end = value.find(GAP)
    if end < 0:
        return None
    try:
        lines = value[:end].decode().split("\r\n")
    except UnicodeDecodeError:
        return None
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    return (fields, end + len(GAP)) if len(fields) == len(lines) and fields.get("Content-Length", "").isdigit() else None


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def candidates(raw: DataFrame) -> DataFrame:
    """One row per piece: its offset and size, how far its record reaches by Content-Length, what
    its header says, and the digest of a payload that lies whole inside the piece."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _placed(batches):
            out = []
            for file, split, at, size, value in rows:
                found = parsed(value) if at >= 0 else None
                if found is None:
                    out.append((file, split, at, size, None, None, None, None, None, None, False))
                    continue
                fields, start = found
                body = int(fields["Content-Length"])
                whole = size == len(MAGIC) + start + body + len(GAP) and value.endswith(GAP)
                revisit = fields.get("WARC-Type") == "revisit"
                digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") if revisit else _digest(value[start : start + body]) if whole else None
                n_bytes = int(fields["X-Payload-Length"]) if revisit and fields.get("X-Payload-Length", "").isdigit() else body
                out.append((
                    file, split, at, size, len(MAGIC) + start + body + len(GAP), _page(fields.get("WARC-Record-ID")),
                    fields.get("WARC-Type"), _page(fields.get("WARC-Refers-To")), n_bytes, digest, whole,
                ))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=list(NAMES)), schema=_SCHEMA, preserve_index=False)

    return raw.mapInArrow(scan, CANDIDATE)


_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()), ("page_id", pa.int64()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("whole", pa.bool_()),
    ]
)


def split_bases(sizes: DataFrame) -> DataFrame:
    """file, split, base, limit: where the first piece of each split stands and the last ends."""
    totals = sizes.groupBy("file", "split").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("split")
    return totals.select("file", "split", (F.sum("size").over(before) - F.col("size")).alias("base"), F.sum("size").over(before).alias("limit"))


def chained(found: DataFrame) -> DataFrame:
    """Candidates with their place in the file, ``real`` (reachable from its start) and ``owner``:
    the offset of the real record each belongs to."""
    bases = saved(split_bases(found))
    nodes = found.filter("at >= 0").join(bases, ["file", "split"]).withColumns(
        {"offset": F.col("base") + F.col("at"), "next": F.col("base") + F.col("at") + F.col("reach")}
    )
    # Within a split: the first successor outside it, for every candidate. A split bounds a group.
    inner = nodes.select("file", "split", "offset", "next", "limit").groupBy("file", "split").applyInPandas(_exits, "file string, offset long, exit long")
    jumps = saved(inner.filter("exit is not null"))
    starts = bases.filter("split = 0").select("file", F.lit(0).cast("long").alias("offset"))
    entries = jumps.select("file", F.col("exit").alias("offset")).union(starts).distinct()
    jumps_now = saved(jumps.join(entries, ["file", "offset"]))
    reached = saved(starts)
    while True:
        ahead = reached.join(jumps_now, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        more = saved(reached.union(ahead).distinct())
        grown = more.count() > reached.count()
        discard(reached)
        reached = more
        if not grown:
            break
        second = jumps_now.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_exit"))
        farther = saved(jumps_now.join(second, ["file", "exit"], "left").select("file", "offset", F.col("_exit").alias("exit")).filter("exit is not null"))
        discard(jumps_now)
        jumps_now = farther
    # The chain enters a split at most once; splits it skips lie inside one record.
    marked = nodes.drop("base", "limit").join(_entries(bases, reached), ["file", "split"], "left")
    names = [c for c in marked.columns if c != "entry"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema if f.name != "entry")
    walked = marked.groupBy("file", "split").applyInPandas(
        lambda rows: _walk(rows)[[*names, "real", "owner"]], f"{kinds}, real boolean, owner long"
    )
    walked = saved(walked)
    # Pieces before the first real record of a split belong to the last one of an earlier split.
    last = walked.filter("real").groupBy("file", "split").agg(F.max("offset").alias("last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = bases.select("file", "split").join(last, ["file", "split"], "left").select(
        "file", "split", F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    return walked.join(carried, ["file", "split"], "left").withColumn("owner", F.coalesce("owner", "carried")).drop("carried")


def _entries(bases: DataFrame, reached: DataFrame) -> DataFrame:
    """file, split, entry: the reached offset inside each split, by one ordered pass per file."""
    marks = bases.select("file", F.col("base").alias("place"), F.lit(0).alias("kind"), "split", "limit").unionByName(
        reached.select("file", F.col("offset").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("split"), F.lit(None).cast("long").alias("limit"))
    )
    order = Window.partitionBy("file").orderBy("place", "kind")
    found = marks.withColumns(
        {"split": F.last("split", ignorenulls=True).over(order), "limit": F.last("limit", ignorenulls=True).over(order)}
    ).filter("kind = 1 and place < limit")
    return found.groupBy("file", "split").agg(F.min("place").alias("entry"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    limit = rows["limit"].iloc[0]
    exits: dict[int, int | None] = {}
    ordered = rows.sort_values("offset", ascending=False)
    for offset, ahead in zip(ordered["offset"].tolist(), ordered["next"].astype("Int64").tolist(), strict=True):
        exits[offset] = None if ahead is pd.NA else ahead if ahead >= limit else exits.get(ahead)
    out = pd.DataFrame({"file": rows["file"].iloc[0], "offset": list(exits), "exit": pd.array(list(exits.values()), "Int64")})
    return out


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Follow the chain from the split's entry: which candidates are real, and whose the others are."""
    rows = rows.sort_values("offset").reset_index(drop=True)
    ahead = dict(zip(rows["offset"].tolist(), rows["next"].astype("Int64").tolist(), strict=True))
    real = set()
    at = rows["entry"].astype("Int64").iloc[0]
    while at is not pd.NA and at in ahead:
        real.add(at)
        at = ahead[at]
    rows["real"] = rows["offset"].isin(real)
    rows["owner"] = rows["offset"].where(rows["real"]).ffill().astype("Int64")
    return rows


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every real record."""
    found = saved(candidates(pieces(spark, path)))
    rows = saved(chained(found))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = rows.filter("real and (whole or record_type = 'revisit')").select(*columns)
    # Records whose payload holds a magic: their pieces are read again and joined in order.
    parts = saved(rows.filter("not real or not (whole or record_type = 'revisit')").select("file", "offset", "owner"))
    if parts.isEmpty():
        return whole
    raw = pieces(spark, path).mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_pylist([dict(zip(("file", "split", "at", "size", "value"), r, strict=True)) for r in rows], _VALUE)
            for rows in _placed(batches)
        ),
        "file string, split long, at long, size long, value binary",
    )
    # Splits may be cut differently this time, so their bases come from this reading.
    bases = split_bases(raw.select("file", "split", "size"))
    order = Window.partitionBy("file").orderBy("offset", "kind")
    marks = bases.select("file", F.col("base").alias("offset"), F.lit(0).alias("kind"), "split", "base", F.lit(None).cast("long").alias("owner"))
    wanted = (
        marks.unionByName(parts.withColumns({"kind": F.lit(1), "split": F.lit(None).cast("long"), "base": F.lit(None).cast("long")}))
        .withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("split", "base")})
        .filter("kind = 1").select("file", "split", (F.col("offset") - F.col("base")).alias("at"), "offset", "owner")
    )
    wanted = saved(wanted)  # its size is known when the join is planned
    records = raw.join(wanted, ["file", "split", "at"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for parts in batch.column("parts").to_pylist():
                data = MAGIC.join(p["value"] for p in parts)
                fields, start = parsed(data)
                digests.append(_digest(data[start : start + int(fields["Content-Length"])]))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("owner"), pa.array(digests)], ["file", "offset", "payload_digest"])

    digests = records.select("file", "owner", "parts").mapInArrow(rebuilt, "file string, offset long, payload_digest string")
    broken = rows.filter("real and not (whole or record_type = 'revisit')").drop("payload_digest").join(digests, ["file", "offset"])
    return whole.unionByName(broken.select(*columns))


_VALUE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("value", pa.binary())])


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the work folder and read the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
