"""WARC archives with a two-level capture index.

Records are written as single gzip members, so any of them can be read by its
byte range. The index has one entry per record, sorted by reversed-host URL key
and page; entries are packed into compressed blocks, and a sparse directory
keeps the first key of every block. A lookup finds its block by binary search,
then its entry, then reads the record's bytes.

Archives and index lie in the cluster's shared folder. Every task writes files
of its own name; only those named in the stored manifest count, so a task that
is run again leaves nothing behind in the results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import scan_partitions, stored
from ledgerloom.session import shared_dir

FILE_BYTES = 256 << 20
BLOCK_ENTRIES = 1000
#: Neighbouring ranges are read at once up to this gap and length.
GAP_BYTES, SPAN_BYTES = 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD_ID = "urn:ledgerloom:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = ["key", "page_id", "file", "offset", "length"]
ENTRY_SCHEMA = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed: ``org,example,www)/path?query``, lower case.

    The scheme, a port of 80 or 443 and the fragment are left out. A null or
    unreadable URL is its own text.
    """
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def sort_key(key: str, page_id: int | None) -> str:
    """One string that orders entries by URL key, then page, no page first.

    The key ends in two zero characters, and a zero inside it is followed by a
    one, so a key stands in front of every longer one that starts with it.
    """
    closed = key.replace("\0", "\0\1") + "\0\0"
    return f"{closed}{'-' if page_id is None else f'{page_id + 2**63:020d}'}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    """``value`` without characters that would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_text(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def packed(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def opened(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page with ``revisit`` and ``refers_to``: the smallest page of an equal payload.

    Payloads are equal when their SHA-256 is. Counting is combined map-side, so
    one payload in a third of all pages is one row per task; the stored result
    has one row per different payload, and Spark can split the join on it.
    """
    rows = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("_same"))
    first = stored(rows.groupBy("_same").agg(F.min("page_id").alias("_first")), "warc-payloads")
    later = ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.octet_length("html") >= least_bytes)
    return rows.join(first, "_same").select(
        "page_id", "url", "html", F.when(later, F.col("_first")).alias("refers_to"), later.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``page_id, url, html, refers_to, revisit``; returns the stored manifest of entries."""

    def run(batches):
        system, place = fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        try:
            for batch in batches:
                entries = []
                for page_id, url, text, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is not None and at >= file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    data = packed(record(page_id, url, text.encode("utf-8"), refers_to, revisit))
                    out.write(data)
                    entries.append((url_key(url), page_id, name, at, len(data)))
                    at += len(data)
                yield entry_batch(entries)
        finally:
            if out is not None:
                out.close()

    fs_, place = fs.FileSystem.from_uri(folder)
    fs_.create_dir(place, recursive=True)
    rows = pages.select("page_id", "url", "html", "refers_to", "revisit")
    return stored(rows.mapInArrow(run, ENTRY_SCHEMA), "warc-manifest")


def entry_batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in entries], t) for k, t in enumerate(kinds)], names=ENTRY)


def write_index(entries: DataFrame, folder: str, parts: int, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sort the entries into index files of compressed blocks; returns the stored directory.

    The directory has one row per index file: its first and last key, and the
    first key, offset and length of every block. Pages are part of the sort
    key, so a URL with very many captures spreads over files.
    """

    def run(batches):
        system, place = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.idx.gz"
        keys: list[str] = []
        offsets: list[int] = []
        lengths: list[int] = []
        block: list[list] = []
        at, last = 0, None

        def close(out) -> int:
            data = packed("\n".join(json.dumps(e) for e in block).encode(), 6)
            out.write(data)
            keys.append(sort_key(block[0][0], block[0][1]))
            offsets.append(at)
            lengths.append(len(data))
            block.clear()
            return at + len(data)

        with system.open_output_stream(f"{place}/{name}", compression=None) as out:
            for batch in batches:
                for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block.append(list(e[:5]))
                    last = sort_key(e[0], e[1])
                    if len(block) >= block_entries:
                        at = close(out)
            if block:
                at = close(out)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([keys[0]]),
                    pa.array([last]),
                    pa.array([keys], pa.list_(pa.string())),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                ],
                names=["index", "first", "last", "keys", "offsets", "lengths"],
            )

    fs_, place = fs.FileSystem.from_uri(folder)
    fs_.create_dir(place, recursive=True)
    order = F.asc("key"), F.asc_nulls_first("page_id")  # that of sort_key
    placed = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order, "file", "offset").select(*ENTRY)
    schema = "index string, first string, last string, keys array<string>, offsets array<long>, lengths array<long>"
    return stored(placed.mapInArrow(run, schema), "warc-directory")


class BlockReader:
    """One index file, with its latest block at hand."""

    def __init__(self, folder: str, index: str, keys, offsets, lengths) -> None:
        self.file = opened(f"{folder}/{index}")
        self.keys, self.offsets, self.lengths = keys, offsets, lengths
        self.at, self.block = -1, []

    def entries(self, b: int) -> list[list]:
        if b != self.at:
            data = self.file.read_at(self.lengths[b], self.offsets[b])
            self.at, self.block = b, [json.loads(x) for x in unpacked(data).decode().split("\n")]
        return self.block

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """The entries of one key and page: the block by binary search, then the entry."""
        wanted = sort_key(key, page_id)
        b = max(0, bisect_right(self.keys, wanted) - 1)
        while b > 0 and self.keys[b] == wanted:
            b -= 1
        while b < len(self.keys) and self.keys[b] <= wanted:
            block = self.entries(b)
            at = bisect_right(block, wanted, key=lambda e: sort_key(e[0], e[1]))
            while at and sort_key(block[at - 1][0], block[at - 1][1]) == wanted:
                at -= 1
                yield block[at]
            b += 1


def find_entries(directory: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The entries of all ``url, page_id`` in ``wanted``.

    Wanted keys and the first keys of the index files are ordered together, so
    a wanted key belongs to the last file that starts before it (equal keys
    never lie in two files). Where that file starts in an earlier range, its
    name comes from the summaries of the ranges, one small row each. A file's
    keys are then looked up by one task.
    """

    def keyed(batches):
        for batch in batches:
            pairs = {(url_key(u), p) for u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            rows = [(sort_key(*pair), *pair) for pair in pairs]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["at", "key", "page_id"]
            )

    def routed(batches):
        part = name = None
        for batch in batches:
            rows = []
            for part, file, key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is not None:
                    name = file
                else:
                    rows.append((part, name, key, page_id))
            yield route_batch(rows)
        if name is not None:
            yield route_batch([(part, name, None, None)])

    def route_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64()]
        names = ["part", "index", "key", "page_id"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    asked = wanted.select("url", "page_id").mapInArrow(keyed, "at string, key string, page_id long").distinct()
    starts = directory.select(F.col("first").alias("at"), F.col("index").alias("file"))
    marks = starts.unionByName(asked, allowMissingColumns=True)
    order = F.asc("at"), F.asc_nulls_last("file")  # a file before the keys it starts with
    ranged = marks.repartitionByRange(scan_partitions(wanted), "at").sortWithinPartitions(*order)
    route = "part int, index string, key string, page_id long"
    places = ranged.select(F.spark_partition_id().alias("part"), "file", "key", "page_id")
    routes = stored(places.mapInArrow(routed, route), "warc-routes")
    named = routes.where("key is not null and index is not null")
    each = routes.groupBy("part").agg(F.max(F.when(F.col("key").isNull(), F.col("index"))).alias("last"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    carried = each.select("part", F.last("last", ignorenulls=True).over(earlier).alias("index")).where("index is not null")
    unnamed = routes.where("key is not null and index is null").drop("index")
    keys = named.unionByName(unnamed.join(carried, "part")).select("index", "key", "page_id")

    def looked(part: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = []
        for row in part.to_pylist():
            reader = BlockReader(folder, row["index"], row["keys"], row["offsets"], row["lengths"])
            pairs = zip(asked.column("key").to_pylist(), asked.column("page_id").to_pylist(), strict=True)
            for pair in sorted(pairs, key=lambda r: sort_key(*r)):
                found += reader.find(*pair)
        return pa.Table.from_batches([entry_batch(found)])

    return (
        directory.groupBy("index")
        .cogroup(keys.groupBy("index"))
        .applyInArrow(looked, ENTRY_SCHEMA)
    )


def read_one(raw: bytes) -> dict:
    fields, http, payload = parse(raw)
    revisit = fields["WARC-Type"] == "revisit"
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != told:
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    length = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(RECORD_ID)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": int(length.removeprefix("Content-Length: ")),
        "payload_digest": told,
        "html": None if revisit else payload.decode("utf-8"),
    }


def read_records(entries: DataFrame, folder: str, parts: int) -> DataFrame:
    """Read entries' records by byte range, neighbouring ranges together.

    Returns ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, html`` (null for revisits, whose payload is that of
    ``refers_to``). Block and payload digests are checked.
    """
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    )
    kinds = pa.schema(
        [(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in schema.split(", "))]
    )

    def run(batches):
        name = file = None
        for batch in batches:
            spans: list[tuple[str, list[tuple[int, int]]]] = []
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans and spans[-1][0] == f:
                    own = spans[-1][1]
                    end = own[-1][0] + own[-1][1]
                    if 0 <= o - end <= GAP_BYTES and o + n - own[0][0] <= SPAN_BYTES:
                        own.append((o, n))
                        continue
                spans.append((f, [(o, n)]))
            for f, own in spans:
                if f != name:
                    name, file = f, opened(f"{folder}/{f}")
                start = own[0][0]
                data = file.read_at(own[-1][0] + own[-1][1] - start, start)
                rows = [read_one(unpacked(data[o - start : o - start + n])) for o, n in own]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    near = entries.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(run, schema)


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Write every page as a record, index the archives, and read all pages back by lookup.

    One row per input row, as ``read_records``. Of pages with equal payloads of
    at least ``least_bytes`` bytes, the smallest id is a response and the
    others revisit it; rows that repeat id and payload are the same page and
    keep its type. A null html is an empty payload, a null url has an empty
    key, a null id is larger than any other; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    rows = pages.select(
        pages[id_column].cast("long").alias("page_id"),
        pages[url_column].alias("url"),
        F.coalesce(pages[html_column], F.lit("")).alias("html"),
    )
    parts = max(4, scan_partitions(pages))
    manifest = write_archives(with_roles(rows, least_bytes), folder)
    directory = write_index(manifest, folder, parts)
    found = find_entries(directory, rows.select("url", "page_id"), folder)
    return read_records(found, folder, parts)
