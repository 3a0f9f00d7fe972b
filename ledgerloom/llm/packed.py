"""Corpus-wide counts of hashed keys, exchanged in packed arrays.

Texts are read in blocks of bounded size. A block counts its keys and sends
each bucket of keys one row: packed hashes and counts. A bucket adds up all
blocks and answers every block with the corpus-wide count of each key it sent,
in the order it was sent. A key that stands everywhere is one entry per block,
so no key makes a bucket grow with its number of occurrences. Buckets are as
many as the partitions the table is read in, so both sides stay bounded.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import UPPER

KEY_BYTES = 6
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
SENT = "kind int, bucket int, block long, keys binary, counts binary"
PART = F.spark_partition_id  # of the scan itself, also below a union
REPLY = "block long, kind int, bucket int, counts binary, facts string"


def blocks_of(batches: Iterator[pa.RecordBatch], text: int, most_chars: int) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows in blocks of about ``most_chars`` characters, numbered within the job.

    The first column is the partition the row is read in (``PART``), so a
    second pass over the same stored table makes the same blocks.
    """
    part = number = held = 0
    rows: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = row[0]
            rows.append(row)
            held += len(row[text] or "")
            if held >= most_chars:
                yield part << 24 | number, rows
                rows, held, number = [], 0, number + 1
    if rows:
        yield part << 24 | number, rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups hashes by bucket, and where each bucket begins in it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def sent(
    kind: int, block: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, width: int = KEY_BYTES
) -> pa.RecordBatch:
    """One row per bucket that has keys, cut to ``width`` bytes inside their bucket."""
    order, at = dealt(hashes, buckets)
    keys = (hashes[order] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    keys = np.ascontiguousarray(keys)
    held = counts[order].astype("<u4")
    full = [b for b in range(buckets) if at[b] < at[b + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(full), pa.int32()),
            pa.array(full, pa.int32()),
            pa.array([block] * len(full), pa.int64()),
            pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
            pa.array([held[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
        ],
        names=["kind", "bucket", "block", "keys", "counts"],
    )


def wide(keys: list[bytes], width: int) -> np.ndarray:
    """Packed keys as numbers, of 64 bits unless four bytes hold them."""
    if width == 4:
        return np.frombuffer(b"".join(keys), "<u4")
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def added_up(
    rows: DataFrame, facts: Callable[[int, np.ndarray], str | None] | None = None, width: int = KEY_BYTES
) -> DataFrame:
    """Each row's keys with their counts over all blocks; ``facts`` of a bucket's totals go with block -1."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = table.column("keys").to_pylist()
        sizes = [len(k) // width for k in keys]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        numbers = wide(keys, width)
        del keys, table
        order = np.argsort(numbers, kind="stable")
        ordered = numbers[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        totals = np.add.reduceat(counts[order].astype(np.int64), first)
        every = np.empty(len(numbers), "<u4")
        every[order] = np.repeat(np.minimum(totals, 2**32 - 1).astype("<u4"), np.diff(np.append(first, len(ordered))))
        del numbers, order, ordered, counts
        ends = np.cumsum(sizes)
        out = [every[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
        told = facts(kind, totals) if facts else None
        return pa.table(
            {
                "block": pa.array([*blocks, -1], pa.int64()),
                "kind": pa.array([kind] * (len(out) + 1), pa.int32()),
                "bucket": pa.array([bucket] * (len(out) + 1), pa.int32()),
                "counts": pa.array([*out, None], pa.binary()),
                "facts": pa.array([None] * len(out) + [told], pa.string()),
            }
        )

    return rows.groupBy("kind", "bucket").applyInArrow(run, REPLY)


def packed_texts(block: int, kind: int, **columns: pa.Array) -> pa.RecordBatch:
    """A block's own rows, compressed, to meet the replies it gets."""
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            pa.array([kind], pa.int32()),
            pa.array([0], pa.int32()),
            pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            pa.array([None], pa.string()),
        ],
        names=["block", "kind", "bucket", "counts", "facts"],
    )


def met(table: pa.Table, text_kind: int) -> tuple[pa.Table, dict[int, dict[int, bytes]]]:
    """A block's own rows, and its replies by kind and bucket."""
    parts: defaultdict[int, dict[int, bytes]] = defaultdict(dict)
    columns = (table.column(c).to_pylist() for c in ("kind", "bucket", "counts"))
    for kind, bucket, data in zip(*columns, strict=True):
        parts[kind][bucket] = data
    if not parts[text_kind]:
        raise ValueError("the table changed between two passes; store it before")
    return pa.ipc.open_stream(parts[text_kind][0]).read_all(), parts


class BlockWords:
    """The lower-cased words of a block's texts as numbers of the block's own vocabulary."""

    def __init__(self, texts: list[str], reserved: int = 0) -> None:
        ids: defaultdict[bytes, int] = defaultdict(itertools.count(reserved).__next__)
        self.runs = [list(map(ids.__getitem__, t.encode().translate(LOWER).split())) for t in texts]
        known = [int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in ids]
        self.hashes = np.array([*range(1, reserved + 1), *known], np.uint64)


def answered(hashes: np.ndarray, replies: dict[int, bytes], buckets: int) -> np.ndarray:
    """The corpus-wide counts of a block's keys, from the replies by bucket."""
    order, at = dealt(hashes, buckets)
    out = np.empty(len(hashes), np.int64)
    for b in range(buckets):
        if at[b] < at[b + 1]:
            got = np.frombuffer(replies.get(b, b""), "<u4")
            if len(got) != at[b + 1] - at[b]:
                raise ValueError("the table changed between two passes; store it before")
            out[order[at[b] : at[b + 1]]] = got
    return out
