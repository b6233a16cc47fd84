"""Packing token ids into fixed rows by best-fit decreasing.

Documents are encoded, an end id is added, and documents longer than a row are split into segments without losing an
id. Segments are packed a window at a time: longest first, each into the open row whose free space is the least that
still holds it. A segment tree over capacities finds that row in logarithmic time. Rows are written as fixed-width id
matrices with cumulative segment lengths and positions that restart at each segment.

Nothing is shuffled: every task packs its own input in windows of WINDOW ids, so memory is bounded, a lost task packs
the same input again to the same rows, and hot sources or copies do not matter.

Defined results: a null or empty text is one segment of the end id alone, so that every document has a place; repeated
rows are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids gathered before a window is packed.
WINDOW = 1 << 21
SCHEMA = (
    "shard int, row long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<long>, starts array<long>"
)


class Capacities:
    """Segment tree over free capacities 0..top: the least capacity, of those that open rows have, that is enough."""

    def __init__(self, top: int):
        self.size = 1
        while self.size <= top:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = self.size + capacity
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity of at least `need`, removed from the tree; None if there is none."""
        count, at = self.count, self.size + need
        while not count[at]:
            while at & 1:  # a right child: all of the parent lies behind
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not count[at]:
                at += 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at //= 2
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of indices into lengths (each at most width), longest first; ties keep their order."""
    open_rows, rows = Capacities(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_rows.take(lengths[i])
        if found is None:
            rows.append([i])
            left = width - lengths[i]
            at = len(rows) - 1
        else:
            capacity, at = found
            rows[at].append(i)
            left = capacity - lengths[i]
        if left:
            open_rows.add(left, at)
    return rows


def split(ids: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) segments of at most width ids that together are the document."""
    return [(at, ids[at : at + width]) for at in range(0, len(ids), width)]


def pack(
    docs: DataFrame, encode, key: str = "doc_id", text: str = "text", width: int = 2048, end_id: int = 50256, pad_id: int = 50256
) -> DataFrame:
    """Packed rows (SCHEMA). encode(texts) yields ids of each text as numpy unsigned 32-bit arrays, on the workers.

    ids: the row's ids and padding, positions: place within the document segment and 0 for padding, both as
    little-endian unsigned 32-bit; cu_seqlens: 0 and the cumulative segment lengths; starts: where each segment
    begins in its document.
    """

    def window(segments: list[tuple[int | None, int, np.ndarray]], shard: int, first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(9)]
        steps = np.arange(width, dtype="<u4")
        for row in best_fit_decreasing([len(s[2]) for s in segments], width):
            own = [segments[i] for i in row]
            lengths = [len(s[2]) for s in own]
            total = sum(lengths)
            ids, places = np.full(width, pad_id, dtype="<u4"), np.zeros(width, dtype="<u4")
            ids[:total] = np.concatenate([s[2] for s in own])
            at = 0
            for n in lengths:
                places[at : at + n] = steps[:n]
                at += n
            values = (
                shard, first + len(columns[0]), total, len(own), ids.tobytes(), np.cumsum([0, *lengths]).tolist(),
                places.tobytes(), [s[0] for s in own], [s[1] for s in own],
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = (
            pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()),
            pa.list_(pa.int64()),
        )
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[tuple[int | None, int, np.ndarray]] = []
        held = made = shard = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                for start, part in split(np.append(ids, np.uint32(end_id)), width):
                    segments.append((doc, start, part))
                    held += len(part)
                if held >= WINDOW:
                    out = window(segments, shard, made)
                    made += out.num_rows
                    segments, held = [], 0
                    yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))
        if segments:
            out = window(segments, shard, made)
            yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("shard"))
    return rows.mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: one id matrix row, its cumulative lengths and positions a record."""
    packed.write.option("compression", "zstd").parquet(path)
