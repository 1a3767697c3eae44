"""Packing of token ids into rows of fixed length, best fit decreasing.

Texts are encoded by the library of the model. A text longer than a row is cut
into full rows and a rest (lossless: each segment carries its offset). Segments
of a window of texts, longest first, each go to the fullest row that still has
room: a segment tree over the capacities 0..LENGTH holds the open rows and finds
the smallest sufficient capacity in log steps. Windows are consecutive texts of
a partition with about WINDOW tokens, so memory is bounded and a lost task is
made anew with the same rows.

A packed row has its ids (unsigned 16 bit, little endian, padded with PAD), the
cumulative segment lengths, and position ids that restart at 0 with each
segment. Null and empty texts have no tokens and so no segment. A null id is
kept as null in ``doc_ids``; repeated rows are packed as often as they occur.
Other columns are not looked at. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LENGTH, WINDOW, PAD = 2048, 1 << 21, 0
SCHEMA = ("n_tokens int, n_segments int, doc_ids array<long>, offsets array<int>, cu_seqlens array<int>, "
          "ids binary, position_ids binary")


class Capacities:
    """Segment tree over capacities; each leaf keeps the open rows with that much room."""

    def __init__(self, most: int):
        self.n = 1 << most.bit_length()
        self.count = [0] * (2 * self.n)
        self.rows: list[list[int]] = [[] for _ in range(self.n)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.n
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the smallest room of at least ``need``."""
        at = need + self.n
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.n:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.n
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return row, room


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (each at most ``size``), best fit decreasing; ties by index."""
    open_, rows = Capacities(size), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = open_.take(lengths[k])
        row, room = got or (len(rows), size)
        if got is None:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            open_.add(room - lengths[k], row)
    return rows


def packed(segments: list[tuple[int | None, int, np.ndarray]], size: int) -> pa.RecordBatch:
    n_tokens, doc_ids, offsets, cu, ids, places = [], [], [], [], [], []
    for row in best_fit([len(s[2]) for s in segments], size):
        some = [segments[k] for k in row]
        lens = [len(s[2]) for s in some]
        total = sum(lens)
        line, place = np.full(size, PAD, "<u2"), np.zeros(size, "<u2")
        line[:total] = np.concatenate([s[2] for s in some])
        place[:total] = np.concatenate([np.arange(n) for n in lens])
        n_tokens.append(total)
        doc_ids.append([s[0] for s in some])
        offsets.append([s[1] for s in some])
        cu.append(np.cumsum([0, *lens]).tolist())
        ids.append(line.tobytes())
        places.append(place.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(n_tokens, pa.int32()), pa.array([len(d) for d in doc_ids], pa.int32()), pa.array(doc_ids, pa.list_(pa.int64())),
         pa.array(offsets, pa.list_(pa.int32())), pa.array(cu, pa.list_(pa.int32())), pa.array(ids, pa.binary()), pa.array(places, pa.binary())],
        names=["n_tokens", "n_segments", "doc_ids", "offsets", "cu_seqlens", "ids", "position_ids"])


def pack(docs: DataFrame, path: str, size: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row of ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from valuescope.llm import bpe

        sp, held, tokens = bpe.model(path).sp, [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                s = b.slice(lo, 128)
                for doc_id, ids in zip(s.column(0).to_pylist(), sp.encode([t or "" for t in s.column(1).to_pylist()], num_threads=1), strict=True):
                    x = np.array(ids, "<u2")
                    held += [(doc_id, at, x[at:at + size]) for at in range(0, len(x), size)]
                    tokens += len(x)
                    if tokens >= window:
                        yield packed(held, size)
                        held, tokens = [], 0
        if held:
            yield packed(held, size)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: each row group is an id matrix with its segment lengths and positions."""
    rows.write.mode("overwrite").parquet(path)


def matrix(rows, column: str = "ids") -> np.ndarray:
    """Collected packed rows as a matrix (rows x length)."""
    return np.stack([np.frombuffer(r[column], "<u2") for r in rows]) if rows else np.empty((0, 0), "<u2")
