"""Packed token matrices in binary form.

Each task packs what it reads, a shard at a time: documents are collected until the shard holds ``shard_tokens`` tokens,
sorted by falling length and put where they leave least room (best-fit decreasing; a segment tree over the capacities finds
the place).  Overlong documents are cut into pieces of the capacity, in order, and lose nothing.  One output row is the
matrix of a shard: ids row by row, padded, with the cumulative lengths of the segments of each row and the places where
positions start again.  Nothing is shuffled, and a task holds one shard.

Null texts count as empty and an empty text is the end token alone; repeated rows are packed as often as they occur; ties in
length keep the order of reading.  An empty table gives no matrices.  Columns besides id and text are left out.
"""
from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents
from attestra.llm.tokens import encoder as encoder_of

MATRIX = ("shard string, n_rows int, capacity int, ids binary, cu_lengths array<array<int>>, resets array<array<int>>, "
          "segments array<struct<doc_id:bigint,piece:int,start:bigint,row:int,offset:int,length:int>>")


class Capacities:
    """A segment tree over room left: ``take(n)`` finds the bin with the least room that still holds n.

    Leaves are the possible amounts of room; a leaf holds the bins that have it, and a node whether any leaf below has one."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.tree = np.zeros(2 * self.size, bool).tolist()
        self.n = 0

    def _mark(self, room: int) -> None:
        i = self.size + room
        self.tree[i] = bool(self.bins[room])
        while i > 1:
            i //= 2
            on = self.tree[2 * i] or self.tree[2 * i + 1]
            if self.tree[i] == on:
                break
            self.tree[i] = on

    def _least(self, need: int) -> int:
        """The smallest amount of room of at least ``need`` that some bin has, or -1."""
        i = self.size + need
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:      # a right neighbour holds larger amounts
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1

    def take(self, need: int) -> tuple[int, int]:
        """(bin, offset) for ``need`` tokens; opens a bin if none has the room."""
        room = self._least(need)
        if room < 0:
            room, at = self.capacity, self.n
            self.n += 1
        else:
            at = self.bins[room].pop()
            self._mark(room)
        self.bins[room - need].append(at)
        self._mark(room - need)
        return at, self.capacity - room


def _matrix(name: str, held: list[tuple[int | None, int, int, bytes]], capacity: int, dtype: str, pad_id: int) -> dict:
    width = np.dtype(dtype).itemsize
    tree = Capacities(capacity)
    placed = []
    for k in sorted(range(len(held)), key=lambda k: -len(held[k][3])):
        placed.append((*tree.take(len(held[k][3]) // width), k))
    ids = np.full((tree.n, capacity), pad_id, dtype)
    rows: list[list[int]] = [[0] for _ in range(tree.n)]
    segments = []
    for row, offset, k in sorted(placed):
        doc_id, piece, start, own = held[k]
        n = len(own) // width
        ids[row, offset:offset + n] = np.frombuffer(own, dtype)
        rows[row].append(offset + n)
        segments.append({"doc_id": doc_id, "piece": piece, "start": start, "row": row, "offset": offset, "length": n})
    return {"shard": name, "n_rows": tree.n, "capacity": capacity, "ids": ids.tobytes(), "cu_lengths": rows, "resets": [r[:-1] for r in rows], "segments": segments}


def matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, dtype: str = "<u2", shard_tokens: int = 1 << 20,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard.  ``dtype`` is the id type, little-endian; it must hold the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end, width = encoder_of(tokenizer, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        part, shards, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_matrix(f"{part:06d}-{shards:06d}", held, capacity, dtype, pad_id)], schema=SCHEMA)

        for b in batches:
            for d, text in zip(b.column(0), b.column(1)):
                ids = encoder.encode([text.as_py() or ""])[0] + end
                for k, at in enumerate(range(0, len(ids), capacity * width)):
                    held.append((d.as_py(), k, at // width, ids[at:at + capacity * width]))
                    tokens += len(held[-1][3]) // width
                    if tokens >= shard_tokens:
                        yield done()
                        shards, held, tokens = shards + 1, [], 0
        if held:
            yield done()

    return documents(docs, id_col, text_col).mapInArrow(run, MATRIX)


_SEGMENT = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("row", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
SCHEMA = pa.schema([("shard", pa.string()), ("n_rows", pa.int32()), ("capacity", pa.int32()), ("ids", pa.binary()), ("cu_lengths", pa.list_(pa.list_(pa.int32()))),
                    ("resets", pa.list_(pa.list_(pa.int32()))), ("segments", pa.list_(_SEGMENT))])
READ = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard string, row int, offset bigint"


def segments(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Read matrices back: one row per segment with the checksum of its ids as unsigned 32-bit, and a check that the
    cumulative lengths tile the row as the segments say."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                m = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                ids = np.frombuffer(m["ids"].as_buffer(), dtype).reshape(m["n_rows"].as_py(), m["capacity"].as_py())
                bounds, shard, out = m["cu_lengths"].as_py(), m["shard"].as_py(), []
                for s in m["segments"].as_py():
                    lo, hi = s["offset"], s["offset"] + s["length"]
                    if lo not in bounds[s["row"]] or hi not in bounds[s["row"]]:
                        raise ValueError(f"segment {s} of shard {shard} is not between two cumulative lengths")
                    out.append({"doc_id": s["doc_id"], "piece": s["piece"], "start": s["start"], "length": s["length"],
                                "ids_crc32": zlib.crc32(ids[s["row"], lo:hi].astype("<u4").tobytes()), "shard": shard, "row": s["row"], "offset": lo})
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return packed.mapInArrow(run, READ)


_READ = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string()),
                   ("row", pa.int32()), ("offset", pa.int64())])
