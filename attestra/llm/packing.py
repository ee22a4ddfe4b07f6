"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens.  The plan is best-fit decreasing over *counts* of lengths: it
reads one row per length, never a document, and says which ranks of a length go to which sequences.  Pieces then take
their places by their rank within their length.

Null texts count as empty; an empty text is the end token alone.  Repeated rows are packed as often as they occur; among
pieces of equal length the order is doc_id, piece, checksum (null ids first), and equal rows are interchangeable.  A
table without rows gives no pieces.  Columns besides id and text are left out.
"""
from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents, partitions, written
from attestra.llm.tokens import encoder as encoder_of

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: tokens and the end id, cut into ``capacity`` where longer."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, step = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            out = []
            for d, text in zip(b["doc_id"], b["text"]):
                ids = encoder.encode(["" if text is None else text])[0] + end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at:at + step]
                    out.append((d, k, at // 4, len(own) // 4, zlib.crc32(own)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], "Int64")
            yield frame

    # ids travel as text: pandas would turn a nullable bigint into a double
    narrow = documents(docs, id_col, text_col)
    return narrow.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECES)


@dataclass(frozen=True)
class Run:
    """Ranks ``rank`` .. ``rank + count - 1`` of ``length``: ``each`` items per sequence from ``sequence`` on, the first at ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best fit decreasing over counts: the runs, and how many sequences they fill.

    Sequences that have the same room left are kept as ranges, so the work follows the number of distinct lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}      # room left -> ranges (first sequence, how many)
    rooms: list[int] = []                            # sorted room sizes in use
    runs: list[Run] = []
    used = 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                heapq.heappush(rooms, left)
            room[left].append((first, n))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        todo, rank = histogram[length], 0
        while todo:
            fits = [r for r in rooms if r >= length]
            if fits:
                left = min(fits)
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.remove(left)
                    heapq.heapify(rooms)
            else:
                left, first, n = capacity, used, -(-todo // (capacity // length))
                used += n
            each = left // length
            full = min(n, todo // each)              # sequences that take as many as they can
            if full:
                runs.append(Run(length, rank, full * each, first, each, capacity - left))
                keep(left - each * length, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and todo:                           # the last one takes what is left, fewer than ``each``
                runs.append(Run(length, rank, todo, first, todo, capacity - left))
                keep(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            keep(left, first, n)
    return runs, used


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give the pieces (a written table, as it is read three times) their sequence and offset.

    Ranks within a length are local ranks in hashed parts plus the counts of the parts before, so a length that a third
    of all pieces have is ranked by many tasks."""
    spark = cut.sparkSession
    parts = partitions(spark)
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    # at most one row per length up to the capacity
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    local = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (keyed.withColumn("local", F.row_number().over(local) - 1).join(base, ["length", "part"])
              .select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank")))
    starts: dict[int, np.ndarray] = {}
    table = np.array([(r.length, r.rank, r.count, r.sequence, r.each, r.offset) for r in runs], np.int64).reshape(-1, 6)
    for x in np.unique(table[:, 0]).tolist():
        own = table[table[:, 0] == x]
        starts[x] = own[np.argsort(own[:, 1])]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for x, at in b.groupby("length").indices.items():
                own, rank = starts[x], b["rank"].to_numpy(np.int64)[at]
                run = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                j = rank - run[:, 1]
                sequence[at], offset[at] = run[:, 3] + j // run[:, 4], run[:, 5] + j % run[:, 4] * x
            b = b.drop(columns="rank")
            b["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in b["doc_id"]], "Int64")
            b["sequence_id"], b["offset"] = sequence, offset
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(assign, PLACED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with the sequence and the offset they take."""
    return place(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity)
