"""Benchmark decontamination by latent semantic retrieval.

The terms are the words of the benchmark, folded to at most ``dims``.  Documents are written once as term numbers.  Their passages (32
words) give a TF-IDF matrix whose document frequencies are counted over all documents; its right singular vectors come from a
randomised SVD: every task folds its passages, with random signs, into ``sketch`` rows, the rows of all tasks are added up, and the
small sketch is decomposed on the driver.  The longest common subsequence of the item's words and the words around the passage must
hold ``lcs_share`` of the item, and ``answer_share`` of its answer, its last sentence, must be there too, in order.  Paraphrases that
drop, add or change some words still pass.  Which passages are read for which items follows from that rule alone (``Bound``), so none
is missed; the cosine of passage and item in the latent space is reported and ranks equal passages.

The benchmark is the stated query set and goes to every task, with what it needs: (items + terms) x ``rank`` numbers.

Null and empty texts hold no passages, and null or empty items ask for nothing.  Rows may repeat: equal (doc_id, item_id) give one
hit, the best one.  Ties take the first passage.  With either table empty there are no hits.  Long texts are read in slices, whole: slices
overlap by as much as the longest item needs.
Columns besides ids and texts are left out.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import WORD, documents, written

CHUNK = 16                                         # a passage is two chunks


@dataclass
class Items:
    """The benchmark as term numbers from 1 on; 0 is any other word."""
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: dict[str, int]
    dims: int

    @classmethod
    def read(cls, benchmark: DataFrame, dims: int, id_col: str = "item_id", text_col: str = "text") -> "Items":
        rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().collect()
        told = [(r["i"], WORD.findall(r["t"].lower()), answer(r["t"])) for r in sorted(rows)]
        told = [x for x in told if x[1]]
        terms = {w: i for i, w in enumerate(sorted({w for x in told for w in x[1]}), 1)}
        number = lambda ws: np.array([terms[w] for w in ws], np.int32)
        return cls([x[0] for x in told], [number(x[1]) for x in told], [number(x[2]) for x in told], terms, min(dims, len(terms)))

    def column(self, numbers: np.ndarray) -> np.ndarray:
        """Matrix column of term numbers; -1 for other words."""
        return np.where(numbers > 0, (numbers - 1) % max(self.dims, 1), -1)


def answer(text: str) -> list[str]:
    """The words of the last sentence."""
    sentences = [WORD.findall(s.lower()) for s in re.split(r"[.!?\n]+", text)]
    return ([s for s in sentences if s] or [[]])[-1]


def encode(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the term numbers of all words, as bytes."""
    terms = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.value.get
        for b in batches:
            out = []
            for text in b.column(1):
                words = WORD.findall((text.as_py() or "").lower())
                out.append(np.array([get(w, 0) for w in words], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "terms"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, terms binary")


def _slices(b: pa.RecordBatch, words: int = 100_000, shared: int = 2 * CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term numbers of several rows, each filled up to whole chunks, and the row of each chunk.  Neighbouring slices of a long text have ``shared`` words, in
    whole chunks, in common."""
    shared += -shared % CHUNK
    held, rows, n = [], [], 0
    for i, raw in enumerate(b.column(1)):
        t = np.frombuffer(raw.as_buffer(), np.int32)
        for lo in range(0, len(t), words):
            part = t[max(0, lo - shared):lo + words]
            held.append(np.pad(part, (0, -len(part) % CHUNK)))
            rows.append(np.full(len(held[-1]) // CHUNK, i))
            n += len(held[-1])
            if n >= words:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


def statistics(encoded: DataFrame, items: Items, sketch: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketch of the passage-term counts (sketch, dims), passage frequency of each term, number of passages."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df, passages = np.zeros((sketch, items.dims), np.int32), np.zeros(items.dims, np.int64), 0
        for b in batches:
            for flat, _ in _slices(b):
                passage = np.arange(len(flat)) // (2 * CHUNK)
                col = items.column(flat)
                own = col >= 0
                cell, tf = np.unique(passage[own] * items.dims + col[own], return_counts=True)
                p, c = np.divmod(cell, items.dims)
                df += np.bincount(c, minlength=items.dims)
                # sign and row of a passage follow from its content, so they do not depend on the partitioning
                mark = np.zeros(passage[-1] + 1, np.uint64)
                np.add.at(mark, passage, (flat.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
                mark ^= mark >> np.uint64(31)
                row, sign = (mark % np.uint64(sketch)).astype(np.int64), 1 - 2 * ((mark >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
                total += np.bincount(row[p] * items.dims + c, sign[p] * tf, sketch * items.dims).astype(np.int32).reshape(total.shape)
                passages += len(mark)
        if passages:
            rows = [x.astype(np.int64).tobytes() for x in total] + [np.append(df, passages).astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(sketch + 1), pa.int32()), pa.array(rows, pa.binary())], ["r", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(v.as_buffer(), np.int64)
                sums[r] = sums[r] + own if r in sums else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["r", "v"])

    got = encoded.mapInArrow(local, "r int, v binary").repartition("r").mapInArrow(add, "r int, v binary").collect()    # sketch + 1 rows
    rows = {r["r"]: np.frombuffer(r["v"], np.int64) for r in got}
    if not rows:
        return np.zeros((sketch, items.dims)), np.zeros(items.dims), 0
    return np.stack([rows[i] for i in range(sketch)]).astype(float), rows[sketch][:-1].astype(float), int(rows[sketch][-1])


def projection(sketched: np.ndarray, df: np.ndarray, passages: int, rank: int) -> np.ndarray:
    """(dims + 1, rank): what a term adds to a passage's place, with a last row of zeros for other words.  Directions are scaled by
    their singular values, so that the few that all texts share do not outweigh the rest."""
    idf = np.log((1 + passages) / (1 + df))
    _, s, vt = np.linalg.svd(sketched * idf, full_matrices=False)
    k = min(rank, int((s > 1e-9).sum()))
    out = np.zeros((len(df) + 1, max(k, 1)))
    if k:
        out[:-1] = (idf[:, None] * vt[:k].T) / s[:k]
    return out.astype(np.float32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; other words (0) never match."""
    bits: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        bits[x] = bits.get(x, 0) | 1 << i
    bits.pop(0, None)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if x in bits:
            u = v & bits[x]
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Bound:
    """Which passages can hold which items.  A common subsequence of ``least`` of an item's words leaves out at most the others, so
    the words around the passage hold one of any ``others + 1`` of its words (the rarest are asked for), and ``least`` of all."""

    def __init__(self, items: Items, df: np.ndarray, lcs_share: float):
        n_terms = len(items.terms) + 1
        self.lengths = np.array([len(w) for w in items.words])
        self.least = [max(1, next(c for c in range(n + 1) if c / n >= min(lcs_share, 1.0))) for n in self.lengths.tolist()]
        self.words, self.times, owner, term = [], [], [], []
        for i, w in enumerate(items.words):
            rarest = w[np.argsort(df[items.column(w)], kind="stable")][:len(w) - self.least[i] + 1]
            owner.append(np.full(len(set(rarest.tolist())), i))
            term.append(np.unique(rarest))
            of, times = np.unique(w, return_counts=True)
            self.words.append(of)
            self.times.append(times)
        owner, term = np.concatenate(owner), np.concatenate(term)
        order = np.argsort(term, kind="stable")
        self.owner, self.start = owner[order], np.searchsorted(term[order], np.arange(n_terms + 1))
        self.local = np.zeros(n_terms, np.int32)

    def __call__(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items and the chunks their passages may begin at.  ``first`` and ``last``: where the row of each chunk begins and ends."""
        many = self.start[flat + 1] - self.start[flat]
        at = np.flatnonzero(many)
        many = many[at]
        which = self.owner[np.repeat(self.start[flat[at]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        order = np.argsort(which, kind="stable")
        which, at = which[order], at[order]
        ends = np.flatnonzero(np.append(which[1:] != which[:-1], True)) + 1 if len(which) else []
        begin = 0
        for end in ends:
            i, own = int(which[begin]), at[begin:end]
            begin = end
            n = int(self.lengths[i])
            # passages from chunk k on are read from n words before to n words behind, within their row
            k = np.arange((2 * n + 2 * CHUNK) // CHUNK + 2)[None, :] + (own[:, None] - n) // CHUNK - 2
            k = np.unique(k[(k >= 0) & (k < len(first))])
            words = np.arange(k[0] * CHUNK - n, k[0] * CHUNK + 2 * CHUNK + n)[None, :] + ((k - k[0]) * CHUNK)[:, None]
            inside = (words >= first[k][:, None]) & (words < last[k][:, None])
            self.local[self.words[i]] = np.arange(1, len(self.words[i]) + 1)
            found = self.local[flat[np.where(inside, words, 0)]] * inside
            self.local[self.words[i]] = 0
            there = np.zeros((len(k), len(self.words[i]) + 1), bool)
            there[np.arange(len(k))[:, None], found] = True
            k = k[there[:, 1:] @ self.times[i] >= self.least[i]]
            if len(k):
                yield i, k


def hits(docs: DataFrame, benchmark: DataFrame, dims: int = 4096, sketch: int = 160, rank: int = 128, lcs_share: float = 0.7, answer_share: float = 0.5,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of each item that a document holds."""
    spark = docs.sparkSession
    items = Items.read(benchmark, dims)
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"
    if not items.ids:
        return spark.createDataFrame([], schema)
    encoded = written(encode(docs, items, id_col, text_col))
    sketched, df, passages = statistics(encoded, items, sketch)
    place = projection(sketched, df, passages, rank)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    # an item is compared as a whole and, where it is longer than a passage, by its passages
    asked = [unit(np.stack([place[items.column(w[s:s + 2 * CHUNK])].sum(axis=0) for s in range(0, max(1, len(w) - CHUNK), CHUNK)])) for w in items.words]
    sent = spark.sparkContext.broadcast((items, place, asked, Bound(items, df, lcs_share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place, asked, bound = sent.value
        # a passage is read from an item's length before it to as much behind it: some slice holds all of that
        shared = 2 * max(len(w) for w in items.words) + 4 * CHUNK
        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            ids = b.column(0).to_pylist()
            for flat, row in _slices(b, shared=shared):
                first = np.searchsorted(row, row) * CHUNK                  # where the row begins and ends in the slice
                last = np.searchsorted(row, row, "right") * CHUNK
                for i, chunks in bound(flat, first, last):
                    n, own = len(items.words[i]), items.answers[i]
                    for k in chunks.tolist():
                        around = flat[max(first[k], k * CHUNK - n):min(last[k], (k + 2) * CHUNK + n)]
                        lcs = common(items.words[i], around) / n
                        if lcs < lcs_share:
                            continue
                        said = common(own, around) / len(own) if len(own) else 1.0
                        if said >= answer_share:
                            passage = unit(place[items.column(flat[k * CHUNK:min(last[k], (k + 2) * CHUNK)])].sum(axis=0)[None, :])
                            key, value = (ids[row[k]], items.ids[i]), (lcs, said, float((asked[i] @ passage[0]).max()))
                            if key not in best or value > best[key]:
                                best[key] = value
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "item_id": i, "cosine": c, "lcs_share": x, "answer_share": y} for (d, i), (x, y, c) in best.items()], schema=_HIT)

    found = encoded.mapInArrow(run, schema)
    top = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_share")


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no item.  All columns stay; a document with a null id stays if no row with a null id holds an item."""
    found = hits(docs, benchmark, id_col=id_col, **how).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col("_hit")), "left_anti")
