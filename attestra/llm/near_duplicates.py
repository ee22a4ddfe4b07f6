"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A shingle is five words in a row (a shorter text is one shingle) and weighs its count in the text times its inverse document
frequency ``ln(1 + N / df)``.  With ``rare=None`` every shingle has its own frequency, counted over all documents: texts are dealt
over chunks, what a chunk holds is counted in it, the counts are added up by ranges of the hash, and each chunk gets back those of
its shingles that occur elsewhere too.  With a number, the frequency is held to be at least ``rare`` of all documents, so it lowers
what very many documents share and leaves all other shingles equal; only shingles as frequent as that need counting.  They are found
exactly: a shingle that a tenth of all documents hold is held by a tenth of the documents of some chunk.

True frequencies (``rare=None``) fall with every copy, so what a large group of copies shares would weigh so much less than what each
copy has of its own that near copies come apart.  There each text is therefore weighed a second time, evenly: wording that at least
``COPIED`` documents hold, but less than one in ``COMMON`` of all, weighs as much as wording of one document alone.  Texts with
such wording have keys of both weighings, and two texts are linked if they are alike enough by either.

Texts with equal words are one text from then on.  Each text gets ``bands`` keys of ``rows`` samples for each weighing.  First each text meets the
smallest under its key; then, under keys that still hold texts of different classes, all meet all: the texts of a key are dealt
over blocks, and every two blocks are compared in one piece, so that no key is one task and rows grow with texts and blocks, not
with pairs.  A link is a weighted Jaccard similarity of at least ``threshold``, computed in full; classes
are the connected components of links, by label propagation over written tables.

Null texts and texts without a word are no one's duplicate: each is a class of its own, as is each text without links.  Ids may
repeat; the class is named by its smallest id, nulls last.  An empty table gives no rows.  Columns besides id and text are
left out.  Long texts are hashed whole.
"""
from __future__ import annotations

import functools
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import WORD, Hashes, documents, hash_words, written

MIX = np.uint64(0x9E3779B97F4A7C15)
POOL = 1 << 18
KNOWN_WORDS = 500_000
#: characters of text in a chunk, some two million shingles
CHUNK = 12_000_000
#: tables of hits for one weight (1 MB each), and how often a weight is met before it gets one
TABLES, MET = 32, 30
#: documents that hold what is taken for the wording of a large group of copies: at least so many, and less than one in so many of all, as more make it a common phrase
COPIED, COMMON = 25, 20
SKETCH = pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("samples", pa.binary()), ("weight", pa.float64()), ("even", pa.binary()), ("even_weight", pa.float64())])
SET = pa.schema([("t", pa.binary()), ("h", pa.binary()), ("n", pa.binary()), ("w", pa.binary())])


def shingles(words: list[str], size: int, seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, in order."""
    if len(seen) > KNOWN_WORDS:
        seen.clear()
    w = hash_words(words, seen)
    n = max(1, len(w) - size + 1)
    out = np.full(n, len(w) if len(w) < size else size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(size, len(w))):
            x = w[j:j + n] if len(w) >= size else w[j:j + 1]
            out = (out ^ x) * MIX
            out ^= out >> np.uint64(29)
    return out


class Sampler:
    """Improved consistent weighted sampling.  The random triples of a shingle (two Gamma(2, 1) and one uniform variable for each
    sample) are drawn from a pool by its hash, so they are the same wherever it occurs; a sample is the shingle and the level of its
    weight that are hit first."""

    def __init__(self, samples: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.r = rng.gamma(2, 1, POOL)
        self.c = np.log(rng.gamma(2, 1, POOL))
        self.b = rng.random(POOL)
        self.by = rng.integers(1, 2 ** 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plain: dict[float, np.ndarray] = {}
        self.met: dict[float, int] = {}

    def _first(self, weight: float) -> np.ndarray | None:
        """When a shingle of this weight is hit, for the whole pool; only for weights that are met often."""
        if weight not in self.plain:
            if len(self.met) > 10_000:
                self.met.clear()
            self.met[weight] = self.met.get(weight, 0) + 1
            if self.met[weight] < MET or len(self.plain) >= TABLES:
                return None
            level = np.floor(np.log(weight) / self.r + self.b)
            self.plain[weight] = (self.c - self.r * (level - self.b + 1)).astype(np.float32)
        return self.plain[weight]

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """``hashes`` sorted and different; one 64-bit sample for each."""
        usual = float(np.partition(weights, len(weights) // 2)[len(weights) // 2])
        common = self._first(usual)
        every = np.arange(self.samples)
        best, place = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.int64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(hashes), at_once):
                h, w = hashes[lo:lo + at_once], weights[lo:lo + at_once]
                at = ((self.by[:, None] * h) >> np.uint64(64 - 18)).view(np.int64)
                when = np.empty(at.shape, np.float32) if common is None else common.take(at)
                odd = np.arange(len(w)) if common is None else np.flatnonzero(w != usual)
                if len(odd):
                    j = at[:, odd]
                    r, b = self.r.take(j), self.b.take(j)
                    when[:, odd] = self.c.take(j) - r * (np.floor(np.log(w[odd]) / r + b) - b + 1)
                i = when.argmin(axis=1)
                new = when[every, i] < best
                best, place = np.where(new, when[every, i], best), np.where(new, lo + i, place)
            h = hashes[place]
            j = (self.by * h) >> np.uint64(64 - 18)
            level = np.floor(np.log(weights[place]) / self.r[j] + self.b[j]).astype(np.int64).astype(np.uint64)
            x = (h ^ ((level & np.uint64(0xFFFF)) << np.uint64(48)) ^ every.astype(np.uint64)) * MIX
            return x ^ (x >> np.uint64(31))


@functools.cache
def sampler(samples: int) -> Sampler:
    """One for each worker."""
    return Sampler(samples)


def _texts(b: pa.RecordBatch, column: int = 1) -> Iterator[list[str]]:
    for text in b.column(column):
        yield WORD.findall((text.as_py() or "").lower())


def frequent_shingles(rows: DataFrame, size: int, rare: float) -> tuple[dict[int, int], int]:
    """Document counts of the shingles that at least ``rare`` of all documents hold (at most mean length / rare), and the number of documents.

    Chunks report the shingles that at least half of ``rare`` of their documents hold.  A shingle that every chunk reports is counted
    exactly; one whose reports, with the most that silent chunks may hold, stay below ``rare`` is not frequent; only for others are
    the texts read again."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n, kept = Hashes(), [], 0, 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            own = c >= rare / 2 * n
            # the chunk's size stands beside a null shingle
            return pa.RecordBatch.from_arrays([pa.array([None, *h[own].view(np.int64).tolist()], pa.int64()), pa.array([0, *c[own].tolist()], pa.int64()),
                                               pa.array([n] * (1 + int(own.sum())), pa.int64())], ["shingle", "n", "docs"])

        for b in batches:
            for words in _texts(b):
                n += 1
                if words:
                    held.append(np.unique(shingles(words, size, seen)))
                    kept += len(held[-1])
                if kept > 2_000_000:
                    yield out()
                    held, n, kept = [], 0, 0
        if n:
            yield out()

    spark = rows.sparkSession
    told = (rows.mapInArrow(local, "shingle bigint, n bigint, docs bigint").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    told = written(told)
    total = told.where("shingle IS NULL").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    possible = told.where(F.col("shingle").isNotNull() & (F.col("n") + rare / 2 * (total - F.col("docs")) >= rare * total)).toArrow()
    keys, counts, docs = (possible.column(c).to_numpy() for c in ("shingle", "n", "docs"))
    exact = {int(k): int(c) for k, c, d in zip(keys.view(np.uint64), counts, docs) if d == total}
    open_ = np.sort(keys[docs < total].view(np.uint64))
    if len(open_):
        exact |= _counted(rows, open_, size)
    return {k: c for k, c in exact.items() if c >= rare * total}, total


def _counted(rows: DataFrame, asked: np.ndarray, size: int) -> dict[int, int]:
    """Document counts of some shingles over all documents."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, asked = Hashes(), sent.value
        count = np.zeros(len(asked), np.int64)
        for b in batches:
            for words in _texts(b):
                if words:
                    h = np.unique(shingles(words, size, seen))
                    at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                    count[at[asked[at] == h]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(asked[count > 0].view(np.int64)), pa.array(count[count > 0])], ["shingle", "n"])

    got = rows.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got.column("shingle").to_numpy().view(np.uint64).tolist(), got.column("n").to_pylist()))


class Weights:
    """Sorted shingles of a text and their weights."""

    def __init__(self, counts: dict[int, int], total: int, size: int, rare: float):
        self.size = size
        self.usual = float(np.log1p(1 / rare))
        self.keys = np.array(sorted(counts), np.uint64)
        self.idf = np.array([np.log1p(total / counts[k]) for k in sorted(counts)])

    @classmethod
    def of(cls, keys: np.ndarray, idf: np.ndarray, usual: float, size: int) -> Weights:
        """Inverse frequencies by sorted shingles, and that of all others."""
        new = cls({}, 0, size, 1)
        new.keys, new.idf, new.usual = keys, idf, usual
        return new

    def __call__(self, words: list[str], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted(*np.unique(shingles(words, self.size, seen), return_counts=True))

    def weighted(self, h: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.full(len(h), self.usual)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            w = np.where(self.keys[at] == h, self.idf[at], w)
        return h, w * tf


class Even(NamedTuple):
    """The second weighing, from the weights of the first: those of frequencies from ``COPIED`` on and below one in ``COMMON`` are
    raised to that of a shingle which one document holds.  Tables of fewer than ``COPIED * COMMON`` documents have none."""
    low: float
    high: float
    top: float

    @classmethod
    def of(cls, total: int) -> Even:
        return cls(float(np.log1p(COMMON)) * (1 + 1e-12), float(np.log1p(total / COPIED)) * (1 + 1e-12), float(np.log1p(total)))

    def raised(self, w: np.ndarray) -> np.ndarray:
        return (w > self.low) & (w <= self.high)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        return np.where(self.raised(w), self.top, w)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def name(words: list[str]) -> bytes:
    """What texts with equal words share."""
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


class Counted(NamedTuple):
    """Document counts of the shingles that several documents hold, for each chunk of texts that holds them."""
    told: DataFrame
    chunks: int
    total: int
    size: int

    def chunk(self) -> Column:
        return _chunk(self.chunks)

    def even(self) -> Even:
        return Even.of(self.total)


def _chunk(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte, so that equal high bytes compress."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def counted_shingles(rows: DataFrame, size: int) -> Counted:
    """Document counts of all shingles, exactly.  What moves of a shingle is its hash, once for each chunk that holds it."""
    total, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    chunks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-chars // CHUNK))
    block = "chunk int, part int, h binary, n binary"

    def own(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        seen = Hashes()
        held = [np.unique(shingles(words, size, seen)) for b in texts.to_batches() for words in _texts(b, 0) if words]
        h, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        part = ((h >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)
        parts, at = np.unique(part, return_index=True)
        cut = list(zip(at, [*at[1:], len(h)]))
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(parts.astype(np.int32)), pa.array([packed(h[a:b]) for a, b in cut], pa.binary()),
                         pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in cut], pa.binary())], ["chunk", "part", "h", "n"])

    def over_all(blocks: pa.Table) -> pa.Table:
        sets = [unpacked(b) for b in blocks.column("h").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in blocks.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        df, out, lo = np.bincount(at, counts).astype(np.uint32)[at], [], 0
        for h in sets:
            d = df[lo:lo + len(h)]
            lo += len(h)
            out.append((packed(h[d > 1]), d[d > 1].tobytes()))
        return pa.table([blocks.column("chunk"), blocks.column("part"), pa.array([h for h, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())], ["chunk", "part", "h", "n"])

    told = (rows.where("text IS NOT NULL").select("text", _chunk(chunks).alias("chunk")).groupBy("chunk").applyInArrow(own, block)
            .groupBy("part").applyInArrow(over_all, block).where("length(h) > 0"))
    return Counted(written(told), chunks, total, size)


def weighed(rows: DataFrame, weights: Weights | Counted, run: Callable[[Weights, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``run`` over the rows (their last column is the chunk) and the weights of their shingles: the same for all, or those of their chunk."""
    if isinstance(weights, Weights):
        sent = rows.sparkSession.sparkContext.broadcast(weights)
        return rows.mapInArrow(lambda batches: run(sent.value, batches), ddl)
    total, size = weights.total, weights.size

    def both(own: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("part")                    # parts are ranges of the hash, so the whole is sorted
        h = np.concatenate([np.empty(0, np.uint64), *map(unpacked, told.column("h").to_pylist())])
        n = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in told.column("n").to_pylist())])
        weigh = Weights.of(h, np.log1p(total / n), float(np.log1p(total)), size)
        return pa.Table.from_batches(run(weigh, own.to_batches()), schema)

    return rows.groupBy("chunk").cogroup(weights.told.groupBy("chunk")).applyInArrow(both, ddl)


def sketches(rows: DataFrame, weights: Weights | Counted, bands: int, band_rows: int) -> DataFrame:
    """doc_id, t (null without words), the samples of each row, as bytes, and its weight in all; both once more for the second weighing, null where that is the first."""
    samples = bands * band_rows
    even = weights.even() if isinstance(weights, Counted) else None

    def drawn(weigh: Weights, words: list[str], seen: dict[str, int]) -> tuple:
        draw = sampler(samples)
        h, tf = np.unique(shingles(words, weigh.size, seen), return_counts=True)
        _, each = weigh.weighted(h, np.ones(len(h)))
        first = draw(h, each * tf).tobytes(), float((each * tf).sum())
        if even is None or not even.raised(each).any():
            return *first, None, None
        return *first, draw(h, even(each) * tf).tobytes(), float((even(each) * tf).sum())

    def run(weigh: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = Hashes(), {}
        for b in batches:
            t, s = [], []
            for words in _texts(b):
                t.append(name(words) if words else None)
                if not words:
                    s.append((None,) * 4)
                    continue
                if t[-1] not in last:                  # copies come in runs
                    if len(last) > 2000:
                        last.clear()
                    last[t[-1]] = drawn(weigh, words, seen)
                s.append(last[t[-1]])
            own = [pa.array([x[j] for x in s], SKETCH.field(2 + j).type) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.binary()), *own], schema=SKETCH)

    return weighed(rows, weights, run, SKETCH, "doc_id bigint, t binary, samples binary, weight double, even binary, even_weight double")


def band_keys(texts: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """(band, key, t, weight): the samples of each band, hashed, and the text's weight in that weighing; the second has bands of its own."""
    width = 8 * band_rows
    key = lambda of, weight, at: lambda i: F.struct((i + at).cast("int").alias("band"), F.xxhash64(F.substring(of, i * width + 1, F.lit(width))).alias("key"), F.col(weight).alias("weight"))
    every = F.sequence(F.lit(0), F.lit(bands - 1))
    keys = F.when(F.col("even").isNull(), F.transform(every, key("samples", "weight", 0))).otherwise(
        F.concat(F.transform(every, key("samples", "weight", 0)), F.transform(every, key("even", "even_weight", bands))))
    return texts.select("t", F.explode(keys).alias("b")).select("b.band", "b.key", "t", "b.weight")


def _check(pairs: DataFrame, sets: DataFrame, threshold: float, even: Even | None) -> DataFrame:
    """Those (a, b) whose similarity reaches the threshold, by either weighing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for i in range(batch.num_rows):
                read = lambda k, kind: np.frombuffer(c[k][i].as_buffer(), kind)
                of = lambda end, by=lambda w: w: (read(f"h{end}", np.uint64), by(read(f"w{end}", np.float64)) * read(f"n{end}", np.uint32))
                keep.append(similarity(of("a"), of("b")) >= threshold or (even is not None and similarity(of("a", even), of("b", even)) >= threshold))
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.withColumnsRenamed({"t": "a", "h": "ha", "n": "na", "w": "wa"})
    two = sets.withColumnsRenamed({"t": "b", "h": "hb", "n": "nb", "w": "wb"})
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ha", "na", "wa", "hb", "nb", "wb").mapInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(t, c): the smallest member of each node's component.  Labels take the smallest among neighbours, then jump to the label
    of their label; each step is a written table."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "t"))
    while True:
        near = both.join(labels.withColumnsRenamed({"t": "b"}), "b").groupBy("a").agg(F.min("c").alias("near")).withColumnRenamed("a", "t")
        step = labels.join(near, "t").select("t", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("t").alias("c"), F.col("c").alias("up"))
        new = written(step.join(jump, "c", "left").select("t", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        if new.where("old <> c").isEmpty():
            return new.select("t", "c")
        labels = new.select("t", "c")


def _merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes after further links; those links join whole classes."""
    if classes is None:
        return components(links)
    of = lambda end: classes.select(F.col("t").alias(end), F.col("c").alias(f"c{end}"))
    joined = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
              .select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    between = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b"))
    nodes = classes.union(joined.select("a", "ca").union(joined.select("b", "cb")).distinct()).distinct()
    top = between.select(F.col("t").alias("c"), F.col("c").alias("top"))
    return written(nodes.join(top, "c", "left").select("t", F.coalesce("top", "c").alias("c")).distinct())


def spanning(ids: list[bytes], own: list[bytes], sets: list[tuple[np.ndarray, np.ndarray]], weights: Weights, threshold: float, columns: int = 4096, even: Even | None = None) -> list[tuple[bytes, bytes]]:
    """All texts with one another: links that join, directly or over others, every two of different classes ``own`` whose similarity
    reaches the threshold by either weighing (fewer links than texts)."""
    n = len(ids)
    lengths = [len(h) for h, _ in sets]
    owner, tf = np.repeat(np.arange(n), lengths), np.concatenate([k for _, k in sets]).astype(np.int64)
    values, column = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    by = [weights.weighted(values, np.ones(len(values)))[1]]
    if even is not None and even.raised(by[0]).any():
        by.append(even(by[0]))
    totals = [np.bincount(owner, each[column] * tf, n) for each in by]
    # a shingle that occurs k times is k columns, so the smaller of two counts is a product; those of one text alone meet none
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    cell, column, held = np.unique(np.repeat(column, tf) * (int(tf.max()) + 1) + level, return_inverse=True, return_counts=True)
    by = [each[cell // (int(tf.max()) + 1)][held > 1] for each in by]
    place = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
    owner = np.repeat(owner, tf)[place >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    commons = [np.zeros((n, n)) for _ in by]
    for lo in range(0, len(by[0]), columns):
        x = slice(*np.searchsorted(place, [lo, lo + columns]))
        m = np.zeros((n, min(columns, len(by[0]) - lo)))
        m[owner[x], place[x] - lo] = 1
        for common, each in zip(commons, by):
            common += (m * each[lo:lo + columns]) @ m.T
    classes = np.unique(np.array([c.hex() for c in own]), return_inverse=True)[1]
    link = np.zeros((n, n), bool)
    for k, (common, total) in enumerate(zip(commons, totals)):
        alike = common / (total[:, None] + total - common)
        one = (alike >= threshold) & (classes[:, None] != classes)
        for i, j in np.argwhere((np.abs(alike - threshold) < 1e-9) & (classes[:, None] < classes)):      # sums in another order
            each = lambda w: even(w) if k else w  # noqa: B023, E731
            weigh = lambda t: (sets[t][0], each(weights.weighted(sets[t][0], np.ones(len(sets[t][0])))[1]) * sets[t][1])  # noqa: B023, E731
            one[i, j] = one[j, i] = similarity(weigh(i), weigh(j)) >= threshold
        link |= one
    out, new = [], np.ones(n, bool)
    for start in range(n):
        queue = [start] if new[start] else []
        new[start] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(link[i] & new)
            new[found] = False
            queue += found.tolist()
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in found]
    return out


def remaining(keys: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float, block_texts: int, block_shingles: int, even: Even | None) -> DataFrame:
    """Links between texts of different classes under one key.  A key's texts are dealt over blocks of about ``block_texts`` texts or
    ``block_shingles`` shingles at most, and every two blocks are one task's piece of work, so all pairs of a key are compared."""
    sized = sets.select("t", (F.length("h") / 8).alias("size"))
    rows = written(keys.join(classes, "t", "left").join(sized, "t").select("band", "key", "t", "size", F.coalesce("c", "t").alias("c")))
    # the two of a key of two have met, as one of them leads it; keys of a single class have nothing to find, and keys with the same texts find the same
    open_ = (rows.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("size"),
                                             F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y")).where("lo <> hi AND n > 2")
             .groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("k"), F.first("size").alias("size"))
             .select("k.band", "k.key", F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("size") / block_shingles)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("t", F.lit(2)), F.col("blocks")).cast("int")
    dealt = (rows.join(open_, ["band", "key"]).select("band", "key", "t", "c", "blocks", block.alias("own"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR own <> other")
             .select("band", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "t", "c"))
    dealt = dealt.join(sets, "t").select("band", "key", "one", "two", "t", "c", "h", "n", "w")
    dealt = dealt.repartition("band", "key", "one", "two").sortWithinPartitions("band", "key", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def out() -> pa.RecordBatch:
            sets = [(np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.uint32)) for r in held]
            found = []
            if held:
                keys, first = np.unique(np.concatenate([h for h, _ in sets]), return_index=True)
                weights = Weights.of(keys, np.concatenate([np.frombuffer(r[4], np.float64) for r in held])[first], 0.0, 0)
                found = spanning([r[0] for r in held], [r[1] for r in held], sets, weights, threshold, even=even)
            return pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.binary()) for j in (0, 1)], ["a", "b"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(9))):
                if row[:4] != at:
                    yield out()
                    at, held = row[:4], []
                held.append(row[4:])
        yield out()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def classes_of(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 12, band_rows: int = 3, rare: float | None = 0.1,
               block_texts: int = 400, block_shingles: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_docs of each row; ``t`` names its text (null without words).  Of pairs as similar as the threshold, about two in
    ten thousand share no key."""
    rows = documents(docs, id_col, text_col)
    if rare is None:
        weights = counted_shingles(rows, size)
        rows, even = rows.withColumn("chunk", weights.chunk()), weights.even()
    else:
        weights, even = Weights(*frequent_shingles(rows, size, rare), size, rare), None
    sketched = written(sketches(rows, weights, bands, band_rows))
    texts = written(sketched.where("t IS NOT NULL").groupBy("t").agg(*(F.min(c).alias(c) for c in ("samples", "weight", "even", "even_weight")), F.min("doc_id").alias("first_id")))
    keys = band_keys(texts, bands, band_rows)
    lead = keys.groupBy("band", "key").agg(F.min(F.struct("t", "weight")).alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "key", "b")
    shared = written(keys.join(lead, ["band", "key"]).select("band", "key", "t", "weight", F.col("b.t").alias("b"), F.col("b.weight").alias("heavy")))    # texts that share a key, with the smallest under it
    # the similarity is at most the smaller weight over the larger
    near = F.least("weight", "heavy") >= threshold * (1 - 1e-9) * F.greatest("weight", "heavy")
    pairs = shared.where("t <> b").where(near).select(F.col("t").alias("a"), "b").distinct()
    sets = written(_sets(rows, shared.select("t").distinct().join(texts.select("t", "first_id"), "t").withColumnRenamed("first_id", "doc_id"), weights))
    classes = components(written(_check(pairs, sets, threshold, even)))
    more = written(remaining(shared.select("band", "key", "t"), sets, classes, threshold, block_texts, block_shingles, even))
    if not more.isEmpty():
        classes = _merged(classes, more)
    placed = sketched.select("doc_id", "t").join(classes, "t", "left").withColumn("c", F.coalesce("c", "t"))
    worded = placed.where("t IS NOT NULL")
    named = worded.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    alone = placed.where("t IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("n_docs"), "t")
    return worded.join(named, "c").select("doc_id", "class_id", "n_docs", "t").union(alone)


def _sets(rows: DataFrame, asked: DataFrame, weights: Weights | Counted) -> DataFrame:
    """(t, h, n, w): shingles, their counts and the weight of each of the texts asked for, each read where its first id is."""
    def run(weigh: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for b in batches:
            out = []
            for t, words in zip(b.column(0).to_pylist(), _texts(b)):
                if words and name(words) == t:         # an id may have several texts
                    h, n = np.unique(shingles(words, weigh.size, seen), return_counts=True)
                    out.append((t, h.tobytes(), n.astype(np.uint32).tobytes(), weigh.weighted(h, np.ones(len(h)))[1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.binary()) for j in range(4)], schema=SET)

    told = rows.join(asked, rows["doc_id"].eqNullSafe(asked["doc_id"])).select("t", "text", *([] if isinstance(weights, Weights) else ["chunk"]))
    return weighed(told, weights, run, SET, "t binary, h binary, n binary, w binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each class, that with the smallest id; of rows that repeat it, one.  All columns stay."""
    kept = classes_of(docs, id_col=id_col, text_col=text_col, **how).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    first = docs.join(kept.withColumnRenamed("doc_id", "_kept"), docs[id_col].eqNullSafe(F.col("_kept")), "left_semi")
    return first.dropDuplicates([id_col])
