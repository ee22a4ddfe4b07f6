"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are compared: a document's evidence is the mean over its words of the
difference of the log-probabilities, so its length does not matter.  Each model discounts what it has counted and gives the
mass so saved to its unigrams, and those give theirs to *shared* continuation counts (of how many words a word follows, over
both classes).  A word or pair whose class counts do not differ for sure (``SURE``) has the shared probability in both models,
so a rare expression tells nothing by being rare.

All labelled words and word pairs are counted, distributed.  All that occur twice are kept, as tables; the frequent ones of
those that tell the classes apart are sent to the tasks, up to a stated number, and the rest are joined.

A logistic curve turns the mean difference into a probability.  It is fitted on a part of the labelled rows that the counts
leave out (at most ``most_calibration`` rows).  Empty and null texts, and all texts if a class has no rows, get the share of toxic
rows.  Null labels and null ids are not learned from; if a document has several labels it counts with each.  Repeated rows
are scored each, and equally.  An empty table gives no rows.  Columns besides id and text are left out.
"""
from __future__ import annotations

import functools
import itertools
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import WORD, documents, hash_words, written

DISCOUNT = 0.75
#: deviance from which on the classes are held to use an expression differently (chi-square with one degree of freedom)
SURE = 15.0
FLUSH = 400_000
#: pairs that a task sorts and adds up at a time
PAIRS_AT_ONCE = 1_000_000


@dataclass
class Model:
    """Log-ratios: of a word, of the mass a word leaves to unseen followers, and of a pair; ``base`` is the share of toxic rows."""
    words: dict[str, int]
    word: np.ndarray
    rest: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    base: float

    def evidence(self, texts: list[list[str]]) -> np.ndarray:
        """Mean log-ratio of each text's words; NaN for a text without words."""
        sizes = np.array([len(t) for t in texts])
        n = int(sizes.sum())
        ids = np.fromiter(map(self.words.get, itertools.chain.from_iterable(texts), itertools.repeat(0)), np.int64, n)
        value = self.word[ids]
        if n > 1:
            key = ids[:-1] * len(self.word) + ids[1:]
            follows = np.ones(n - 1, bool)
            follows[np.cumsum(sizes)[:-1][(np.cumsum(sizes)[:-1] > 0) & (np.cumsum(sizes)[:-1] < n)] - 1] = False   # not across texts
            at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
            known = self.pairs[at] == key if len(self.pairs) else np.zeros(n - 1, bool)
            with_pair = np.where(known, self.pair[at] if len(self.pairs) else 0.0, self.rest[ids[:-1]] + value[1:])
            value[1:] = np.where(follows, with_pair, value[1:])
        total = np.zeros(len(texts))
        np.add.at(total, np.repeat(np.arange(len(texts)), sizes), value)
        return np.where(sizes > 0, total / np.maximum(sizes, 1), np.nan)


def _counted(rows: DataFrame, keys, schema: str) -> DataFrame:
    """Counts of keys by class: combined within a task as far as memory allows, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out():
            names = list(set(held[0]) | set(held[1]))
            arrays = [pa.array(names), pa.array([held[0][x] for x in names], pa.int64()), pa.array([held[1][x] for x in names], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["key", "ordinary", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1)):
                held[toxic.as_py()].update(keys(text.as_py()))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield out()
                    held[0].clear(), held[1].clear()
        if held[0] or held[1]:
            yield out()

    counted = rows.select("text", "toxic").mapInArrow(run, f"{schema}, ordinary bigint, toxic bigint")
    return counted.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def deviance(seen: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Twice the log-likelihood by which the class counts ``seen`` (2, n) differ from a toxic share of ``share``."""
    n = np.maximum(seen.sum(axis=0), 1)
    out = np.zeros(seen.shape[1])
    for c, p in ((0, 1 - np.asarray(share)), (1, np.asarray(share))):
        out += np.where(seen[c] > 0, seen[c] * np.log(np.maximum(seen[c], 1e-9) / np.maximum(n * p, 1e-9)), 0.0)
    return 2 * out


def fit(rows: DataFrame, least_share: float = 0.0, least_count: int = 2) -> Model:
    """The model in memory, for small tables (``score`` uses ``tables``, which are held against it).  ``rows``: text and toxic (0 or 1).  Reads them twice, for words and for pairs of kept words."""
    spark = rows.sparkSession
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    words = written(_counted(rows, lambda t: WORD.findall((t or "").lower()), "key string"))
    tokens = words.agg(F.coalesce(F.sum("ordinary"), F.lit(0)).alias("o"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    cut = max(least_count, least_share * (tokens["o"] + tokens["t"]))
    # at most 1 / least_share words
    kept = words.where(F.col("ordinary") + F.col("toxic") >= cut).toArrow().sort_by("key")
    ids = {w: i for i, w in enumerate(kept.column("key").to_pylist(), 1)}
    size = len(ids) + 1                                # 0 is any other word
    count = np.zeros((2, size))
    count[:, 1:] = kept.column("ordinary").to_numpy(), kept.column("toxic").to_numpy()
    count[:, 0] = np.array([tokens["o"], tokens["t"]]) - count[:, 1:].sum(axis=1)
    known = spark.sparkContext.broadcast(ids)

    def pairs_of(text: str | None) -> list[int]:
        own = np.fromiter(map(known.value.get, WORD.findall((text or "").lower()), itertools.repeat(0)), np.int64)
        return (own[:-1] * size + own[1:])[(own[:-1] > 0) & (own[1:] > 0)].tolist()

    pairs = written(_counted(rows, pairs_of, "key bigint"))
    follows = np.zeros(size)                           # of how many different words a word is the follower
    told = pairs.groupBy((F.col("key") % size).alias("w")).agg(F.count("*").alias("n")).toArrow()
    follows[told.column("w").to_numpy()] = told.column("n").to_numpy()
    # at most 1 / least_share pairs
    frequent = pairs.where(F.col("ordinary") + F.col("toxic") >= cut).toArrow()
    key = frequent.column("key").to_numpy()
    order = np.argsort(key)
    key, seen = key[order], np.stack([frequent.column(c).to_numpy().astype(float) for c in ("ordinary", "toxic")])[:, order]
    known.unpersist()
    if not tokens["o"] or not tokens["t"]:
        return Model({}, np.zeros(1), np.zeros(1), np.empty(0, np.int64), np.empty(0), base)
    shared = (follows + 1.0) / (follows + 1.0).sum()   # a word that follows none keeps a little
    total = count.sum(axis=1, keepdims=True)
    told = deviance(count, total[1, 0] / total.sum()) >= SURE
    told[0] = False
    saved = DISCOUNT * (count > 0).sum(axis=1, keepdims=True) / total      # what the discount takes from all counted words
    unigram = np.maximum(count - DISCOUNT, 0) / total + saved * shared
    rest = (1 - unigram[:, told].sum(axis=1, keepdims=True)) / shared[~told].sum()
    unigram = np.where(told, unigram, rest * shared)                          # the others: shared counts alone
    before, after = key // size, key % size
    awaited = count[:, before] * unigram[:, after]
    sure = deviance(seen, awaited[1] / awaited.sum(axis=0)) >= SURE
    key, seen, before, after = key[sure], seen[:, sure], before[sure], after[sure]
    direct = np.maximum(seen - DISCOUNT, 0) / np.maximum(count[:, before], 1)
    left = np.ones((2, size))
    for c in range(2):
        np.subtract.at(left[c], before, direct[c])
    left = np.maximum(left, 1e-3)
    full = direct + left[:, before] * unigram[:, after]
    ratio = lambda p: np.log(p[1]) - np.log(p[0])
    return Model(ids, ratio(unigram), ratio(left), key, ratio(full), base)


def _told_apart(o, t, share):
    """``deviance`` as a column."""
    n = F.greatest(o + t, F.lit(1))
    part = lambda c, p: F.when(c > 0, c * F.ln(c / F.greatest(n * p, F.lit(1e-9)))).otherwise(0.0)
    return 2 * (part(o, 1 - share) + part(t, share))


def _pair_counts(rows: DataFrame, part: int, parts: int) -> DataFrame:
    """(b, a, ordinary, toxic) of the pairs whose first word's hash falls to ``part``: sorted and added up within a task by some many at a time, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, bool]] = []

        def out():
            b, a = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            toxic = np.repeat(np.array([x[2] for x in held], np.int64), [len(x[0]) for x in held])
            held.clear()
            order = np.lexsort((a, b))
            b, a, toxic = b[order], a[order], toxic[order]
            first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])))
            n, t = np.diff(np.append(first, len(b))), np.add.reduceat(toxic, first)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (b[first], a[first], n - t, t)], ["b", "a", "ordinary", "toxic"])

        size = 0
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                h = _hashed(text.as_py())
                if len(_SEEN) > FLUSH:
                    _SEEN.clear()
                mine = np.flatnonzero(h[:-1].view(np.uint64) % np.uint64(parts) == part)
                if len(mine):
                    held.append((h[mine], h[mine + 1], toxic.as_py() == 1))
                    size += len(mine)
                if size > PAIRS_AT_ONCE:
                    yield out()
                    size = 0
        if held:
            yield out()

    # no word is null; said here, as the join of ``_pairs`` would say it for one of its two readers only, and the shuffle serves both
    counted = rows.select("text", "toxic").mapInArrow(run, "b bigint, a bigint, ordinary bigint, toxic bigint").where("b IS NOT NULL")
    return counted.groupBy("b", "a").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _pairs(rows: DataFrame, kept: DataFrame, often, part: int, parts: int) -> DataFrame:
    """One part of the pairs of kept words: a row (b, a, ordinary, toxic) for each pair that is kept itself, as both its words then are, and of the others
    only how many end in a (``follows``)."""
    counted = _pair_counts(rows, part, parts)
    rare = (counted.where(~often).join(kept.select(F.col("key").alias("b")), "b", "left_semi").groupBy("a").agg(F.count("*").alias("follows"))
            .select(F.lit(None).cast("bigint").alias("b"), "a", *(F.lit(None).cast("bigint").alias(c) for c in ("ordinary", "toxic")), "follows"))
    return written(counted.where(often).withColumn("follows", F.lit(None).cast("bigint")).union(rare))


def tables(rows: DataFrame, least_count: int = 2, parts: int = 4) -> tuple[DataFrame | None, float, float]:
    """What ``fit`` computes, over tables of all words and pairs that occur ``least_count`` times: (b, a, value, before, n), the log-ratio of
    any other word, and the share of toxic rows.  A row is a word b whose ratio is ``value`` above the others' or that leaves ``before`` to
    what follows it, or a pair (b, a) with what it adds to its parts.  None if a class has no words.

    Pairs are counted in ``parts`` by their first word, one after the other, so that what is shuffled of them at a time is that part of the whole."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))

    words = written(_counted(rows, lambda t: _hashed(t).tolist(), "key bigint"))
    often = F.col("ordinary") + F.col("toxic") >= least_count
    s = words.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (
        ("o", F.col("ordinary")), ("t", F.col("toxic")), ("size", F.when(often, 1)), ("to", F.when(often & (F.col("ordinary") > 0), 1)), ("tt", F.when(often & (F.col("toxic") > 0), 1)),
        ("oo", F.when(~often, F.col("ordinary"))), ("ot", F.when(~often, F.col("toxic")))))).first()
    if not s["o"] or not s["t"]:
        return None, 0.0, base
    kept = words.where(often)
    found = [_pairs(rows, kept, often, part, parts) for part in range(parts)]
    pairs = functools.reduce(DataFrame.union, found).where("b IS NOT NULL").drop("follows")
    follows = written(functools.reduce(DataFrame.union, found).select(F.col("a").alias("key"), F.coalesce("follows", F.lit(1)).alias("n"))
                      .groupBy("key").agg(F.sum("n").alias("follows")).join(kept.select("key"), "key", "left_semi"))
    places = (follows.agg(F.sum("follows").alias("n")).first()["n"] or 0) + s["size"] + 1             # one place more for any other word
    shared = (F.coalesce("follows", F.lit(0)) + 1) / F.lit(float(places))
    unigram = lambda c, total, kinds: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * kinds / total * shared
    words = written(kept.join(follows, "key", "left").select(
        "key", "ordinary", "toxic", shared.alias("shared"), unigram("ordinary", s["o"], s["to"] + (s["oo"] > 0)).alias("u0"), unigram("toxic", s["t"], s["tt"] + (s["ot"] > 0)).alias("u1"),
        (_told_apart(F.col("ordinary"), F.col("toxic"), F.lit(s["t"] / (s["o"] + s["t"]))) >= SURE).alias("told")))
    r = words.agg(*(F.coalesce(F.sum(F.when(F.col("told") if own else ~F.col("told"), F.col(c))), F.lit(0.0)).alias(n) for n, c, own in (("u0", "u0", True), ("u1", "u1", True), ("shared", "shared", False)))).first()
    rest = [(1 - r[c]) / (r["shared"] + 1 / places) for c in ("u0", "u1")]
    other = float(np.log(rest[1]) - np.log(rest[0]))
    words = words.select("key", "ordinary", "toxic", "told", *(F.when(F.col("told"), F.col(c)).otherwise(F.col("shared") * x).alias(c) for c, x in zip(("u0", "u1"), rest)))
    both = (pairs.join(words.select(F.col("key").alias("b"), F.col("ordinary").alias("bo"), F.col("toxic").alias("bt")), "b")
            .join(words.select(F.col("key").alias("a"), "told", "u0", "u1"), "a"))
    awaited = F.col("bt") * F.col("u1") / (F.col("bo") * F.col("u0") + F.col("bt") * F.col("u1"))
    direct = lambda c, of: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(of, F.lit(1))
    sure = written(both.where(_told_apart(F.col("ordinary"), F.col("toxic"), awaited) >= SURE)
                   .select("b", "a", (F.col("ordinary") + F.col("toxic")).alias("n"), "told", "u0", "u1", direct("ordinary", "bo").alias("d0"), direct("toxic", "bt").alias("d1")))
    left = sure.groupBy("b").agg(*(F.greatest(1 - F.sum(f"d{c}"), F.lit(1e-3)).alias(f"l{c}") for c in (0, 1)))
    ratio = F.when(F.col("told"), F.ln(F.col("u1") / F.col("u0"))).otherwise(other)
    before = F.ln(F.col("l1") / F.col("l0"))
    of_words = (words.withColumnRenamed("key", "b").join(left, "b", "left").where("told OR l0 IS NOT NULL")
                .select("b", F.lit(None).cast("bigint").alias("a"), (ratio - other).alias("value"), F.coalesce(before, F.lit(0.0)).alias("before"), (F.col("ordinary") + F.col("toxic")).alias("n")))
    full = F.ln((F.col("d1") + F.col("l1") * F.col("u1")) / (F.col("d0") + F.col("l0") * F.col("u0")))
    of_pairs = sure.join(left, "b").select("b", "a", (full - before - ratio).alias("value"), F.lit(0.0).alias("before"), "n")
    return written(of_words.union(of_pairs)), other, base


def _hashed(text: str | None, seen: dict[str, int] | None = None) -> np.ndarray:
    return hash_words(WORD.findall((text or "").lower()), _SEEN if seen is None else seen).view(np.int64)


_SEEN: dict[str, int] = {}
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Sent:
    """The rows of ``tables`` that tasks hold, sorted by hash."""

    def __init__(self, told):
        b, a = told.column("b").to_numpy().view(np.uint64), told.column("a")
        single = np.array(a.is_null())
        value, before = told.column("value").to_numpy(), told.column("before").to_numpy()
        order = np.argsort(b[single])
        self.words, self.word, self.before = b[single][order], value[single][order], before[single][order]
        key = b[~single] * PAIR ^ a.drop_null().to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.pairs, self.pair = key[order], value[~single][order]

    @staticmethod
    def places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Where ``asked`` stand among the keys; -1 for others."""
        if not len(keys):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, at, -1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.view(np.uint64)
        return self.places(self.words, h), self.places(self.pairs, h[:-1] * PAIR ^ h[1:])


def table_evidence(docs: DataFrame, told: DataFrame | None, other: float, most_sent: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``evidence`` by the rows of ``tables``.  The frequent ones, at most ``most_sent``, go to every task; words and pairs that are not among
    them meet the others in a join, once for each different text."""
    spark, rows, cut = docs.sparkSession, documents(docs, id_col, text_col), 0
    if told is None:
        told = spark.createDataFrame([], "b bigint, a bigint, value double, before double, n bigint")
    taken = 0
    for r in sorted(told.groupBy(F.floor(F.log2("n")).alias("l")).agg(F.count("*").alias("rows")).collect(), reverse=True):     # by powers of two
        taken += r["rows"]
        if taken > most_sent:
            cut = 2 ** (r["l"] + 1)
            break
    sent = spark.sparkContext.broadcast(Sent(told.where(F.col("n") >= cut).select("b", "a", "value", "before").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            sums, sizes, names = [], [], []
            for text in b.column(1):
                h = _hashed(text.as_py())
                w, p = m.find(h)
                early = w[:-1]
                sums.append(float(m.word[w[w >= 0]].sum() + m.before[early[early >= 0]].sum() + m.pair[p[p >= 0]].sum()))
                sizes.append(len(h))
                names.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                if len(_SEEN) > FLUSH:
                    _SEEN.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], ["doc_id", "t", "s", "n_words"])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for text in b.column(1):
                h = _hashed(text.as_py())
                if not len(h):
                    continue
                w, p = m.find(h)
                own = Counter((x, None) for x in h[w < 0].tolist())
                own.update(zip(h[:-1][p < 0].tolist(), h[1:][p < 0].tolist()))
                last, keys = (int(h[-1]), None), list(own)
                rows = [[xxhash.xxh3_128_digest(h.tobytes())] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [own[k] for k in keys], [own[k] - (k == last) for k in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), *(pa.array(x, pa.int64()) for x in rows[1:])], ["t", "b", "a", "times", "followed"])

    found = rows.mapInArrow(run, "doc_id bigint, t binary, s double, n_words bigint")
    if cut:
        few = told.where(F.col("n") < cut).select(F.col("b").alias("fb"), F.col("a").alias("fa"), "value", "before")
        asked = rows.mapInArrow(missing, "t binary, b bigint, a bigint, times bigint, followed bigint").distinct()
        more = (asked.join(few, (F.col("b") == F.col("fb")) & F.col("a").eqNullSafe(F.col("fa")))
                .groupBy("t").agg(F.sum(F.col("times") * F.col("value") + F.col("followed") * F.col("before")).alias("more")))
        found = found.join(more, "t", "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0)))
    return found.select("doc_id", F.when(F.col("n_words") > 0, other + F.col("s") / F.col("n_words")).alias("evidence"), "n_words")


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 200_000) -> DataFrame:
    """doc_id, mean log-ratio (null without words) and number of words of each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            held, size, found, sizes = [], 0, [], []
            for text in b.column(1):
                held.append(WORD.findall((text.as_py() or "").lower()))
                size += len(held[-1])
                if size > words_at_once:
                    found.append(m.evidence(held))
                    sizes += map(len, held)
                    held, size = [], 0
            if held:
                found.append(m.evidence(held))
                sizes += map(len, held)
            value = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64(), mask=np.isnan(value)), pa.array(sizes, pa.int64())], ["doc_id", "evidence", "n_words"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, evidence double, n_words bigint")


def curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by damped Newton steps with a small ridge."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        g = z @ (p - y) + 1e-2 * w
        w = w - 0.7 * np.linalg.solve((z * (p * (1 - p) + 1e-9)) @ z.T + 1e-2 * np.eye(2), g)
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, labels: DataFrame, learn_from, calibrate_on, threshold: float = 0.3, most_calibration: int = 50_000, most_sent: int = 1_000_000,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """doc_id, score, predicted.  ``learn_from`` and ``calibrate_on`` are conditions on the id, apart from one another."""
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    rows = documents(docs, id_col, text_col)
    # the labels grow with the documents, so the same join at every size
    learned = written(rows.where(learn_from).join(told.where(learn_from).hint("shuffle_merge"), "doc_id").select("text", "toxic"), compression="zstd")
    ratios, other, share = tables(learned, **how)
    found = written(table_evidence(rows, ratios, other, most_sent))
    part = (found.where(calibrate_on).where("evidence IS NOT NULL").join(told.where(calibrate_on), "doc_id")
            .select("evidence", "toxic", F.xxhash64("doc_id", "evidence").alias("h")).orderBy("h").limit(most_calibration).select("evidence", "toxic").toArrow())
    x, y = part.column("evidence").to_numpy(), part.column("toxic").to_numpy().astype(float)
    slope, base = curve(x, y) if 0 < y.sum() < len(y) else (0.0, 0.0)
    if slope <= 0:                                     # nothing learned: the share of toxic rows
        p = F.lit(share)
    else:
        p = 1 / (1 + F.exp(-(F.col("evidence") * slope + base)))
    p = F.coalesce(p, F.lit(share))
    return found.select("doc_id", p.alias("score"), F.when(p >= threshold, 1).otherwise(0).alias("predicted"), "n_words")
