"""Spelling variants: words one edit apart, found with blocked Gram matrices of letter counts.

A word is a vector of letter counts.  One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by 2,
so near words have squared distances of at most two and lengths that differ by at most one.  Words lie in blocks of one length; two blocks of the same or of adjacent
lengths are one unit of work, in which a product of their count matrices gives all squared distances.  Pairs at a distance that one edit
makes are then verified letter by letter.

So that work grows with the words and not with their square, a length is divided further by how many letters of each of a few groups of
letters a word has.  One edit takes a letter from at most one group and adds one to at most one, so only blocks whose group counts
differ by that meet, and no pair is lost.  The letters are dealt into groups of about equal use, and the number of groups grows with the number of words.  A
division with more than ``block`` words is cut by hashes, and all its cuts meet.

Words are runs of ``pattern`` with at least ``least`` code points, within Latin-1, lower-cased in A to Z only.  Null and empty texts hold no
word; repeated rows count again; a null id counts as an empty one; whole texts are read; an empty table gives no rows.  Columns besides id and text are left out.
"""
from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents, written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slips(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, without one letter where ``every`` divides crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, least: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of all words of at least ``least`` letters that occur ``least_count`` times."""
    # shorter runs cannot become words; a run of the pattern is maximal, as the pattern takes all it can
    runs = documents(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    found = runs.select(slips(F.col("doc_id"), F.translate("run", UPPER, LOWER), every).alias("word"))
    return found.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_groups(ws: DataFrame, groups: int) -> list[str]:
    """The letters in use, dealt into groups of about equal use, the most frequent first."""
    use = ws.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()      # one row a letter
    out, load = [""] * groups, [0] * groups
    for r in sorted(use, key=lambda r: (-r["count"], r["c"])):
        g = load.index(min(load))
        out[g], load[g] = out[g] + r["c"], load[g] + r["count"]
    return [g for g in out if g]


def blocks_of(ws: DataFrame, groups: Sequence[str], block: int) -> DataFrame:
    """(cell, sub, size, letters, ns): words of one length and one count in each group, at most about ``block`` of them in a row; a
    cell is an array of the length and the counts."""
    count = lambda g: F.char_length("word") - F.char_length(F.translate("word", g, ""))
    ws = ws.withColumn("cell", F.array(F.char_length("word"), *(count(g) for g in groups[:-1])))    # the last count follows from the others
    cuts = ws.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    dealt = ws.join(cuts, "cell").withColumn("sub", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    rows = dealt.groupBy("cell", "sub").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    # a row is copied to each of its neighbours: words of one length need no marks between them, and most counts have one digit
    return rows.select("cell", "sub", F.array_join("w.word", "").alias("letters"), F.array_join(F.col("w.n").cast("array<string>"), ",").alias("ns"))


def steps(groups: int) -> list[list[int]]:
    """How the cell of a near word may differ, each unordered pair of cells once: nothing, a letter of one group for one of a group further
    on, and one more letter.  Counts of the last group are not part of a cell."""
    def step(longer: int, minus: int | None, plus: int) -> list[int]:
        s = [0] * (groups + 1)
        s[0], s[plus + 1] = longer, 1
        if minus is not None:
            s[minus + 1] = -1
        return s[:-1]
    return [[0] * groups, *(step(0, a, b) for b in range(groups) for a in range(b)), *(step(1, None, g) for g in range(groups))]


def _codes(letters: str, length: int) -> np.ndarray:
    return np.frombuffer(letters.encode("latin-1"), np.uint8).reshape(-1, length)


def _counts(codes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Letter counts of words as columns of ``used`` letters, with two more columns so that a product of the left and the right form is minus half
    the squared distance."""
    at = codes.astype(np.int64) + 256 * np.arange(len(codes))[:, None]
    return np.bincount(at.ravel(), minlength=256 * len(codes)).reshape(len(codes), 256)[:, used].astype(np.float32)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of words one edit apart; ``b`` has the length of ``a`` or one more.  ``same``: b is a, each pair once."""
    flags = np.zeros(256, bool)
    flags[a.ravel()] = flags[b.ravel()] = True
    used = np.flatnonzero(flags)
    x, y = _counts(a, used), _counts(b, used)
    one = lambda m: np.ones((len(m), 1), np.float32)
    half = lambda m: -0.5 * (m * m).sum(axis=1, keepdims=True)
    # minus half the squared distance: |x|^2 and |y|^2 ride along as further columns of the product
    gram = np.hstack([x, half(x), one(x)]) @ np.hstack([y, one(y), half(y)]).T
    longer = b.shape[1] - a.shape[1]
    i, j = np.divmod(np.flatnonzero(gram.ravel() >= (-0.75 if longer else -1.25)), len(b))
    if same:
        i, j = i[i < j], j[i < j]
    left, right = a[i], b[j]
    if longer:                                     # what they share at the front and at the back covers the shorter word
        front = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
        back = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        ok = front + back >= a.shape[1]
    else:
        ok = (left != right).sum(axis=1) == 1
    return i[ok], j[ok]


def _best(at: np.ndarray, other: np.ndarray, own: np.ndarray, words: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word that occurs in ``at``: word, number of near words, count and spelling of the best of them."""
    order = np.lexsort((words[other], -ns[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    best = other[first]
    return own[at[first]], np.diff(first, append=len(at)), ns[best], words[best]


def _text(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([w.decode("latin-1") for p in parts for w in p.tolist()], pa.string())


def _units(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for at in range(0, batch.num_rows, step):
            for u in batch.slice(at, step).to_pylist():
                a, b = _codes(u["left"], u["length"]), _codes(u["right"], u["length"] + u["longer"])
                i, j = near_pairs(a, b, u["same"])
                if not len(i):
                    continue
                own, other = a.view(f"S{a.shape[1]}").ravel(), b.view(f"S{b.shape[1]}").ravel()
                own_n, other_n = (np.array(u[c].split(","), np.int64) for c in ("left_ns", "right_ns"))
                if u["same"]:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                else:
                    out.append(_best(j, i, other, own, own_n))
                out.append(_best(i, j, own, other, other_n))
        numbers = [pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([_text([o[0] for o in out]), *numbers, _text([o[3] for o in out])], ["word", "n_near", "form_n", "form"])


def groups_for(n: int) -> int:
    """So many groups of letters that a cell stays at some hundreds of words: one more for every fourfold number of words."""
    return max(1, round(math.log(max(n, 1) / 1000, 4)) if n > 1000 else 1)


def near_words(ws: DataFrame, block: int = 512, groups: int | None = None) -> DataFrame:
    """(word, n_near, form_n, form): for each word with near ones how many there are, and the most frequent (ties: the smallest)."""
    letters = letter_groups(ws, groups or groups_for(ws.count()))
    cells = written(blocks_of(ws, letters, block))
    move = F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps(max(len(letters), 1))))
    left = cells.select(F.col("cell").alias("from"), F.col("sub").alias("left_sub"), F.col("letters").alias("left"), F.col("ns").alias("left_ns"), F.explode(move).alias("step"))
    left = left.withColumn("cell", F.zip_with("from", "step", lambda a, b: a + b))
    stay = F.forall("step", lambda x: x == 0)
    units = left.join(cells.select("cell", F.col("sub").alias("right_sub"), F.col("letters").alias("right"), F.col("ns").alias("right_ns")), "cell")
    units = units.where(~stay | (F.col("left_sub") <= F.col("right_sub"))).select(
        F.col("from")[0].alias("length"), F.col("step")[0].alias("longer"), (stay & (F.col("left_sub") == F.col("right_sub"))).alias("same"), "left", "left_ns", "right", "right_ns")
    found = units.mapInArrow(_units, "word string, n_near bigint, form_n bigint, form string")
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form_n", "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow from a word.  A form is at least twice as frequent as its word, so no chain is
    longer than 62 and each turn doubles what is followed."""
    chain = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(6):
        on = written(chain.alias("a").join(chain.alias("b"), F.col("a.root") == F.col("b.word"), "left")
                     .select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        chain = on.select("word", "root")
        if on.where("moved").isEmpty():
            break
    return chain


def variants(docs: DataFrame, least: int = 7, least_count: int = 2, ratio: int = 10, every: int = 31, block: int = 512, groups: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word; a form is the best near word if it occurs ``ratio`` (at least 2) times as often."""
    ws = written(words(docs, least, least_count, every))
    near = ws.join(near_words(ws, block, groups), "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    table = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    chains = roots(table.where("form IS NOT NULL"))
    return table.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
