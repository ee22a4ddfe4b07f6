"""Exact top-k inner products over integer vectors, with MaxScore.

Components are the terms of a query.  Within a shard of candidates each term has an upper and a lower bound of its product
with the query's component.  Terms are ordered by what they can add; while the terms at the end cannot, together, lift a
candidate to the k-th best score so far, they are non-essential: candidates are first scored on the essential terms, and only
those that remain competitive are probed on the others, term by term.  Shards give their k best, which are merged.

Queries are dealt into blocks and candidates into shards by hashes, each of a set size, and every block of queries meets every
shard: a group of the two is one unit of work, and no pair of vectors is ever a row.  Vectors that are null, empty or hold null or non-finite components take no part.
Every row is a candidate and, if its id is asked, a query of its own, also where rows or ids repeat: a query leaves out its own row only, and is ranked by
itself.  A null id is a candidate that ties last, never a query.  Shorter vectors count as filled up with zeros.  An empty table
gives no rows.  Columns besides id and vector are left out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import written

NULL_ID = 2 ** 63 - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, floor(scale * x)) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(ok, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))).alias("v"))
            .where("v IS NOT NULL"))


def shard_top(query_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, step: int = 4096, group: int = 8) -> list[tuple[int, int, int]]:
    """(query row, id, score) of the k best of a shard for each query; ties to the smaller id; a query's own row is left out.

    A term's contribution above its lower bound is never negative and at most its ``spread``.  The longest tail of terms whose
    spreads add up to less than the k-th best score (above all lower bounds) is non-essential.  Bounds are float64 with a
    margin above their rounding; final scores are exact integers."""
    width = min(q.shape[1], m.shape[1])
    q, m = q[:, :width], m[:, :width]
    high, low = m.max(axis=0).astype(np.float64), m.min(axis=0).astype(np.float64)
    postings = np.ascontiguousarray(m.T, np.float64)
    out = []
    for own, v in zip(query_rows.tolist(), q):
        vd = v.astype(np.float64)
        upper, lower = np.maximum(vd * high, vd * low), np.minimum(vd * high, vd * low)
        order = np.argsort(lower - upper, kind="stable")                         # largest spread first
        tail = np.append(np.cumsum((upper - lower)[order][::-1])[::-1], 0.0)     # spreads of the terms from here on
        most = np.append(np.cumsum(upper[order][::-1])[::-1], 0.0)               # most that the terms from here on add
        slack = 1.0 + 1e-9 * (np.abs(upper).sum() + np.abs(lower).sum())
        top_s, top_i = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(m), step):
            bar = float(top_s[-1]) - slack if len(top_s) == k else -np.inf
            if most[0] < bar:
                break
            cut = width if bar == -np.inf else int(np.argmax(tail < bar - lower.sum()))
            essential = order[:cut]
            partial = vd[essential] @ postings[essential, at:at + step]
            alive = np.flatnonzero(partial + most[cut] >= bar)
            partial = partial[alive]
            for j in range(cut, width, group):                                   # probe the others while competitive
                if not len(alive):
                    break
                terms = order[j:j + group]
                partial = partial + vd[terms] @ postings[np.ix_(terms, alive + at)]
                keep = partial + most[min(j + group, width)] >= bar
                alive, partial = alive[keep], partial[keep]
            found = alive + at
            found = found[rows[found] != own]
            if len(found):
                s, i = np.concatenate([top_s, m[found] @ v]), np.concatenate([top_i, ids[found]])
                first = np.lexsort((i, -s))[:k]
                top_s, top_i = s[first], i[first]
        out += [(own, int(a), int(b)) for a, b in zip(top_i, top_s)]
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = t.column("row").to_numpy()
    ids = np.array([NULL_ID if i is None else i for i in t.column("vec_id").to_pylist()], np.int64)
    rows = t.column("v").combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    m = np.zeros((len(ids), sizes.max(initial=0)), np.int64)
    m[np.arange(m.shape[1])[None, :] < sizes[:, None]] = rows.flatten().to_numpy()
    return own, ids, m


def search(vectors: DataFrame, k: int = 5, every: int = 50, query_block: int = 4096, shard: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of all rows for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    # rows are numbered where they are written, so that equal ones stay apart
    rows = written(integers(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    asked = written(rows.where(F.col("vec_id") % every == 0))         # a table of its own: the two sides of a cogroup must not share columns
    blocks, shards = -(-asked.count() // query_block), -(-rows.count() // shard)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(shards, 1))).cast("int")).withColumn("block", numbers(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(blocks, 1))).cast("int")).withColumn("shard", numbers(shards))

    def best(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and queries.num_rows:
            asking, ids, q = _matrix(queries)
            name = dict(zip(asking.tolist(), ids.tolist()))
            found = [(row, name[row], *rest) for row, *rest in shard_top(asking, q, *_matrix(candidates), k)]
        return pa.table([pa.array([f[j] for f in found], pa.int64()) for j in range(4)], ["row", "query_id", "vec_id", "score"])

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(best, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score"))
