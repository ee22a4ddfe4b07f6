"""Quality by co-training two views of a document.

The content view sees only the text, as measured shapes of its characters, words and lines; the metadata view sees only what is
stored beside it (source, language, length), as hashed indicator columns.  Each view is a logistic classifier.  They start from
a bounded sample of labelled rows; then, for ``rounds`` rounds, each view scores *all* documents and gives the other one the
``share`` of them that it is surest of, as pseudo-labels, a bounded sample of which (``most_pseudo``) is added to the other's
training set.  At the end each view is calibrated on labelled rows that no training saw, and the calibrated log-odds are added
with the base rate counted once.  A view that tells nothing is calibrated to the base rate, and then adds nothing.

Measures are written once; the rounds read them and not the texts.  Null texts count as empty, other null columns are a value of
their own.  Null labels and null ids are not learned from.  Repeated rows are scored each and equally.  Without labels of both
kinds nothing is learned and each score is the base rate (1 without labels at all), so nothing is rejected.  An empty table gives
no rows.  Ties in sureness are taken by hash.  Columns besides those named are left out of scores and kept in documents.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import fold, written

SHAPES = ("words", "letters", "digits", "upper", "marks", "spaces", "word_length", "capital_words", "upper_words", "marked_words", "lone_marks", "different_words",
          "top_word", "lines", "line_words", "repeated_lines", "sentence_marks", "long_words", "repeated_run")
BUCKETS = 64
_SPLIT = re.compile(r"\S+")


def shapes(text: str) -> np.ndarray:
    """What the content view sees of a text."""
    n = max(1, len(text))
    words = _SPLIT.findall(text)
    m = max(1, len(words))
    kinds = Counter(text)                              # one look per different character
    letters, digits, upper = (sum(v for c, v in kinds.items() if is_(c)) for is_ in (str.isalpha, str.isdigit, str.isupper))
    spaces = sum(v for c, v in kinds.items() if c.isspace())
    lines = [x for x in text.split("\n") if x.strip()]
    told = Counter(words)
    marked = sum(v for w, v in told.items() if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'")
    lone = sum(v for w, v in told.items() if not any(map(str.isalnum, w)))
    caps = sum(v for w, v in told.items() if w[0].isupper())
    full = sum(v for w, v in told.items() if len(w) > 1 and w.isupper())
    half = len(words) // 2
    return np.array([np.log1p(len(words)), letters / n, digits / n, upper / n, (n - letters - digits - spaces) / n, spaces / n, np.log1p(len(text) / m), caps / m, full / m, marked / m,
                     lone / m, len(told) / m, max(told.values(), default=0) / m, np.log1p(len(lines)), np.log1p(m / max(1, len(lines))),
                     1 - len(set(lines)) / max(1, len(lines)), sum(kinds.get(c, 0) for c in ".!?") / m, sum(v for w, v in told.items() if len(w) > 20) / m,
                     float(half > 3 and words[:half] == words[half:2 * half])])


def measures(docs: DataFrame, columns: tuple[str, ...], length_col: str | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, content and meta (as bytes of doubles) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, meta = [], []
            beside = [c.to_pylist() for c in b.columns[2:]]
            for i, text in enumerate(b.column(1)):
                content.append(shapes(text.as_py() or "").tobytes())
                m = np.zeros(BUCKETS)
                for k, values in enumerate(beside):
                    m[zlib.crc32(f"{k}|{values[i]}".encode("utf-8", "surrogatepass")) % BUCKETS] += 1
                meta.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "content", "meta"])

    beside = [F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(columns)]
    if length_col:
        beside.append(F.floor(F.log2(F.greatest(F.col(length_col).cast("double"), F.lit(0.0)) + 1) * 2).cast("string").alias("length"))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *beside).mapInArrow(run, "doc_id bigint, content binary, meta binary")


@dataclass
class View:
    """A logistic classifier over standardised columns, with a calibrating curve."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    base: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, sure: np.ndarray, ridge: float = 1.0, steps: int = 25) -> "View":
        """Newton steps with a ridge; ``sure`` weighs the rows.  The wide columns also enter as squares, for what is off in both ways."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        out = cls(mean, scale, np.zeros(2 * x.shape[1] + 1))
        z = out.columns(x)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ out.weights, -30, 30)))
            g = z.T @ (sure * (p - y)) + ridge * out.weights
            h = (z * (sure * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge * np.eye(len(out.weights))
            step = np.linalg.solve(h, g)
            out.weights = out.weights - step
            if np.abs(step).max() < 1e-6:
                break
        return out

    def columns(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 3, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.columns(x) @ self.weights, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        from attestra.llm.toxicity import curve

        self.slope, self.base = curve(self.raw(x), y)
        if self.slope <= 0:                            # worse than nothing on new rows: the base rate
            rate = (y.sum() + 0.5) / (len(y) + 1)
            self.slope, self.base = 0.0, float(np.log(rate / (1 - rate)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.base


def _array(column, width: int) -> np.ndarray:
    return np.array([np.frombuffer(v.as_buffer(), np.float64) for v in column]).reshape(-1, width)


WIDTHS = {"content": len(SHAPES), "meta": BUCKETS}


def _sample(rows: DataFrame, most: int) -> pa.Table:
    """At most ``most`` rows, the first by hash of what they hold."""
    h = F.xxhash64("content", "meta", "y")
    return rows.withColumn("h", h).orderBy("h").limit(most).toArrow()


@dataclass
class Scorer:
    views: dict[str, View]
    prior: float

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of good quality: the views' log-odds added, the prior's counted once."""
        total = sum(self.views[v].log_odds(x[v]) for v in self.views) - (len(self.views) - 1) * self.prior if self.views else None
        n = len(next(iter(x.values())))
        return np.full(n, 1 / (1 + np.exp(-self.prior))) if total is None else 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _surest(measured: DataFrame, view: View, name: str, rounds_seed: int, share: float, most: int) -> pa.Table:
    """A bounded sample of the ``share`` of all documents that a view is surest of, for each class, with the view's label as y."""
    sent = measured.sparkSession.sparkContext.broadcast(view)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = sent.value.raw(_array(b.column(b.schema.get_field_index(name)), WIDTHS[name])) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(odds)], ["content", "meta", "odds"])

    scored = written(measured.select("content", "meta").mapInArrow(run, "content binary, meta binary, odds double"))
    low, high = scored.agg(F.percentile_approx("odds", F.array(F.lit(share), F.lit(1 - share)), F.lit(2000)).alias("q")).first()["q"] or (0.0, 0.0)
    picked = []
    for label, test in ((0, F.col("odds") <= min(low, -1.0)), (1, F.col("odds") >= max(high, 1.0))):
        picked.append(scored.where(test).select("content", "meta", F.lit(label).alias("y")).distinct().withColumn("h", F.xxhash64("content", "meta", F.lit(rounds_seed))).orderBy("h").limit(most))
    return picked[0].union(picked[1]).select("content", "meta", "y").toArrow()


def train(measured: DataFrame, labels: DataFrame, label_col: str, id_col: str, rounds: int = 3, share: float = 0.02, most_labelled: int = 20000, most_pseudo: int = 1000) -> Scorer:
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    known = written(measured.join(told, "doc_id").select("doc_id", "content", "meta", "y"))
    spare = fold("doc_id", 4) == 0
    learned, kept = _sample(known.where(~spare).drop("doc_id"), most_labelled), _sample(known.where(spare).drop("doc_id"), most_labelled)
    own = lambda t: {v: _array(t.column(v), WIDTHS[v]) for v in WIDTHS}
    y, x = learned.column("y").to_numpy().astype(float), own(learned)
    cy, cx = kept.column("y").to_numpy().astype(float), own(kept)
    both = np.concatenate([y, cy])
    rate = (both.sum() + 0.5) / (len(both) + 1) if len(both) else 0.999
    prior = float(np.log(rate / (1 - rate)))
    if len(set(y)) < 2 or len(set(cy)) < 2:
        return Scorer({}, prior if len(both) else 30.0)
    views = {v: View.fit(x[v], y, np.ones(len(y))) for v in WIDTHS}
    for r in range(rounds):
        new = {}
        for v, other in (("content", "meta"), ("meta", "content")):
            given = _surest(measured, views[other], other, r, share, most_pseudo)      # the other view teaches this one
            gx, gy = own(given)[v], given.column("y").to_numpy().astype(float)
            sure = np.concatenate([np.ones(len(y)), np.full(len(gy), 0.3)])
            new[v] = View.fit(np.concatenate([x[v], gx]), np.concatenate([y, gy]), sure)
        # a view keeps what it was taught only if it then does no worse on the rows kept apart
        for v in WIDTHS:
            views[v] = min((views[v], new[v]), key=lambda w: _loss(w, cx[v], cy))
    for v in WIDTHS:
        views[v].calibrate(cx[v], cy)
    return Scorer(views, prior)


def _loss(view: View, x: np.ndarray, y: np.ndarray) -> float:
    """Log-loss after calibration."""
    trial = View(view.mean, view.scale, view.weights)
    trial.calibrate(x, y)
    z = trial.log_odds(x)
    return float(np.mean(np.logaddexp(0, -z * (2 * y - 1))))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", columns: tuple[str, ...] = ("source", "lang"), length_col: str | None = "n_chars",
          id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, score, content_score, meta_score, keep of each row."""
    measured = written(measures(docs, columns, length_col, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(train(measured, labels, label_col, id_col, **how))
    return _apply(measured, sent, threshold)


def _apply(measured: DataFrame, sent, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            x = {v: _array(b.column(b.schema.get_field_index(v)), WIDTHS[v]) for v in WIDTHS}
            p = s.score(x) if b.num_rows else np.empty(0)
            one = [1 / (1 + np.exp(-np.clip(s.views[v].log_odds(x[v]), -30, 30))) if s.views else p for v in WIDTHS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(one[0]), pa.array(one[1]), pa.array(p >= threshold)], ["doc_id", "score", "content_score", "meta_score", "keep"])

    return measured.select("doc_id", "content", "meta").mapInArrow(run, "doc_id bigint, score double, content_score double, meta_score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without those that are rejected.  A repeated id is rejected only where all its rows are."""
    bad = score(docs, labels, id_col=id_col, **how).groupBy("doc_id").agg(F.max("keep").alias("keep")).where("NOT keep").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad")), "left_anti")
