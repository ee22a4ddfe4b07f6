"""Language identification with a byte convolutional network.

Bytes of the lower-cased text are embedded, convolved with filters of several widths, pooled by their maximum over a
window of fixed length and classified by a softmax.  The network is trained in numpy on the driver from a bounded sample of
labelled windows (``per_language`` texts of each language, ``most_examples`` in all); it is then applied to every window of
every text in batches, and a document's probabilities are the mean over its windows.

A text that is null or has no letter is ``und`` with score 0.  Labels that are null, and rows with a null id, are not learned
from; without any label every text is ``und``.  Rows may repeat and each gets its own result; equal texts have equal results.
An empty table gives no rows.  A long text is cut into windows that are scored in slices.  Columns besides id and text (and the
label, where learned) are left out.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents

UNKNOWN = "und"


@dataclass
class Network:
    """``classes`` sorted; kernels of all widths stand in one matrix, with zeros beyond their width."""
    classes: list[str]
    window: int = 256
    dim: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    seed: int = 7
    embed: np.ndarray = field(default=None, repr=False)
    kernels: np.ndarray = field(default=None, repr=False)
    bias: np.ndarray = field(default=None, repr=False)
    dense: np.ndarray = field(default=None, repr=False)
    offset: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        if self.embed is not None:
            return
        rng = np.random.default_rng(self.seed)
        n, span = self.filters * len(self.widths), max(self.widths) * self.dim
        self.embed = (rng.standard_normal((256, self.dim)) * 0.5).astype(np.float32)
        self.embed[0] = 0                            # padding
        self.kernels = (rng.standard_normal((n, span)) / np.sqrt(span)).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.dense = (rng.standard_normal((n, len(self.classes))) / np.sqrt(n)).astype(np.float32)
        self.offset = np.zeros(len(self.classes), np.float32)

    @property
    def mask(self) -> np.ndarray:
        reach = np.repeat(self.widths, self.filters)[:, None] * self.dim
        return (np.arange(max(self.widths) * self.dim)[None, :] < reach).astype(np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of each position and the ones after it: (widest * dim, windows * length)."""
        flat = windows.reshape(-1)
        x = np.take(np.ascontiguousarray(self.embed.T), flat, axis=1)
        out = np.zeros((max(self.widths) * self.dim, flat.size), np.float32)
        for j in range(max(self.widths)):
            out[j * self.dim:(j + 1) * self.dim, :flat.size - j] = x[:, j:] if j else x
        return out

    def pool(self, columns: np.ndarray, n: int) -> np.ndarray:
        """Filter responses before pooling: (filters, windows, positions), of which each width uses those inside the window."""
        return (self.kernels @ columns).reshape(len(self.kernels), n, self.window)

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        n = len(windows)
        z = self.pool(self.columns(windows), n)
        top = [z[i * self.filters:(i + 1) * self.filters, :, :self.window - w + 1].max(axis=2) for i, w in enumerate(self.widths)]
        return np.maximum(np.concatenate(top).T + self.bias, 0)

    def softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray, at_once: int = 128) -> np.ndarray:
        return np.concatenate([self.softmax(self.hidden(windows[i:i + at_once])) for i in range(0, len(windows), at_once)])

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam on the cross-entropy."""
        rng, mask = np.random.default_rng(self.seed), self.mask
        names = ("embed", "kernels", "bias", "dense", "offset")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                rows = order[lo:lo + batch]
                w, y, n = windows[rows], labels[rows], len(rows)
                cols = self.columns(w)
                z = self.pool(cols, n)
                at = np.concatenate([z[i * self.filters:(i + 1) * self.filters, :, :self.window - v + 1].argmax(axis=2) for i, v in enumerate(self.widths)])
                pre = np.take_along_axis(z, at[:, :, None], axis=2)[:, :, 0].T + self.bias
                h = np.maximum(pre, 0)
                p = self.softmax(h)
                p[np.arange(n), y] -= 1
                p /= n
                g = (p @ self.dense.T) * (pre > 0)                                  # (n, filters)
                where = at.T + np.arange(n)[:, None] * self.window                  # place of each maximum
                picked = cols[:, where]                                             # (span, n, filters)
                grad = {"dense": h.T @ p, "offset": p.sum(0), "bias": g.sum(0), "kernels": np.einsum("nf,snf->fs", g, picked) * mask}
                into = np.zeros_like(self.embed)
                flat = w.reshape(-1)
                for j in range(max(self.widths)):
                    part = g[:, :, None] * self.kernels[None, :, j * self.dim:(j + 1) * self.dim]
                    np.add.at(into, flat[np.minimum(where + j, flat.size - 1)].reshape(-1), part.reshape(-1, self.dim))
                into[0] = 0
                grad["embed"] = into
                t += 1
                step = rate * (1 - epoch / epochs)
                for k in names:
                    first[k] += 0.1 * (grad[k] - first[k])
                    second[k] += 0.001 * (grad[k] ** 2 - second[k])
                    getattr(self, k)[...] -= (step * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)


def as_windows(text: str, window: int) -> np.ndarray:
    """Bytes of the lower-cased text in rows of ``window``, the last one filled up with zeros."""
    raw = text.lower().encode("utf-8", "replace").replace(b"\0", b" ")
    rows = max(1, -(-len(raw) // window))
    return np.frombuffer(raw.ljust(rows * window, b"\0"), np.uint8).reshape(rows, window)


def examples(labelled: DataFrame, label: Column, per_language: int, most_examples: int, window: int) -> list[tuple[str, str]]:
    """A bounded sample: one stretch of text for each of ``per_language`` different texts of each language, chosen by hash."""
    own = labelled.select("text", label.alias("label")).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = own.groupBy("label").count()
    h = F.xxhash64("text")
    start = (F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.length("text") - window, F.lit(1))) + 1).cast("int")
    drawn = (own.join(F.broadcast(sizes.orderBy(F.desc("count"), "label").limit(most_examples)), "label")
             .where(F.pmod(h, F.lit(1 << 20)) < F.lit(4.0 * per_language * (1 << 20)) / F.col("count"))
             .groupBy("label", h.alias("h")).agg(F.min(F.substring("text", start, F.lit(window))).alias("part")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    kept = drawn.withColumn("k", rank).where(F.col("k") <= per_language).orderBy("k", "label").limit(most_examples)
    return [(r["label"], r["part"]) for r in kept.select("label", "part").collect()]


def fit(labelled: DataFrame, label: Column, per_language: int = 1200, most_examples: int = 20000, **shape) -> Network | None:
    """A trained network; every second example is cut short, so that short texts are known too.  None without labels."""
    window = shape.get("window", 256)
    drawn = examples(labelled, label, per_language, most_examples, window)
    classes = sorted({x for x, _ in drawn})
    if not classes:
        return None
    net, rng = Network(classes, **shape), np.random.default_rng(11)
    rows = []
    for i, (_, part) in enumerate(drawn):
        if i % 2:
            n = int(rng.integers(8, 80))
            at = int(rng.integers(0, max(1, len(part) - n)))
            part = part[at:at + n]
        rows.append(as_windows(part, window)[0])
    if len(classes) > 1:
        net.train(np.stack(rows), np.array([classes.index(x) for x, _ in drawn]))
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", slice_windows: int = 2048) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, known = b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = b.num_rows
            total, count = np.zeros((n, len(net.classes) if net else 1)), np.zeros(n)
            held, owner, size = [], [], 0

            def flush() -> None:
                if held:
                    p = net.predict(np.concatenate(held))
                    np.add.at(total, np.repeat(owner, [len(w) for w in held]), p)

            for i in np.flatnonzero(known) if net else ():
                w = as_windows(texts[int(i)].as_py(), net.window)
                count[i] = len(w)
                for lo in range(0, len(w), slice_windows):
                    held.append(w[lo:lo + slice_windows])
                    owner.append(i)
                    size += len(held[-1])
                    if size >= slice_windows:
                        flush()
                        held, owner, size = [], [], 0
            flush()
            mean = total / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1)
            names = [net.classes[k] if c else UNKNOWN for k, c in zip(best, count)] if net else [UNKNOWN] * n
            score = np.where(count > 0, mean[np.arange(n), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = documents(docs, id_col, text_col)
    return rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
