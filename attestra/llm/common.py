"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

import re
from typing import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import written

__all__ = ["WORD", "documents", "table", "fold", "lists", "Hashes", "hash_words", "written", "partitions"]

#: a word of every word-based operator: a run of letters, digits and underscores of the lower-cased text
WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no further column can clash."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id, which then belongs to no fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lists(offsets: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Rows of a ragged array: values between neighbouring offsets."""
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


class Hashes(dict[str, int]):
    """64-bit hashes of words, equal in every process (Python's own hash is not); each is computed when it is first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def hash_words(words: Iterable[str], seen: dict[str, int]) -> np.ndarray:
    """The hashes of ``Hashes``, kept in ``seen``; a plain dictionary is filled first, which takes longer."""
    words = list(words)
    if not isinstance(seen, Hashes):
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
