"""Which sources name the same subjects: sizes, overlap, containment, depth.

Everything is read off *source lists*: the subjects grouped by the exact set of sources that
name them.  One pass over the claims leaves a small table from which every pairwise figure
follows, so no pair is ever formed per subject.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..registry import Registry
from ..session import written
from .subjects import source_lists


def source_set_counts(claims: DataFrame) -> DataFrame:
    """sources ARRAY<STRING>, n: how many subjects exactly this set of sources names.  Written, as
    every figure below reads it more than once."""
    return written(source_lists(claims).groupBy("sources").agg(F.count("*").alias("n")))


def depth(sets: DataFrame) -> DataFrame:
    """Subjects by number of sources."""
    return sets.groupBy(F.size("sources").alias("n_sources")).agg(F.sum("n").alias("n_subjects"))


def depth_buckets(sets: DataFrame) -> DataFrame:
    """Depth 1, 2, 3, 4 and 5+ with shares; every bucket is present."""
    k = F.size("sources")
    one = sets.agg(F.sum("n").alias("total"), *[F.sum(F.when(k == i, F.col("n")).otherwise(0)).alias(f"b{i}") for i in (1, 2, 3, 4)],
                   F.sum(F.when(k >= 5, F.col("n")).otherwise(0)).alias("b5"))
    rows = F.array(*[F.struct(F.lit(name).alias("depth"), F.col(f"b{i}").alias("n_subjects"))
                     for i, name in ((1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5+"))])
    return (one.select("total", F.explode(rows).alias("r"))
            .select("r.depth", "r.n_subjects", ratio(F.col("r.n_subjects"), F.col("total")).alias("share")))


def source_sizes(sets: DataFrame) -> DataFrame:
    """Subjects of each source, and how many of them another source also names."""
    s = sets.select(F.explode("sources").alias("source"), F.size("sources").alias("k"), "n")
    return s.groupBy("source").agg(F.sum("n").alias("n_subjects"),
                                   F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("n_covered"))


def pair_overlap(sets: DataFrame) -> DataFrame:
    """Intersection of every pair of sources, zero overlaps included."""
    everyone = sets.select(F.explode("sources").alias("s")).agg(F.array_sort(F.collect_set("s")).alias("sources"))
    lists = sets.unionByName(everyone.withColumn("n", F.lit(0).cast("bigint")))
    a = lists.select("n", "sources", F.posexplode("sources").alias("i", "source_a"))
    return (a.select("n", "i", "source_a", F.posexplode("sources").alias("j", "source_b")).where("j > i")
            .groupBy("source_a", "source_b").agg(F.sum("n").alias("intersection")))


def overlap_matrix(sets: DataFrame) -> DataFrame:
    """Every ordered pair of sources: intersection, share of each side, Jaccard."""
    pairs, sizes = pair_overlap(sets), source_sizes(sets).select("source", "n_subjects")
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("other")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("other")))
    rows = pairs.select("intersection", F.explode(both).alias("p")).select("p.*", "intersection")
    other = sizes.select(F.col("source").alias("other"), F.col("n_subjects").alias("n_other"))
    n = F.col("intersection")
    return (rows.join(sizes, "source").join(other, "other")
            .select("source", "other", "intersection", ratio(n, F.col("n_subjects")).alias("share_of_source"),
                    ratio(n, F.col("n_other")).alias("share_of_other"),
                    ratio(n, F.col("n_subjects") + F.col("n_other") - n).alias("jaccard")))


def source_coverage(sets: DataFrame) -> DataFrame:
    """Per source: share other sources can check, and its largest single overlap."""
    best = overlap_matrix(sets).groupBy("source").agg(F.max("share_of_source").alias("max_pairwise_share"))
    share = ratio(F.col("n_covered"), F.col("n_subjects"))
    return (source_sizes(sets).join(best, "source", "left")
            .select("source", "n_subjects", "n_covered", share.alias("covered_share"),
                    (F.lit(1.0) - share).alias("uncovered_share"), "max_pairwise_share"))


def containment(sets: DataFrame) -> DataFrame:
    """Share of each source contained in each other one; pairs without overlap are left out."""
    return (overlap_matrix(sets).where("intersection > 0")
            .select("source", F.col("other").alias("inside"), F.col("intersection").alias("n"),
                    F.col("share_of_source").alias("share_of_a")))


def top_containment(sets: DataFrame, reg: Registry) -> DataFrame:
    return (containment(sets).orderBy(F.desc("share_of_a"), "source", "inside")
            .limit(reg.analysis["containment_shown"]))
