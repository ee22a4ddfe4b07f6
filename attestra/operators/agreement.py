"""What sources say about the subjects they share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, stats
from ..functions.text import ratio
from ..registry import Registry
from ..session import written
from .subjects import OUTCOMES, count_named


def outcomes(subjects: DataFrame) -> DataFrame:
    """Outcome counts and shares over subjects with two or more sources."""
    return count_named(subjects.where("n_sources >= 2"), "outcome", OUTCOMES)


def coverage(subjects: DataFrame) -> DataFrame:
    """Subjects, and how many of them more than one source names."""
    multi = F.count_if(F.col("n_sources") >= 2)
    return (subjects.agg(F.count("*").alias("n_subjects"), multi.alias("n_multi_source"))
            .withColumn("n_single_source", F.col("n_subjects") - F.col("n_multi_source"))
            .withColumn("multi_source_rate", ratio(F.col("n_multi_source"), F.col("n_subjects"))))


def opinions(claims: DataFrame, pick: Column, where: Column | None = None) -> DataFrame:
    """One label per (subject, source), chosen by ``pick`` over per-label counts, then subjects
    grouped by the whole list of (source, label): as many rows as there are different lists."""
    rows = claims if where is None else claims.where(where)
    per_label = (rows.groupBy("subject", "source", "canon")
                 .agg(F.count("*").alias("n"), F.min("claim_seq").alias("first_seq"), F.max("claim_seq").alias("last_seq")))
    per_source = per_label.groupBy("subject", "source").agg(pick.alias("label"), F.min("first_seq").alias("first_seq"))
    return (per_source.groupBy("subject")
            .agg(F.array_sort(F.collect_list(F.struct("source", "label"))).alias("said"), F.min("first_seq").alias("first_seq"))
            .groupBy("said").agg(F.count("*").alias("n"), F.min("first_seq").alias("first_seq")))


def modal_label() -> Column:
    """Most frequent label; of equally frequent ones the first seen."""
    return F.min_by("canon", F.struct(-F.col("n"), F.col("first_seq"), F.col("canon")))


def last_label() -> Column:
    return F.max_by("canon", F.struct(F.col("last_seq"), F.col("canon")))


def label_pairs(said: DataFrame) -> DataFrame:
    """(source_a, label_a, source_b, label_b, n): pairs are only formed inside a *distinct* list of
    opinions, weighted by the subjects that share it, never per subject."""
    a = said.select("n", "first_seq", "said", F.posexplode("said").alias("i", "a"))
    b = a.select("n", "first_seq", "i", "a", F.posexplode("said").alias("j", "b")).where("j > i")
    return (b.groupBy(F.col("a.source").alias("source_a"), F.col("a.label").alias("label_a"),
                      F.col("b.source").alias("source_b"), F.col("b.label").alias("label_b"))
            .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")))


def modal_labels(claims: DataFrame) -> DataFrame:
    """The label each source holds of each subject."""
    per_label = claims.groupBy("subject", "source", "canon").agg(
        F.count("*").alias("n"), F.min("claim_seq").alias("first_seq"))
    return per_label.groupBy("subject", "source").agg(modal_label().alias("canon"))


def polarity_conflict_pairs(claims: DataFrame, reg: Registry) -> DataFrame:
    """(source, label) against (source, label) of opposite polarity; a source's last known label counts."""
    pairs = label_pairs(opinions(claims, last_label(), F.col("canon") != reg.unknown))
    return pairs.where(labels.polarity_of(reg, F.col("label_a")) != labels.polarity_of(reg, F.col("label_b")))


def top_polarity_conflicts(claims: DataFrame, reg: Registry) -> DataFrame:
    return (polarity_conflict_pairs(claims, reg)
            .orderBy(F.desc("n"), "first_seq", "source_a", "label_a", "source_b", "label_b")
            .limit(reg.analysis["polarity_pairs_shown"]).drop("first_seq"))


def _chance_corrected(pairs: DataFrame, suffix: str) -> DataFrame:
    """Raw agreement and kappa per source pair from a (pair, label, label) count table."""
    both = F.array(F.struct(F.col("label_a").alias("k"), F.col("n").alias("left"), F.lit(0).cast("bigint").alias("right")),
                   F.struct(F.col("label_b").alias("k"), F.lit(0).cast("bigint").alias("left"), F.col("n").alias("right")))
    margins = (pairs.select("source_a", "source_b", F.explode(both).alias("m"))
               .groupBy("source_a", "source_b", "m.k").agg(F.sum("m.left").alias("left"), F.sum("m.right").alias("right")))
    exact = "decimal(19,0)"
    chance = margins.groupBy("source_a", "source_b").agg(
        F.sum(F.col("left").cast(exact) * F.col("right").cast(exact)).cast("double").alias("expected"))
    raw = pairs.groupBy("source_a", "source_b").agg(
        F.sum("n").alias(f"n{suffix}"),
        F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    n = F.col(f"n{suffix}").cast("double")
    agree = F.col("same") / n
    return (raw.join(chance, ["source_a", "source_b"])
            .select("source_a", "source_b", f"n{suffix}", agree.alias(f"percent_agreement{suffix}"),
                    stats.cohen_kappa(agree, F.col("expected") / (n * n)).alias(f"cohen_kappa{suffix}")))


def kappa(claims: DataFrame, reg: Registry) -> DataFrame:
    """Cohen's kappa of every overlapping source pair.  ``unknown`` is a class of the headline figure;
    the interpretable companion drops it."""
    pairs = written(label_pairs(opinions(claims, modal_label())))      # source and category pairs: read four times below
    unknown_a, unknown_b = F.col("label_a") == reg.unknown, F.col("label_b") == reg.unknown
    blank = (pairs.groupBy("source_a", "source_b")
             .agg(F.sum(F.when(unknown_a & unknown_b, F.col("n")).otherwise(0)).alias("n_both_unknown")))
    known = _chance_corrected(pairs.where(~unknown_a & ~unknown_b), "_interpretable")
    out = (_chance_corrected(pairs, "").join(blank, ["source_a", "source_b"])
           .join(known, ["source_a", "source_b"], "left")
           .withColumn("n_interpretable", F.coalesce("n_interpretable", F.lit(0).cast("bigint"))))
    return out.withColumn("substantial", F.coalesce(
        F.col("cohen_kappa") > F.lit(float(reg.analysis["kappa_substantial_above"])), F.lit(False)))


def kappa_summary(pairs: DataFrame) -> DataFrame:
    k = F.col("cohen_kappa")
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(k.isNull()).alias("n_undefined"),
                     F.count_if(F.abs(k) < 1e-9).alias("n_zero"), F.count_if(F.col("substantial")).alias("n_substantial"))
