"""Roots of the evidence across a claim table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..registry import Registry


def dominant_root(claims: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The root most claims of a subject go back to; of equal ones the first seen."""
    keys = keys or ["subject"]
    per_root = claims.groupBy(*keys, "root", "root_known").agg(F.count("*").alias("n"), F.min("claim_seq").alias("first_seq"))
    best = F.min_by(F.struct("root", "root_known"), F.struct(-F.col("n"), F.col("first_seq"), F.col("root")))
    return per_root.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.root", "b.root_known")


def root_claims(claims: DataFrame) -> DataFrame:
    return claims.groupBy("root", "root_known").agg(F.count("*").alias("n_claims"), F.min("claim_seq").alias("first_seq"))


def root_totals(claims: DataFrame) -> DataFrame:
    return (root_claims(claims).agg(F.count("*").alias("n_roots"), F.count_if("root_known").alias("n_identified"))
            .withColumn("n_unresolved", F.col("n_roots") - F.col("n_identified")))


def unresolved_subjects(claims: DataFrame) -> DataFrame:
    """Subjects whose dominant root is unresolved."""
    return (dominant_root(claims).agg(F.count("*").alias("n_subjects"), F.count_if(~F.col("root_known")).alias("n_unresolved"))
            .withColumn("unresolved_share", ratio(F.col("n_unresolved"), F.col("n_subjects"))))


def root_concentration(claims: DataFrame, reg: Registry, limit: int | None = None) -> DataFrame:
    """The roots most claims go back to, with their share of all claims."""
    per_root = root_claims(claims)
    total = per_root.agg(F.sum("n_claims").alias("total"))
    shown = per_root.orderBy(F.desc("n_claims"), "first_seq", "root").limit(limit or reg.analysis["root_concentration_shown"])
    # `total` is a single row: a scalar attached to the few rows shown
    return (shown.join(F.broadcast(total))
            .select("root", "n_claims", ratio(F.col("n_claims"), F.col("total")).alias("share"), "root_known"))


def roots_per_subject(subjects: DataFrame) -> DataFrame:
    """Histogram of distinct roots over subjects with several sources; every root string counts."""
    return subjects.where("n_sources >= 2").groupBy("n_roots").agg(F.count("*").alias("n_subjects"))


def within_source_roots(claims: DataFrame) -> DataFrame:
    """Per source, the share of its subjects under each root."""
    pairs = claims.select("source", "root", "subject").distinct()
    sizes = (pairs.select("source", "subject").distinct().groupBy("source").agg(F.count("*").alias("size")))
    return (pairs.groupBy("source", "root").agg(F.count("*").alias("n_subjects")).join(sizes, "source")
            .select("source", "root", "n_subjects", ratio(F.col("n_subjects"), F.col("size")).alias("share")))


def circular_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.where("n_sources >= 2").agg(F.count("*").alias("n_multi_source"),
                                                F.count_if("circular").alias("n_circular"))


def reroot(claims: DataFrame, condition, other_root: str, reg: Registry) -> DataFrame:
    """What if the selected claims went back to another root?  Circular subjects among those the
    selection touches, as loaded and re-rooted: both versions in one pass over the claims."""
    from ..functions.provenance import root_known
    from .subjects import subject_table
    touched = claims.where(condition).select("subject").distinct()
    here = claims.join(touched, "subject", "left_semi")
    moved = here.withColumn("root", F.when(condition, F.lit(other_root)).otherwise(F.col("root")))
    moved = moved.withColumn("root_known", root_known(reg, F.col("root")))
    both = here.withColumn("version", F.lit("loaded")).unionByName(moved.withColumn("version", F.lit("rerooted")))
    return (subject_table(both, reg, ["version", "subject"]).groupBy("version")
            .agg(F.count("*").alias("n_subjects"), F.count_if("circular").alias("n_circular")))


def descriptors(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_distinct("prov_family").alias("n_descriptors"))
