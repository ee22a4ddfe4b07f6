"""How old the claims are, and what class of evidence they carry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions.text import ratio, ratio_or_zero
from ..registry import Registry
from . import claims as claim_ops


def freshness(claims: DataFrame, reg: Registry, as_of: Column) -> DataFrame:
    """Current, stale and undated claims per source, and in total (source NULL): the table is read
    once and only the per-source counts are rolled up."""
    status = evidence.currency_status(reg, F.col("lastmod"), as_of)
    per_source = claims.groupBy("source").agg(
        F.count("*").alias("n_claims"), F.count_if(status == evidence.CURRENT).alias("current"),
        F.count_if(status == evidence.STALE).alias("stale"), F.count_if(status == evidence.UNDATED).alias("currency_unknown"))
    n = F.col("n_claims")
    return (per_source.rollup("source").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                              for c in ("n_claims", "current", "stale", "currency_unknown")])
            .withColumns({"current_share": ratio_or_zero(F.col("current"), n), "stale_share": ratio_or_zero(F.col("stale"), n),
                          "currency_unknown_share": ratio_or_zero(F.col("currency_unknown"), n),
                          "stale_share_of_dated": ratio(F.col("stale"), F.col("current") + F.col("stale"))}))


def tier_tally(claims: DataFrame, reg: Registry) -> DataFrame:
    """Claims of each evidence class per source."""
    return claims.groupBy("source", claim_ops.tier(reg).alias("tier")).agg(F.count("*").alias("n_claims"))


def corpus_table(claims: DataFrame) -> DataFrame:
    """Claims, subjects and whether any revision date exists, per source and in total (source NULL).

    Claims are first reduced to (source, subject), so the total's distinct subjects come from the
    same small table and no source is counted in one task."""
    pairs = claims.groupBy("source", "subject").agg(
        F.count("*").alias("n"), F.max((F.trim(F.coalesce("lastmod", F.lit(""))) != "").cast("int")).alias("dated"))
    per_source = pairs.groupBy("source").agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_claims"),
                                             (F.max("dated") == 1).alias("has_revision_date"))
    per_subject = pairs.groupBy("subject").agg(F.sum("n").alias("n"), F.max("dated").alias("dated"))
    total = per_subject.agg(F.lit(None).cast("string").alias("source"), F.count("*").alias("n_subjects"),
                            F.sum("n").alias("n_claims"), (F.max("dated") == 1).alias("has_revision_date"))
    return per_source.unionByName(total)
