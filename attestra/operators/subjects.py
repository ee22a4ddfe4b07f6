"""One row per subject: who speaks about it, what they say, and how independent they are.

All figures come from two shuffles.  Claims are first reduced to one row per (subject, source,
root) with map-side combining, so a subject that holds a large part of the table leaves each
mapper as a handful of rows.  Those rows are then brought together by subject, and everything
else (distinct sources, distinct roots, category sets) is counted inside that partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CategoryCodes
from ..registry import Registry

#: Fixed value: agreement outcomes, in reporting order.
OUTCOMES = ["exact", "hierarchical refinement", "entity-type conflict", "licit/illicit conflict", "incomparable"]
#: Fixed value: short names of the outcomes.
KIND_OF_OUTCOME = {"licit/illicit conflict": "polarity", "entity-type conflict": "entity",
                   "hierarchical refinement": "hierarchical", "incomparable": "incomparable", "exact": "exact"}
#: Fixed value: buckets of a dataset's agreement with itself.
SELF_CONSISTENCY = ["repeated observation", "repeated same label", "compatible multi-label claim",
                    "internal contradiction", "uninterpretable multi-label"]

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def evidence_pairs(claims: DataFrame, reg: Registry, keys: list[str], measures: dict[str, tuple[str, Column]]
                   | None = None, sided: bool = False) -> DataFrame:
    """Claims reduced to (subject, source, root).  ``measures`` are extra (sum|max|min, Column) figures
    to carry; ``sided`` keeps the audited table's claims (``is_target``) apart from the reference's."""
    codes, measures = CategoryCodes(reg), measures or {}
    group = keys + ["source", "root", "root_known"] + (["is_target"] if sided else [])
    rows = codes.with_codes(claims.select(*group, "claim_seq", "canon", *[c.alias(n) for n, (_, c) in measures.items()]))
    return rows.groupBy(*group).agg(
        F.count("*").alias("n_claims"), F.min("claim_seq").alias("first_seq"), *codes.merge(),
        *[_MERGE[how](n).alias(n) for n, (how, _) in measures.items()])


def _gather(pairs: DataFrame, reg: Registry, keys: list[str], measures: dict, sided: bool) -> DataFrame:
    codes = CategoryCodes(reg)
    carried = ["n_claims", "first_seq", *codes.aggregates, *measures]
    target = F.col("is_target") if sided else F.lit(False)
    flagged = F.col("flagged") if "flagged" in pairs.columns else F.lit(False)
    common = [F.col(c).alias(c) for c in carried]
    # the same pair seen as a source and as a root: two rows instead of two more shuffles
    views = [F.struct(F.lit(by).alias("by"), F.col(col).alias("value"),
                      F.col("root_known").cast("int").alias("root_ok"),
                      target.cast("int").alias("on_target"), (~target).cast("int").alias("on_reference"),
                      flagged.cast("int").alias("flagged"), *common)
             for by, col in (("source", "source"), ("root", "root"))]
    # dealt by (keys, value) first and by keys after it, each time combined before it moves: a subject with very many roots is
    # spread over all tasks, and reaches its last task as one row from each of them
    seen = pairs.select(*keys, F.explode(F.array(*views)).alias("v")).select(*keys, "v.*")
    one_each = seen.groupBy(*keys, "by", "value").agg(
        F.count("*").alias("pairs"), F.max("root_ok").alias("some_known"), F.min("root_ok").alias("all_known"),
        F.max("on_target").alias("on_target"), F.max("on_reference").alias("on_reference"),
        F.max("flagged").alias("flagged"), F.sum("n_claims").alias("n_claims"),
        F.min("first_seq").alias("first_seq"), *codes.merge(),
        *[_MERGE[how](n).alias(n) for n, (how, _) in measures.items()])
    is_source, is_root = F.col("by") == "source", F.col("by") == "root"

    def tally(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    def carry(how: str, name: str) -> Column:
        return _MERGE[how](F.when(is_source, F.col(name))).alias(name)

    on_t, on_r, known_root = F.col("on_target") == 1, F.col("on_reference") == 1, is_root & (F.col("some_known") == 1)
    cols = [
        F.sum(F.when(is_source, F.col("n_claims"))).alias("n_claims"), F.min("first_seq").alias("first_seq"),
        tally(is_source).alias("n_sources"), tally(is_source & (F.col("known") == 1)).alias("known_sources"),
        tally(is_source & (F.col("all_known") == 0)).alias("unresolved_sources"),
        tally(is_root).alias("n_roots"), tally(known_root).alias("confirmed_roots"),
        F.sum(F.when(known_root, F.col("pairs")).otherwise(0)).alias("resolved_pairs"),
        *codes.merge(), *[carry(how, n) for n, (how, _) in measures.items()]]
    if sided:
        cols += [F.max(F.when(is_source & on_t, F.col("known"))).alias("target_known"),
                 tally(is_source & on_t).alias("target_sources"), tally(is_source & on_r).alias("reference_sources"),
                 tally(is_source & on_r & (F.col("flagged") == 1)).alias("flagged_sources"),
                 tally(known_root & on_t & on_r).alias("roots_on_both_sides"),
                 tally(known_root & on_t).alias("target_resolved_roots"),
                 tally(known_root & on_r).alias("reference_resolved_roots")]
    return one_each.groupBy(*keys).agg(*cols)


def _conclude(df: DataFrame, reg: Registry, sided: bool, drop: bool = True) -> DataFrame:
    codes = CategoryCodes(reg)
    outcome = F.when(F.col("known_sources") < 2, "incomparable").otherwise(codes.relationship())
    if sided:
        silent = (F.col("target_sources") > 0) & (F.coalesce(F.col("target_known"), F.lit(0)) == 0)
        outcome = F.when(silent, "incomparable").otherwise(outcome)
    shared = F.col("resolved_pairs") - F.col("confirmed_roots")
    confirmed, unresolved = F.col("confirmed_roots"), F.col("unresolved_sources")
    return df.withColumns({
        "outcome": outcome, "shared_roots": shared, "circular": shared > 0,
        "independence_min": F.greatest(confirmed, F.lit(1)), "independence_max": confirmed + unresolved,
        "relationship": F.when(shared > 0, "shared_root").when(unresolved > 0, "unresolved")
        .otherwise("distinct_roots")}).drop("resolved_pairs", *(codes.aggregates if drop else ()))


def subject_table(claims: DataFrame, reg: Registry, keys: list[str] | None = None,
                  measures: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Sources, opinions and independence of every subject, plus the requested measures."""
    keys = keys or ["subject"]
    pairs = evidence_pairs(claims, reg, keys, measures)
    codes = CategoryCodes(reg)
    found = codes.with_exact_counts(_conclude(_gather(pairs, reg, keys, measures or {}, False), reg, False, drop=False), claims, keys)
    return found.drop(*codes.aggregates)


def sided_subject_table(pairs: DataFrame, reg: Registry, keys: list[str],
                        measures: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """The same for pairs of an audited table and of the reference, kept apart by ``is_target``."""
    return _conclude(_gather(pairs, reg, keys, measures or {}, True), reg, True)


def collapsed_claims(claims: DataFrame, reg: Registry) -> DataFrame:
    """Sources that restate a resolved root another source already brought to the subject."""
    pairs = (claims.where("root_known").groupBy("subject", "root", "source")
             .agg(F.min("claim_seq").alias("first_seq")))
    order = Window.partitionBy("subject", "root").orderBy("first_seq", "source")   # at most one row per source
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n > 1").select("subject", "source", "root")


def source_lists(claims: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sorted sources of each subject (as many as there are sources)."""
    keys = keys or ["subject"]
    return (claims.select(*keys, "source").distinct()
            .groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("sources")))


def self_consistency(claims: DataFrame, reg: Registry) -> DataFrame:
    """Does one dataset agree with itself?  One row per subject with more than one claim."""
    codes = CategoryCodes(reg)
    variants = (codes.with_codes(claims.select("subject", "source", "raw_label", "canon",
                                               (F.col("canon") == reg.unknown).cast("int").alias("blank")))
                .groupBy("subject", "source", "raw_label")
                .agg(F.count("*").alias("n"), F.max("blank").alias("blank"), *codes.merge()))
    merged = variants.groupBy("subject").agg(
        F.sum("n").alias("n_claims"), F.count("*").alias("n_variants"), F.max("blank").alias("blank"), *codes.merge())
    identical, n_cats = F.col("n_variants") == 1, codes.n_categories()
    bucket = (F.when(F.col("blank") == 1, F.when(identical & (n_cats == 0), SELF_CONSISTENCY[0])
                     .otherwise(SELF_CONSISTENCY[4]))
              .when(n_cats == 1, F.when(identical, SELF_CONSISTENCY[0]).otherwise(SELF_CONSISTENCY[1]))
              .when(codes.relationship() == "hierarchical refinement", SELF_CONSISTENCY[2])
              .otherwise(SELF_CONSISTENCY[3]))
    outcome = F.when(n_cats > 0, codes.relationship())
    return (codes.with_exact_counts(merged.where("n_claims > 1").withColumns({"bucket": bucket, "outcome": outcome}), claims, ["subject"])
            .select("subject", "n_claims", "n_categories", "bucket", "outcome"))


def count_named(df: DataFrame, column: str, names: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """n and share of each listed value of a column, zeros included: one aggregate, then one row each."""
    one = df.agg(F.count("*").alias("_total"), *[F.count_if(F.col(column) == v).alias(f"_n{i}")
                                                 for i, v in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"_n{i}").alias("n")) for i, v in enumerate(names)])
    return (one.select("_total", F.explode(rows).alias("r"))
            .select(f"r.{column}", "r.n", F.coalesce(F.try_divide(F.col("r.n").cast("double"),
                                                                  F.col("_total").cast("double")),
                                                     F.lit(0.0)).alias("share")))


def conflicting_members(claims: DataFrame, reg: Registry) -> DataFrame:
    """Every claim of a subject whose own dataset contradicts itself about it."""
    bad = (self_consistency(claims, reg).where(F.col("bucket") == SELF_CONSISTENCY[3])
           .select("subject", "outcome"))
    # the conflicting subjects are unique here, so the join never multiplies a claim
    return claims.join(bad, "subject").select("subject", "address", "chain", "outcome", "claim_seq", "canon", "raw_label")


def flags_and_tier(claims: DataFrame, reg: Registry, as_of) -> DataFrame:
    """Best evidence class of each subject and the flags a reader must see."""
    from ..functions import evidence
    from . import claims as claim_ops
    status = evidence.currency_status(reg, F.col("lastmod"), as_of)
    measures = {"n_undated": ("sum", (status == evidence.UNDATED).cast("bigint")),
                "n_stale": ("sum", (status == evidence.STALE).cast("bigint")),
                "best_rank": ("min", evidence.tier_rank(reg, claim_ops.tier(reg)))}
    df = subject_table(claims, reg, measures=measures)
    order = reg.analysis["tier_order"]
    conflict = (F.col("n_sources") >= 2) & F.col("outcome").isin("licit/illicit conflict", "entity-type conflict")
    flags = F.array_compact(F.array(
        F.when(conflict, "conflicting"), F.when(F.col("circular"), "circular"),
        F.when(F.col("n_undated") == F.col("n_claims"), evidence.UNDATED).when(F.col("n_stale") > 0, evidence.STALE)))
    best = F.element_at(F.array(*[F.lit(t) for t in order + [reg.analysis["tier_default"]]]), F.col("best_rank") + 1)
    return df.withColumns({"flags": flags, "tier": best})
