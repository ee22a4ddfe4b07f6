"""An audited table against the reference corpus.

Reference claims only count where the audited table names the same identifier on the same chain,
so what reference sources say to one another elsewhere cannot move any figure.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, provenance
from ..functions.text import ratio, ratio_or_zero
from ..registry import Registry
from . import claims as claim_ops
from .subjects import OUTCOMES, evidence_pairs, sided_subject_table

KEYS = ["subject", "chain", "address"]
NO_MATCH, SAME, DISTINCT, UNRESOLVED = ("NO_REFERENCE_MATCH", "REFERENCE_MATCH_BUT_SAME_PROVENANCE",
                                        "REFERENCE_MATCH_WITH_DISTINCT_PROVENANCE", "REFERENCE_RELATIONSHIP_UNRESOLVED")


def source_names(reg: Registry) -> list[tuple[str, str]]:
    """(source, name) a text could cite it by; short names match by accident and are left out."""
    least = reg.analysis["residue_min_name_chars"]
    out = []
    for s, r in reg.sources.items():
        out += [(s, n) for n in sorted({s.lower(), r.title.lower(), r.cites.lower()}) if len(n) >= least]
    return out


def named_in_text(target: DataFrame, reg: Registry) -> DataFrame:
    """How many audited claims name each known source in their own declared text.  The names are
    configuration, so each is a literal in one scan rather than a join on containment."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("prov_family", "source_url", "notes") if c in target.columns]
    text = F.lower(F.concat_ws(" ", *fields))
    hits: dict[str, Column] = {}
    for s, name in source_names(reg):
        hits[s] = hits[s] | F.col("_text").contains(name) if s in hits else F.col("_text").contains(name)
    rows = target.select(text.alias("_text"))
    one = rows.agg(*[F.count_if(h).alias(s) for s, h in hits.items()])
    return (one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").alias("n_naming")) for s in hits])).alias("r"))
            .select("r.*").where("n_naming > 0"))


def inheritance_candidates(target: DataFrame, reference: DataFrame, reg: Registry) -> DataFrame:
    """Reference sources the audited table may have been taken from: nearly all of its identifiers
    are there, or its own text names the source.  A signal, never a finding of copying."""
    cut = reg.analysis["decode"]
    mine = target.groupBy("address", "chain").agg(F.count("*").alias("_n")).drop("_n")
    theirs = (reference.select("address", "source").join(mine.select("address").distinct(), "address", "left_semi").distinct()
              .withColumn("source_chain", provenance.source_chain(reg, F.col("source"))))
    met = theirs.join(mine, "address").where(claim_ops.same_chain(F.col("chain"), F.col("source_chain")))
    shared = met.select("source", "address").distinct().groupBy("source").agg(F.count("*").alias("n_shared"))
    # audited identifiers on the chain each source covers: chains are few, so sizes come first
    per_address = mine.groupBy("address").agg(F.collect_set("chain").alias("chains"), F.bool_or(F.col("chain").isNull()).alias("unstated"))
    chains = sorted({r.chain for r in reg.sources.values() if r.chain})
    sizes = per_address.agg(F.count("*").alias("n_any"), *[
        F.count_if(F.col("unstated") | F.array_contains("chains", c)).alias(f"n_{c}") for c in chains])
    size = F.col("n_any")
    for c in chains:
        size = F.when(F.col("source_chain") == c, F.col(f"n_{c}")).otherwise(size)
    rows = (shared.withColumn("source_chain", provenance.source_chain(reg, F.col("source"))).join(F.broadcast(sizes))   # one row
            .withColumn("n_target", size).join(named_in_text(target, reg), "source", "left"))
    share = ratio(F.col("n_shared"), F.col("n_target"))
    contained = share >= F.lit(cut["inherited_above"])
    named = F.coalesce(F.col("n_naming"), F.lit(0))
    return (rows.where(F.col("n_target") >= cut["min_group"]).where(contained | (named > 0))
            .select("source", "n_shared", share.alias("share_in_reference"), contained.alias("by_containment"), named.alias("n_naming")))


def _matched_pairs(target: DataFrame, reference: DataFrame, reg: Registry, flagged: DataFrame | None,
                   measures: dict | None = None) -> DataFrame:
    measures = measures or {}
    names = list(measures)
    mine = evidence_pairs(target.withColumn("is_target", F.lit(True)), reg, KEYS, measures, sided=True)
    subjects = target.select(*KEYS).distinct()
    # only what the audited table names can meet it
    reference = reference.join(target.select("address").distinct(), "address", "left_semi")
    theirs = evidence_pairs(reference.withColumn("is_target", F.lit(False)), reg, ["address"],
                            {n: (how, F.lit(None).cast("bigint")) for n, (how, _) in measures.items()}, sided=True)
    theirs = theirs.withColumn("source_chain", provenance.source_chain(reg, F.col("source")))
    # the reference is reduced to (address, source, root) first: a busy address meets each subject a few times
    met = (theirs.join(subjects, "address").where(claim_ops.same_chain(F.col("chain"), F.col("source_chain"))).drop("source_chain"))
    pairs = mine.unionByName(met.select(*mine.columns))
    if flagged is not None:
        # few sources: each is in the configuration or holds nearly all audited identifiers.  A shuffle by source would put all pairs of one into one task
        pairs = pairs.join(F.broadcast(flagged.select("source", F.lit(True).alias("flagged"))), "source", "left")
        pairs = pairs.withColumn("flagged", F.coalesce("flagged", F.lit(False)) & ~F.col("is_target"))
    return pairs


def audit_subjects(target: DataFrame, reference: DataFrame, reg: Registry, flagged: DataFrame | None = None,
                   measures: dict | None = None) -> DataFrame:
    """One row per audited subject: comparability with the reference, outcome, independence.

    ``flagged`` lists inheritance candidates.  Provenance is DISTINCT only on the strength of a
    resolved root of the audited table's own; two reference roots say nothing about it."""
    df = sided_subject_table(_matched_pairs(target, reference, reg, flagged, measures), reg, KEYS, measures)
    ref, flag = F.col("reference_sources"), F.col("flagged_sources")
    same = ((ref > 0) & (flag == ref)) | (F.col("roots_on_both_sides") > 0)
    distinct = (F.col("target_resolved_roots") > 0) & (F.col("reference_resolved_roots") > 0) & (F.col("confirmed_roots") >= 2)
    status = F.when(ref == 0, NO_MATCH).when(same, SAME).when(distinct, DISTINCT).otherwise(UNRESOLVED)
    df = df.withColumn("comparability", status)
    resolution = (F.when(F.col("comparability").isin(SAME, DISTINCT), "resolved")
                  .when((F.col("comparability") == UNRESOLVED) & (flag > 0), "partially_resolved").otherwise("unresolved"))
    bucket = (F.when(F.col("n_sources") < 2, F.lit(None).cast("string"))
              .when((F.col("confirmed_roots") >= 2) & (F.col("target_resolved_roots") > 0), "confirmed")
              .when(F.col("unresolved_sources") > 0, "unresolved").otherwise("shared_only"))
    return df.withColumns({"resolution": resolution, "independence": bucket,
                           "outcome": F.when(ref > 0, F.col("outcome"))})


def audit_profile(subjects: DataFrame) -> DataFrame:
    """The audit in one row of counts and shares."""
    comp, out, ind, res = F.col("comparability"), F.col("outcome"), F.col("independence"), F.col("resolution")
    name = {"exact": "exact", "hierarchical refinement": "refined", "entity-type conflict": "entity_conflict",
            "licit/illicit conflict": "polarity_conflict", "incomparable": "incomparable"}
    one = subjects.agg(
        F.count("*").alias("n_subjects"), F.count_if(comp != NO_MATCH).alias("comparable"), F.count_if(comp == NO_MATCH).alias("no_match"),
        F.count_if(comp == SAME).alias("same_provenance"), F.count_if(comp == DISTINCT).alias("distinct_provenance"),
        *[F.count_if(out == o).alias(name[o]) for o in OUTCOMES],
        *[F.count_if(res == r).alias(r) for r in ("resolved", "partially_resolved", "unresolved")],
        F.count_if(ind.isNotNull()).alias("apparent_multi_source"), F.count_if(ind == "confirmed").alias("confirmed_independent"),
        F.count_if(ind == "shared_only").alias("shared_or_inherited"), F.count_if(ind == "unresolved").alias("independence_unresolved"))
    return one.withColumns({"comparable_share": ratio_or_zero(F.col("comparable"), F.col("n_subjects")),
                            "no_match_share": ratio_or_zero(F.col("no_match"), F.col("n_subjects"))})


def complement_shares(profile: DataFrame) -> DataFrame:
    """Shares derived from the profile's own counts."""
    n, c = F.col("n_subjects"), F.col("comparable")
    return profile.select(ratio(F.col("resolved"), n).alias("resolved_share"), ratio(F.col("unresolved"), n).alias("unresolved_share"),
                          ratio(F.col("confirmed_independent"), c).alias("confirmed_independent_share"),
                          ratio(F.col("shared_or_inherited"), c).alias("shared_or_inherited_share"),
                          ratio(F.col("independence_unresolved"), c).alias("independence_unresolved_share"))


def target_facts(target: DataFrame, reg: Registry, as_of: Column) -> DataFrame:
    """One row about the audited claims themselves: currency, evidence classes, declared sources."""
    status, tier = evidence.currency_status(reg, F.col("lastmod"), as_of), claim_ops.tier(reg)
    declared = F.trim(F.coalesce("prov_family", F.lit("")))
    tiers = {"verified": "verified", "derived": "derived", "unverified-report": "unverified_report", "unknown": "tier_unknown"}
    return target.agg(
        F.count("*").alias("n_claims"), *[F.count_if(status == s).alias(n) for s, n in (
            (evidence.CURRENT, "current"), (evidence.STALE, "stale"), (evidence.UNDATED, "currency_unknown"))],
        *[F.count_if(tier == t).alias(n) for t, n in tiers.items()],
        F.count_if(F.col("canon") == reg.unknown).alias("n_uninterpretable"), F.count_if(declared != "").alias("n_declared"),
        F.count_distinct(F.when(declared != "", declared)).alias("n_distinct_declared"),
        F.count_if(F.trim(F.coalesce("lastmod", F.lit(""))) == "").alias("n_without_date"))


def limitations(profile: DataFrame, facts: DataFrame) -> DataFrame:
    """What a reader must carry with any figure; each row only when its share is above zero."""
    one = profile.join(F.broadcast(facts))            # one row each
    rows = [("no_reference_match", ratio(F.col("no_match"), F.col("n_subjects"))),
            ("no_revision_date", ratio(F.col("n_without_date"), F.col("n_claims"))),
            ("provenance_unresolved", ratio(F.col("unresolved"), F.col("n_subjects"))),
            ("nothing_comparable", F.when(F.col("comparable") == 0, F.lit(1.0)))]
    return (one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("limitation"), s.alias("share")) for n, s in rows])).alias("r"))
            .select("r.*").where("share > 0"))


def declared_sources(target: DataFrame, limit: int = 20) -> DataFrame:
    value = F.trim(F.coalesce("prov_family", F.lit("")))
    return (target.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n_claims"))
            .orderBy(F.desc("n_claims"), "value").limit(limit))
