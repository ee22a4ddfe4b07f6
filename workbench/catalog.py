"""Every operator as a query over the driver's tables, each with the inventory ids it covers."""
from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import Registry
from attestra.functions import evidence, identifiers, labels, provenance
from attestra.functions.text import cell
from attestra.operators import (agreement, anchors, claims as claim_ops, currency, explore, inheritance, lineage, metrics, overlap,
                                preflight, profiling, relational, roots, subjects, target, trust, validation, verdict, verification)
from attestra.plans import corpus_audit, upload_audit
from attestra.registry import Family, _source_rule
from attestra.session import sized
from attestra.sinks import writers
from attestra.sources import adapters, readers
from workbench import workload as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COVERS: dict[str, str] = {}

REG = Registry.load()
AUDIT_REG = Registry(REG.categories, REG.separators, {**REG.sources, "order_desk": _source_rule("order_desk", W.ORDER_DESK_RULE)},
                     REG.seeds, REG.analysis, REG.intake, REG.adapters, REG.unknown)
CHOSEN = ["resolved_provenance_only", "non_circular", "current_only", "exclude_conflicts"]
MULTI = dict(status="multi_label", column="categories", separator=",")
JOIN_SPEC = dict(driving_table="orders", joins=[
    dict(table="customer", local_key="o_custkey", foreign_key="c_custkey"),
    dict(table="nation", local_table="customer", local_key="c_nationkey", foreign_key="n_nationkey"),
    dict(table="region", local_table="nation", local_key="n_regionkey", foreign_key="r_regionkey", type="inner")])


def _as_of():
    return F.lit(W.AS_OF).cast("date")


def query(covers: str):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = functools.wraps(fn)(lambda s, d: fn(sized(s), d))
        COVERS[fn.__name__] = covers
        return fn
    return register


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The normalised claim table.  Like any ingest it is written once and then only read."""
    return W.once(spark, d, "corpus", lambda: claim_ops.stamp(W.load(spark, d, W.OBSERVATIONS), REG))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return W.once(spark, d, "documents", lambda: claim_ops.stamp(W.load(spark, d, W.DOCUMENTS), REG))


def audited(spark: SparkSession, d: str) -> DataFrame:
    return W.once(spark, d, "audited", lambda: claim_ops.stamp(W.load(spark, d, W.TARGET), AUDIT_REG))


def revenue(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).where(F.col("source").isin("rodwald_ransom", "ransomwhere")).select(
        "claim_seq", "address", F.col("source").alias("dataset"),
        F.col("value_usd").alias("usd"), F.col("subcat").alias("family"), F.col("code").alias("src_letters"))
    return W.once(spark, d, "revenue", lambda: trust.revenue_claims(rows, REG))


def anchor_list(spark: SparkSession, d: str) -> DataFrame:
    return W.load(spark, d, W.ANCHORS)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return W.load(spark, d, W.GROUND_TRUTH)


def upload(spark: SparkSession, d: str) -> DataFrame:
    return W.once(spark, d, "upload", lambda: W.load(spark, d, W.UPLOAD))


def validated(spark: SparkSession, d: str, *carry: str) -> validation.Validation:
    """The upload with a reason per row and the cells asked for; read from its tables, as a written copy of the rows would be their size again."""
    def build() -> validation.Validation:
        return validation.validate(W.load(spark, d, W.UPLOAD), W.UPLOAD_MAPPING, REG, "ethereum", multi_label=MULTI, carry=carry)
    return W.made(spark, d, ("validated", *carry), build)


def outcomes(spark: SparkSession, d: str) -> validation.Validation:
    """Reasons and counts only, without a cell."""
    v = validated(spark, d)
    return validation.Validation(v.rows, W.once(spark, d, "judged", lambda: v.judged))


def uploaded_claims(spark: SparkSession, d: str) -> DataFrame:
    return claim_ops.build_claims(validated(spark, d, *W.UPLOAD_COLUMNS).valid, W.UPLOAD_MAPPING, "upload_desk", REG)


def rounded(df: DataFrame, *cols: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# ------------------------------------------------------------------ claims
@query("PRJ1 PRJ4 PRJ10 PRJ11 PRJ12 PRJ13 PRJ14 PRJ15 PRJ16 SRC14")
def claims_normalised(s, d):
    c = corpus(s, d)
    return c.select("claim_seq", "subject", "raw_address", "source", "canon", "root", "prov_resolved", "prov_native", "prov_verified", "prov_kind",
                    "root_known", claim_ops.tier(REG).alias("tier"),
                    provenance.provenance_status(F.col("prov_resolved"), F.col("prov_native")).alias("provenance"),
                    evidence.currency_status(REG, F.col("lastmod"), _as_of()).alias("currency"), evidence.normal_date(F.col("lastmod")).alias("day"))


@query("PRJ6 PRJ7")
def label_categories(s, d):
    c = corpus(s, d)
    return c.groupBy("raw_label", labels.canonical_category(REG, F.col("raw_label")).alias("category"),
                     labels.structured_entity(REG, F.col("raw_label")).alias("entity")).agg(F.count("*").alias("n_claims"))


@query("PRJ18 SRC14")
def rederived_unknown(s, d):
    return claim_ops.rederived_counts(corpus(s, d), REG)


@query("PRJ2 PRJ3 PRJ5")
def chain_names(s, d):
    u = upload(s, d)
    chain = identifiers.resolve_chain(REG, F.col("network"))
    return u.groupBy("network", chain.alias("chain")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(identifiers.canonical_identifier(REG, chain, cell(F.col("wallet_address"))) != F.col("wallet_address")).alias("n_respelled"),
        F.count_if(identifiers.adapter_address(F.col("wallet_address")) != F.col("wallet_address")).alias("n_trimmed"))


# ------------------------------------------------------------------ subjects
@query("AGG3 AGG4 AGG10 AGG12")
def subject_profile(s, d):
    return subjects.subject_table(corpus(s, d), REG).select(
        "subject", "n_claims", "n_sources", "known_sources", "unresolved_sources", "n_roots", "confirmed_roots", "shared_roots", "circular",
        "independence_min", "independence_max", "relationship", "n_categories", "outcome")


@query("AGG6")
def agreement_outcomes(s, d):
    return agreement.outcomes(subjects.subject_table(corpus(s, d), REG))


@query("AGG1 FLT14")
def corroboration(s, d):
    return agreement.coverage(subjects.subject_table(corpus(s, d), REG))


@query("AGG1")
def source_depth(s, d):
    return overlap.depth_buckets(overlap.source_set_counts(corpus(s, d)))


@query("AGG2 AGG30 SRC18")
def corpus_table(s, d):
    return currency.corpus_table(corpus(s, d))


@query("AGG17 JOIN6 SET1")
def overlap_matrix(s, d):
    return overlap.overlap_matrix(overlap.source_set_counts(corpus(s, d)))


@query("AGG17 SET2")
def source_coverage(s, d):
    return overlap.source_coverage(overlap.source_set_counts(corpus(s, d)))


@query("AGG16 TOP1")
def containment_top(s, d):
    return overlap.top_containment(overlap.source_set_counts(corpus(s, d)), REG)


@query("STA1 WIN2 JOIN6")
def kappa_pairs(s, d):
    k = agreement.kappa(corpus(s, d), REG)
    return rounded(k, "cohen_kappa", "cohen_kappa_interpretable")


@query("STA1")
def kappa_summary(s, d):
    return agreement.kappa_summary(agreement.kappa(corpus(s, d), REG))


@query("AGG7 WIN4 TOP2")
def polarity_conflicts_top(s, d):
    return agreement.top_polarity_conflicts(corpus(s, d), REG)


@query("WIN2")
def modal_labels(s, d):
    return agreement.modal_labels(corpus(s, d))


@query("WIN1 AGG14")
def dominant_roots(s, d):
    return roots.dominant_root(corpus(s, d))


@query("AGG13")
def root_totals(s, d):
    return roots.root_totals(corpus(s, d))


@query("AGG13 TOP3")
def root_concentration(s, d):
    return roots.root_concentration(corpus(s, d), REG)


@query("AGG14 WIN1")
def unresolved_subjects(s, d):
    return roots.unresolved_subjects(corpus(s, d))


@query("AGG15")
def roots_per_subject(s, d):
    return roots.roots_per_subject(subjects.subject_table(corpus(s, d), REG))


@query("AGG29")
def within_source_roots(s, d):
    return roots.within_source_roots(corpus(s, d))


@query("AGG33")
def circular_subjects(s, d):
    return roots.circular_subjects(subjects.subject_table(corpus(s, d), REG))


@query("AGG31")
def provenance_descriptors(s, d):
    return roots.descriptors(corpus(s, d))


@query("AGG11 WIN5")
def collapsed_claims(s, d):
    return subjects.collapsed_claims(corpus(s, d), REG)


@query("AUD15 AGG10")
def reroot_what_if(s, d):
    moved = (F.col("source") == "watchyourback") & (F.col("root") == "ofac_sdn")
    return roots.reroot(corpus(s, d), moved, "watchyourback_manual", REG)


# ------------------------------------------------------------------ inheritance
DECODE = dict(dataset="rodwald_ransom", field="prov_family", candidate="ransomwhere")


@query("AGG18")
def decode_groups(s, d):
    return inheritance.decodes(corpus(s, d), REG)


@query("AGG18")
def decode_examples(s, d):
    e = inheritance.decode_examples(corpus(s, d), **DECODE)
    return e.select("code", F.array_join("examples", " ").alias("examples"))


@query("AGG18")
def decode_summary(s, d):
    return inheritance.decode_summary(inheritance.decode_groups(corpus(s, d), REG, **DECODE), REG)


@query("AGG20")
def decoded_letters(s, d):
    return inheritance.decoded_letters(inheritance.decode_groups(corpus(s, d), REG, **DECODE))


@query("AGG20")
def decode_totals(s, d):
    return inheritance.decode_totals(inheritance.decode_groups(corpus(s, d), REG, **DECODE), REG)


@query("TOP7")
def decode_largest(s, d):
    return inheritance.largest_groups(inheritance.decode_groups(corpus(s, d), REG, **DECODE), REG)


@query("AGG21")
def naming_residue(s, d):
    return inheritance.naming_residue(corpus(s, d), REG)


@query("AGG21")
def naming_residue_summary(s, d):
    return inheritance.residue_summary(inheritance.naming_residue(corpus(s, d), REG))


@query("AGG22")
def root_propagation(s, d):
    return inheritance.root_propagation(corpus(s, d), REG)


@query("PRJ19 JOIN10")
def lineage_edges(s, d):
    c = corpus(s, d)
    sets = overlap.source_set_counts(c)
    e = lineage.annotated(lineage.edges(s, REG), inheritance.decodes(c, REG), inheritance.naming_residue(c, REG), overlap.containment(sets),
                          inheritance.root_propagation(c, REG))
    return e.select("dataset", "root", "kind", "owner", "shared_root", "decoded_subjects", "residue_claims", "contained_share", "propagated_subjects")


@query("PRJ19")
def lineage_nodes(s, d):
    """Datasets and roots of the lineage with what the corpus holds under each."""
    return lineage.measured_nodes(lineage.nodes(lineage.edges(s, REG)), corpus(s, d))


# ------------------------------------------------------------------ currency, tiers, overview
@query("AGG23 PRJ13")
def freshness(s, d):
    return currency.freshness(corpus(s, d), REG, _as_of())


@query("AGG24 PRJ12")
def tier_tally(s, d):
    return currency.tier_tally(corpus(s, d), REG)


@query("AGG28")
def subject_flags(s, d):
    f = subjects.flags_and_tier(corpus(s, d), REG, _as_of())
    return f.select("subject", F.array_join("flags", ",").alias("flags"), "tier")


@query("SRC18")
def snapshot_day(s, d):
    return claim_ops.snapshot_date(W.load(s, d, W.OBSERVATIONS)).select(F.col("as_of").cast("string").alias("as_of"))


@query("AGG35")
def overview(s, d):
    return metrics.overview(corpus(s, d), REG, _as_of())


@query("AUD12")
def metric_table(s, d):
    m = metrics.paper_metrics(corpus(s, d), REG, _as_of(), trust.drift(revenue(s, d), REG, anchor_list(s, d)))
    return rounded(m, "value", places=2)


def declared_values(s, d):
    """Declared values derived from the data itself, one per comparison rule, right and wrong."""
    one = corpus(s, d).agg(F.count("*").alias("n"), F.count_distinct("source").alias("k"))
    rows = F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(m).alias("metric"), F.lit(c).alias("class"), F.lit(r).alias("comparison"), e.cast("string").alias("expected"),
                   lo.cast("string").alias("min"), hi.cast("string").alias("max"), F.lit(p).cast("int").alias("decimals"), F.lit(sc).cast("double").alias("scale"),
                   F.lit(x).alias("experiment"), F.lit(ok).alias("machine_checkable"))
          for i, m, c, r, e, lo, hi, p, sc, x, ok in [
              ("claims", "corpus.total.n_claims", "HEADLINE_STABLE", "exact_integer", F.col("n"), F.lit(None), F.lit(None), 0, 1.0, "corpus", True),
              ("claims_off", "corpus.total.n_claims", "DIAGNOSTIC", "exact_integer", F.col("n") + 1, F.lit(None), F.lit(None), 0, 1.0, "corpus", True),
              ("claims_k", "corpus.total.n_claims", "SUPPORTING_STABLE", "rounded_decimal", F.round(F.col("n") / 1000, 1), F.lit(None), F.lit(None), 1, 0.001, "corpus", True),
              ("bounds", "coverage.depth.1.share", "SUPPORTING_STABLE", "range", F.lit(None), F.lit(0), F.lit(1), 0, 1.0, "coverage", True),
              ("no_value", "coverage.depth.2.share", "SUPPORTING_STABLE", "range", F.lit(None), F.lit(None), F.lit(None), 0, 1.0, "coverage", True),
              ("missing", "coverage.nothing", "SENSITIVITY", "exact_integer", F.lit(1), F.lit(None), F.lit(None), 0, 1.0, "coverage", True),
              ("missing_loud", "coverage.nothing_else", "LIMITATION", "exact_integer", F.lit(1), F.lit(None), F.lit(None), 0, 1.0, "other", True),
              ("prose", "coverage.prose", "LIMITATION", "exact_string", F.lit("x"), F.lit(None), F.lit(None), 0, 1.0, "prose", False)]])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _verified(s, d):
    c = corpus(s, d)
    sets = overlap.source_set_counts(c)
    table = currency.corpus_table(c).withColumn("who", F.coalesce("source", F.lit("total")))
    m = metrics.keyed(table, "corpus", ["who"], ["n_claims"]).unionByName(
        metrics.keyed(overlap.depth_buckets(sets), "coverage.depth", ["depth"], ["share"]))
    return verification.verify(m, declared_values(s, d))


@query("AUD11 JOIN13")
def metric_verification(s, d):
    return _verified(s, d).select("id", "class", "comparison", "basis", "status")


@query("AUD11")
def verification_status(s, d):
    v = _verified(s, d)
    return verification.experiment_status(v).select("experiment", "n_claims", "status").unionByName(
        verification.overall(v).select(F.lit("(overall)").alias("experiment"), F.lit(8).cast("bigint").alias("n_claims"), "status"))


@query("AUD7")
def reliability_profile(s, d):
    c = corpus(s, d)
    return verdict.reliability_profile(None, subjects.subject_table(c, REG), roots.root_totals(c), currency.freshness(c, REG, _as_of()))


# ------------------------------------------------------------------ trust
@query("AGG25 AGG26 FLT5 FLT6 JOIN8 UDF1 UDF2 WIN6")
def drift(s, d):
    return rounded(trust.drift(revenue(s, d), REG, anchor_list(s, d)), "value", places=2).withColumns(
        {c: F.round(c, 6) for c in ("ratio_vs_baseline", "coverage_vs_baseline")})


@query("AGG26")
def drift_summary(s, d):
    x = trust.drift_summary(trust.drift(revenue(s, d), REG, anchor_list(s, d)))
    return rounded(x, "naive_inflation", "addresses_removed", "value_removed", "spread_b_over_d", "spread_a_over_d", places=6)


def _kept(s, d):
    return trust.retained(revenue(s, d), REG, "verified_only", anchor_list(s, d))


@query("AGG27 JOIN9 SET4")
def eligibility_trace(s, d):
    return trust.eligibility_trace(_kept(s, d), corpus(s, d), REG)


@query("AGG27 TOP4")
def retained_roots(s, d):
    return trust.roots_at(_kept(s, d), corpus(s, d))


@query("AGG27 TOP4")
def retained_native_values(s, d):
    return trust.native_values_at(_kept(s, d), corpus(s, d), "tagpack", "subcat")


@query("AGG27 TOP4")
def retained_top_values(s, d):
    return trust.top_by_value(_kept(s, d), revenue(s, d))


@query("AUD8 FLT7 FLT8 FLT9 FLT10 FLT11 FLT12")
def trust_coverage(s, d):
    ctx, rules = trust.Context(REG, _as_of()), REG.analysis["coverage_rules"]
    table = subjects.subject_table(corpus(s, d), REG, measures=trust.coverage_measures(ctx, rules, CHOSEN))
    return trust.trust_coverage(table, ctx, rules, CHOSEN)


@query("AUD8 FLT13")
def trust_coverage_audited(s, d):
    """The audited table's own claims, with matched reference claims as context; nothing dates them."""
    ctx, rules = trust.Context(AUDIT_REG, _as_of()), REG.analysis["coverage_rules"]
    mine, ref = audited(s, d), corpus(s, d)
    table = target.audit_subjects(mine, ref, AUDIT_REG, None, trust.coverage_measures(ctx, rules, CHOSEN))
    # an outcome only exists where the reference speaks
    return trust.trust_coverage(table, ctx, rules, CHOSEN, {"staleness": verdict.NOT_APPLICABLE})


# ------------------------------------------------------------------ anchors and intervals
@query("STA5 JOIN7 WIN3")
def anchor_decisions(s, d):
    return anchors.decisions(corpus(s, d), truth(s, d), REG).select("address", "source", "label", "root", "outcome")


@query("STA5 STA2")
def anchor_validation(s, d):
    return rounded(anchors.validation(corpus(s, d), truth(s, d), REG), "wilson_low", "wilson_high")


@query("STA5")
def anchor_summary(s, d):
    return anchors.anchor_summary(corpus(s, d), truth(s, d), REG)


@query("STA5")
def anchor_root_histogram(s, d):
    return anchors.independent_root_histogram(corpus(s, d), truth(s, d))


@query("STA4 STA6")
def anchor_intervals(s, d):
    return anchors.anchor_intervals(corpus(s, d), truth(s, d), REG)


@query("STA3 STA6")
def bootstrap_pooled(s, d):
    return anchors.bootstrap(corpus(s, d), REG)


@query("STA3 STA6")
def bootstrap_separate(s, d):
    return anchors.bootstrap(corpus(s, d), REG, upper=True)


@query("STA3")
def bootstrap_points(s, d):
    """The part of both bounds that does not depend on draws: clusters and point estimates."""
    c = corpus(s, d)
    out = None
    for bound, upper in (("pooled", False), ("separate", True)):
        k = anchors.cluster_counts(c, REG, upper)
        one = k.agg(F.count("*").alias("n_clusters"), F.sum("subjects").alias("subjects"), F.sum("multi").alias("multi"), F.sum("exact").alias("exact"),
                    F.sum("refined").alias("refined"), F.sum("opposed").alias("opposed")).withColumn("bound", F.lit(bound))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ exploring
@query("AUD10 AGG12")
def subject_index(s, d):
    return explore.subject_index(corpus(s, d), REG).withColumn("sources", F.array_join("sources", ",")).drop("chain")


@query("AUD10")
def kind_counts(s, d):
    return explore.kind_counts(explore.subject_index(corpus(s, d), REG))


@query("TOP5 PRJ15")
def claims_page(s, d):
    return explore.claims_page(corpus(s, d), REG, offset=120, limit=60)


@query("TOP5")
def claims_page_after(s, d):
    return explore.claims_page(corpus(s, d), REG, limit=40, after=dict(address="500", chain="", source="schnoering", claim_seq=0))


def _claims_pages(s, d):
    key = (s.sparkContext.applicationId, d, "claims")
    if key not in _PAGES:
        _PAGES[key] = explore.claims_pages(corpus(s, d), REG, rows_per_part=20_000)
    return _PAGES[key]


def _conflict_pages(s, d):
    key = (s.sparkContext.applicationId, d, "conflicts")
    if key not in _PAGES:
        ix = W.once(s, d, "subject_index", lambda: explore.subject_index(corpus(s, d), REG))
        _PAGES[key] = explore.pages(explore.filter_conflicts(ix), ["subject"], rows_per_part=1_000)
    return _PAGES[key]


_PAGES: dict[tuple, explore.Pages] = {}


@query("TOP5")
def claims_page_late(s, d):
    p = _claims_pages(s, d)
    return p.page(max(p.total - 100, 0), 60)


@query("TOP6")
def conflicts_page_late(s, d):
    p = _conflict_pages(s, d)
    return p.page(max(p.total - 40, 0), 100).select("subject", "outcome", "kind", "relationship", "circular", F.array_join("sources", ",").alias("sources"))


@query("TOP6 FLT4")
def conflicts_page(s, d):
    ix = W.once(s, d, "subject_index", lambda: explore.subject_index(corpus(s, d), REG))
    p = explore.conflicts_page(ix, REG, offset=10, limit=500, kind="entity", source_a="tagpack", source_b="rodwald_ransom", relationship="unresolved", text="1")
    return p.select("subject", "outcome", "circular", F.array_join("sources", ",").alias("sources"))


@query("FLT1 FLT3")
def filtered_claims(s, d):
    f = claim_ops.filter_claims(corpus(s, d), REG, source="tagpack", evidence_tier="derived", currency="stale", provenance_is="resolved", text="RANSOM", as_of=_as_of())
    return f.select("claim_seq", "subject", "raw_label", "root")


@query("FLT2 TOP5")
def filtered_subject_totals(s, d):
    c = corpus(s, d)
    ix = explore.subject_index(c, REG)
    out = None
    for name, kw in (("single-source", dict(outcome="single-source")), ("exact", dict(outcome="exact")), ("comparable", dict(comparable="yes")),
                     ("not comparable", dict(comparable="no"))):
        part = explore.page_totals(explore.filter_by_subject(c, ix, **kw)).withColumn("filter", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SNK4 SNK5")
def conflict_export(s, d):
    c = corpus(s, d)
    return writers.safe_cells(explore.conflict_export(c, explore.subject_index(c, REG), REG))


@query("AUD9")
def explain_subject(s, d):
    laid_out = W.once(s, d, "by_address", lambda: explore.by_address(corpus(s, d)))
    e = explore.explain(laid_out, REG, "7", _as_of())
    return e.select("address", "found", "n_claims", F.array_join("datasets", ",").alias("datasets"), F.array_join("roots", ",").alias("roots"),
                    "apparent_corroboration", "actual_corroboration", "circular", "outcome", "tier", F.array_join("flags", ",").alias("flags"))


def _on_two_chains(s, d):
    """The audited table, with the second claim of an order stated on a chain of its own."""
    return audited(s, d).withColumn("chain", F.when(F.col("claim_seq") % 8 == 1, "polygon").otherwise(F.col("chain")))


@query("AUD9")
def ambiguous_identifiers(s, d):
    return explore.ambiguous_identifiers(_on_two_chains(s, d)).withColumn("chains", F.array_join("chains", ","))


@query("AUD9")
def explain_ambiguous(s, d):
    claims = _on_two_chains(s, d)
    least = explore.ambiguous_identifiers(claims).agg(F.min("address")).first()[0] or ""
    answers = [explore.explain(claims, AUDIT_REG, least, _as_of(), chain).withColumn("asked", F.lit(chain or "any")) for chain in (None, "polygon", "dogecoin")]
    return (answers[0].unionByName(answers[1]).unionByName(answers[2])
            .select("asked", "address", "ambiguous", "found", F.array_join("chains", ",").alias("chains"), F.coalesce("n_claims", F.lit(0)).alias("n_claims")))


# ------------------------------------------------------------------ documents as claims
@query("AGG17 AGG16")
def document_overlap(s, d):
    return overlap.overlap_matrix(overlap.source_set_counts(documents(s, d)))


@query("AGG4 AGG10")
def document_subjects(s, d):
    return subjects.subject_table(documents(s, d), REG).select("subject", "n_claims", "n_sources", "known_sources", "unresolved_sources",
                                                              "n_categories", "circular", "independence_min", "independence_max", "outcome")


# ------------------------------------------------------------------ one dataset against itself
@query("AGG8")
def self_consistency(s, d):
    return subjects.self_consistency(audited(s, d), AUDIT_REG)


@query("AGG8")
def self_consistency_counts(s, d):
    return subjects.count_named(subjects.self_consistency(audited(s, d), AUDIT_REG), "bucket", subjects.SELF_CONSISTENCY)


@query("AGG9")
def conflicting_members(s, d):
    return subjects.conflicting_members(audited(s, d), AUDIT_REG)


# ------------------------------------------------------------------ an audited table against the corpus
def _candidates(s, d):
    return target.inheritance_candidates(audited(s, d), corpus(s, d), AUDIT_REG)


def _audit(s, d):
    return target.audit_subjects(audited(s, d), corpus(s, d), AUDIT_REG, _candidates(s, d))


@query("AUD1 JOIN12")
def inheritance_candidates(s, d):
    return _candidates(s, d)


@query("AUD2 JOIN4 JOIN5 FLT13 AGG5")
def audit_subjects(s, d):
    return _audit(s, d).select("subject", "n_sources", "confirmed_roots", "comparability", "resolution", "outcome", "independence", "circular")


@query("AUD3")
def audit_profile(s, d):
    return target.audit_profile(_audit(s, d))


@query("AUD14")
def complement_shares(s, d):
    return target.complement_shares(target.audit_profile(_audit(s, d)))


@query("AUD3 AGG24")
def target_facts(s, d):
    return target.target_facts(audited(s, d), AUDIT_REG, _as_of())


@query("AUD3")
def audit_limitations(s, d):
    return target.limitations(target.audit_profile(_audit(s, d)), target.target_facts(audited(s, d), AUDIT_REG, _as_of()))


@query("AUD5")
def analysis_states(s, d):
    return verdict.analysis_states(target.audit_profile(_audit(s, d)), target.target_facts(audited(s, d), AUDIT_REG, _as_of()), AUDIT_REG)


@query("AUD6")
def verdict_findings(s, d):
    return upload_audit.findings_of(audited(s, d), corpus(s, d), AUDIT_REG, _as_of()).drop("enough")


@query("AUD6")
def verdict_overall(s, d):
    return verdict.verdict(upload_audit.findings_of(audited(s, d), corpus(s, d), AUDIT_REG, _as_of()))


@query("AGG34")
def declared_sources_top(s, d):
    return target.declared_sources(audited(s, d))


@query("JOIN11")
def citations(s, d):
    return relational.citations(audited(s, d), AUDIT_REG)


@query("AGG32")
def provenance_states(s, d):
    return relational.provenance_states(audited(s, d), AUDIT_REG)


# ------------------------------------------------------------------ raw uploads
@query("VAL1 VAL2 VAL3")
def validation_outcomes(s, d):
    return outcomes(s, d).reasons()


@query("VAL1 VAL2 VAL3")
def rejected_rows(s, d):
    return validated(s, d, W.UPLOAD_MAPPING["address"]).rejected


@query("VAL4 VAL6")
def validation_counts(s, d):
    return outcomes(s, d).counts()


@query("VAL4")
def validation_per_chain(s, d):
    return outcomes(s, d).per_chain()


@query("VAL4")
def checksum_states(s, d):
    return outcomes(s, d).checksum_states(REG)


@query("VAL5 PRF2")
def identifier_checks(s, d):
    """Every line item's own identifier, spelled with its checksum and in part broken, checked again and decoded."""
    hex40, kind = F.col("hex40"), F.col("kind")
    rows = W.load(s, d, W.IDENTIFIERS)
    body = F.unhex(hex40)
    right = identifiers.mixed_case(F.when(kind < 2, hex40))
    last = lambda v, a, b: F.concat(v.substr(F.lit(1), F.length(v) - 1), F.when(v.endswith(a), b).otherwise(a))
    legacy = identifiers.base58check(F.when(kind.isin(3, 4, 7), F.concat(F.unhex(F.when(kind == 4, "05").otherwise("00")), body)))
    witness = identifiers.segwit(F.when(kind.isin(5, 6), kind - 5).cast("int"), F.when(kind == 5, body).when(kind == 6, F.concat(body, F.substring(body, 1, 12))))
    made = rows.withColumns({"right": right, "legacy": legacy, "witness": witness})
    made = made.withColumn("value", F.when(kind == 0, F.concat(F.lit("0x"), "right")).when(kind == 1, F.concat(F.lit("0x"), F.translate("right", "abcdefABCDEF", "ABCDEFabcdef")))
                           .when(kind == 2, F.concat(F.lit("0x"), hex40)).when(kind.isin(3, 7), F.col("legacy")).when(kind == 4, last(F.col("legacy"), "2", "3"))
                           .when(kind == 5, F.col("witness")).otherwise(last(F.col("witness"), "q", "p")))
    chain = F.element_at(F.array(*(F.lit(c) for c, _, _ in W.IDENTIFIER_KINDS)), (kind + 1).cast("int"))
    payload = F.substring(identifiers.base58_payload(F.when(kind.isin(3, 7), F.col("value"))), 2, 20)
    judged = made.select("kind", chain.alias("chain"), "value", "hex40", "l_quantity", identifiers.address_valid(REG, chain, F.col("value")).alias("valid"),
                         identifiers.checksum_state(F.col("value")).alias("state"), (payload == body).alias("decoded"))
    return (judged.groupBy("kind", "chain", "valid", "state")
            .agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_if("decoded").alias("n_decoded"), F.sum("l_quantity").alias("quantity")))


def ledger_family() -> Family:
    """Records of a ledger: fifteen characters that are 1 modulo 97 behind their letters; case does not matter."""
    fits = lambda v: F.upper(v).rlike(r"\AORD[0-9]{12}\z") & (F.substring(v, 4, 12).try_cast("bigint") % 97 == 1)
    return Family(fits, lambda v: F.lit(False), F.upper)


@query("UDF3 VAL4 PRF2 PRJ4")
def registered_family(s, d):
    """A family that the library does not know, registered and then validated, profiled and spelled like any other."""
    reg = REG.with_family("order_ledger", ledger_family(), {"orders": ["ledger", "order ledger"]})
    rows = W.load(s, d, W.LEDGER)
    v = validation.validate(rows, {**{r: None for r in W.UPLOAD_MAPPING}, "address": "account", "chain": "network", "label": "label"}, reg, None)
    named = v.judged.where("reason IS NULL").agg(F.count_distinct(identifiers.canonical_identifier(reg, F.col("row_chain"), F.col("account"))).alias("n_subjects"),
                                                 F.count_if(identifiers.canonical_identifier(reg, F.col("row_chain"), F.col("account")) != F.col("account")).alias("n_respelled"))
    share = profiling.column_profiles(profiling.column_cells(rows.select("row_id", "account")), reg).select(F.round("address_order_ledger", 6).alias("share"))
    found = preflight.survey({"ledger": rows}, reg).tables.select("subject", "chain_status", "dataset_type", F.col("chain").alias("found_chain"))
    return v.per_chain().join(named).join(share).join(found)                # one row each


@query("VAL4")
def validation_limitations(s, d):
    return outcomes(s, d).limitations(REG)


@query("VAL6")
def validation_floor(s, d):
    return validation.passes_floor(outcomes(s, d).counts(), REG)


@query("PRJ8 PRJ9 UDF5")
def uploaded_claim_rows(s, d):
    return uploaded_claims(s, d).select("record_id", "subject", "chain", "address", "raw_address", "raw_label", "subcat", "label_cell", "canon", "polarity",
                                        "prov_family", "lastmod", "root", "prov_kind")


@query("SNK3 SNK5")
def claims_export(s, d):
    return writers.claims_export(uploaded_claims(s, d)).drop("claim_id")


@query("PRF1 SRC17")
def column_profiles(s, d):
    return profiling.column_profiles(profiling.column_cells(upload(s, d)), REG).withColumn("chains", F.array_join("chains", ","))


@query("PRF3 PRF5 PRF10 PRF15 UDF4")
def preflight_columns(s, d):
    """What each column of two uploads is taken for, where columns compete for one part, and what that makes of the tables."""
    found = preflight.survey({"claims": upload(s, d), "rivals": W.load(s, d, W.RIVALS)}, REG)
    kind = found.tables.select("table", "dataset_type", F.col("status").alias("table_status"), "chain", "chain_status", F.array_join("blockers", ",").alias("blockers"), "currency_basis")
    return found.parts.select("table", "column", "meaning", "confidence", "status", "origin", "rejected_as_subject").join(kind, "table")


def uploads(s, d):
    return {t: upload(s, d) if t == "claims" else W.load(s, d, statement) for t, (statement, _) in W.UPLOADS.items()}


@query("PRF14")
def preflight_choices(s, d):
    """A user's choices against the whole columns: one that holds, one that the values refuse, and two of things that are not there."""
    return preflight.survey({"holders": uploads(s, d)["holders"]}, REG, W.UPLOAD_CHOICES).choices


@query("PRF4 SRC17")
def chain_pair_sample(s, d):
    return profiling.chain_pairs(upload(s, d), "network", "wallet_address", REG)


@query("SRC17")
def column_sample(s, d):
    """Two hundred cells of every column of the upload, drawn in one aggregation."""
    return readers.sampled_columns(upload(s, d), 200, 3)


@query("SRC17")
def paired_sample(s, d):
    """Two hundred rows that state both an identifier and its chain."""
    return readers.sampled_pairs(upload(s, d), "wallet_address", "network", 200, 5)


@query("PRF6")
def multi_label_column(s, d):
    return profiling.multi_label(upload(s, d), "categories", REG)


@query("PRF7")
def source_class(s, d):
    return profiling.is_source_class(upload(s, d), "origin", REG)


@query("SRC16")
def spread_sample(s, d):
    return readers.sample_rows(upload(s, d), 200)


@query("SNK2")
def build_manifest(s, d):
    return writers.manifest(W.load(s, d, W.OBSERVATIONS)).select("source", "claims", "addresses", "dropped")


@query("SNK7 SNK6")
def relationships_object(s, d):
    c = corpus(s, d)
    sets = overlap.source_set_counts(c)
    return writers.as_one_object({"decodes": inheritance.decodes(c, REG), "containment": overlap.top_containment(sets, REG),
                                  "residue": inheritance.naming_residue(c, REG), "propagation": inheritance.root_propagation(c, REG),
                                  "inheritance": _candidates(s, d)})


# ------------------------------------------------------------------ files in, files out
def _files(s, d):
    h = dict(header=True)
    return dict(classes=W.as_file(s, d, "classes", W.CLASS_FILE, **h), curated=W.as_file(s, d, "curated", W.CURATED_FILE, **h),
                family=W.as_file(s, d, "family", W.FAMILY_FILE, header=True, sep=";"), reports=W.as_file(s, d, "reports", W.REPORT_FILE, "json"),
                notes=W.as_file(s, d, "notes", W.NOTES_FILE))


@query("SRC2 SRC6 SRC7 SRC8 SRC9 SRC11 SRC14")
def adapters_build(s, d):
    f = _files(s, d)
    rows, dropped, warnings = adapters.build([
        adapters.coded_classes(s, f["classes"], REG), adapters.curated_categories(s, f["curated"], REG), adapters.family_list(s, f["family"], "rodwald_ransom", "ransomware", ";"),
        adapters.crowd_reports(s, f["reports"], multi_line=False), adapters.annotation_list(s, f["notes"], REG)], REG, fill_unknown=True)
    made = rows.groupBy("source", "canon", "polarity", "heuristic").agg(F.count("*").alias("n_rows"), F.count_distinct("address").alias("n_addresses"),
                                                                      F.min("prov_family").alias("first_family"), F.max("lastmod").alias("last_day"))
    none = F.lit("")
    rest = dropped.select("source", F.lit("(dropped)").alias("canon"), none.alias("polarity"), none.alias("heuristic"), F.col("n_dropped").alias("n_rows")).unionByName(
        warnings.select("source", F.col("warning").alias("canon"), none.alias("polarity"), none.alias("heuristic"), "n_rows"))
    return made.unionByName(rest, allowMissingColumns=True)


@query("SRC10 UDF5")
def tag_pack_observations(s, d):
    """Tag packs written and read again: inherited fields, one currency, categories by word and by label, and packs that cannot be read."""
    root = W.as_written(s, d, "packs", lambda path: W.load(s, d, W.PACKS).write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/packs"))
    found = adapters.tag_packs(s, root, REG, pattern="*.txt")
    rows = found.rows.groupBy("canon", "prov_family", "lastmod", "subcat", "raw_label").agg(F.count("*").alias("n_rows"), F.count_distinct("address").alias("n_addresses"))
    bad = found.warnings.groupBy(F.lit("(warning)").alias("canon"), F.col("warning").alias("prov_family")).agg(F.sum("n_rows").alias("n_rows"))
    return rows.unionByName(bad, allowMissingColumns=True)


@query("SRC12 SRC13 SET3")
def values_and_anchors(s, d):
    f = _files(s, d)
    values = adapters.revenue_rows(s, f["family"], f["reports"], multi_line=False)
    named = adapters.anchor_addresses(s, f["notes"])
    return (values.join(named.withColumn("anchored", F.lit(True)), "address", "left")
            .groupBy("dataset", F.coalesce("anchored", F.lit(False)).alias("anchored")).agg(F.count("*").alias("n_rows"), F.sum("usd").alias("usd")))


@query("SRC1 SNK1 SRC18")
def observation_files(s, d):
    """The observation table written in order as compressed text, read back as the reference corpus and stamped."""
    path = W.as_written(s, d, "observations", lambda p: writers.write_observations(W.load(s, d, W.OBSERVATIONS), p, fmt="csv"))
    rows, _ = readers.reference_observations(s, full_build=path, as_of=W.AS_OF)
    return claim_ops.stamp(rows, REG).groupBy("source", "root").agg(
        F.count("*").alias("n_claims"), F.count_distinct("subject").alias("n_subjects"), F.count_if(F.col("raw_address") != F.col("address")).alias("n_marked"))


@query("SRC3 SRC4 SRC5 SRC15 SNK1 SNK6")
def file_round_trips(s, d):
    """Ground truth over two files of unequal size, revenue with bad numbers, anchors, guarded cells and a plain table: written and read back."""
    csv = dict(header=True, escape='"')
    truth = readers.ground_truth(s, [W.as_file(s, d, "truth_a", W.TRUTH_FIRST, **csv), W.as_file(s, d, "truth_b", W.TRUTH_SECOND, **csv)])
    money = readers.revenue(s, W.as_file(s, d, "revenue_rows", W.REVENUE_FILE, **csv))
    orders = W.tables(s, d, "orders")["orders"]
    anchors_ = readers.anchors(s, W.as_written(s, d, "anchors", lambda p: writers.write_anchors(orders.select(F.col("o_custkey").cast("string").alias("address")).distinct(), p)))
    cells = readers.csv_table(s, W.as_written(s, d, "cells", lambda p: writers.write_csv(orders.select(F.concat(F.lit("="), "o_orderstatus").alias("cell")), p)))
    plain = readers.table(s, f"{d}/nation.parquet")
    zero = F.lit(0.0)
    parts = [truth.groupBy(F.concat_ws(":", "root", "label").alias("name")).agg(F.count("*").alias("n"), zero.alias("value")),
             money.groupBy(F.col("family").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("usd"), 2).alias("value")),
             anchors_.agg(F.lit("anchors").alias("name"), F.count("*").alias("n"), zero.alias("value")),
             cells.groupBy(F.col("cell").alias("name")).agg(F.count("*").alias("n"), zero.alias("value")),
             plain.groupBy(F.col("n_regionkey").alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("n_name")).cast("double").alias("value"))]
    return functools.reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ several tables
def _tables(s, d, *names):
    return W.tables(s, d, *names)


@query("JOIN1")
def joined_tables(s, d):
    j = relational.joined(_tables(s, d, "orders", "customer", "nation", "region"), JOIN_SPEC)
    return j.select(*[F.col(c) for c in ("orders__o_orderkey", "orders__o_custkey", "customer__c_name", "nation__n_name", "region__r_name")])


@query("JOIN3")
def orphan_keys(s, d):
    t = _tables(s, d, "lineitem", "orders", "part", "supplier", "labels", "documents")
    spec = dict(driving_table="lineitem", joins=[dict(table="orders", local_key="l_orderkey", foreign_key="o_orderkey"),
                                                 dict(table="part", local_key="l_partkey", foreign_key="p_partkey"),
                                                 dict(table="supplier", local_key="l_suppkey", foreign_key="s_suppkey")])
    return relational.orphan_keys(t, spec).unionByName(relational.orphan_keys(t, dict(driving_table="documents", joins=[
        dict(table="labels", local_key="doc_id", foreign_key="doc_id")])))


@query("PRF12")
def table_relationships(s, d):
    t = _tables(s, d, "documents", "labels", "conversations", "pages", "benchmark")
    return relational.relationships(t, REG)


@query("PRF8 PRF9 PRF10 PRF11")
def table_roles(s, d):
    """Eight uploads surveyed at once, every kind of table once."""
    return relational.table_roles(uploads(s, d), REG, W.UPLOAD_CHOICES)


JOINED_MAPPING = {"address": "orders__hex", "category": "customer__segment", "label": None, "source": "nation__n_name", "timestamp": "orders__day", "chain": None,
                  "actor": None, "entity": None, "confidence": None}


def _joined_rows(s, d):
    t = _tables(s, d, "orders", "customer", "nation")
    k = F.col("o_custkey").cast("string")
    hexed = F.substring(F.concat(F.md5(k), F.md5(F.concat(F.lit("x"), k))), 1, 40)
    orders = t["orders"].select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("0x"), hexed)).alias("hex"),
                                F.col("o_orderdate").cast("date").cast("string").alias("day"))
    segment = {"MACHINERY": "exchange", "AUTOMOBILE": "mixer", "BUILDING": "", "HOUSEHOLD": "casino"}
    seg = F.lit("other thing")
    for a, b in segment.items():
        seg = F.when(F.col("c_mktsegment") == a, b).otherwise(seg)
    customers = t["customer"].select("c_custkey", "c_nationkey", seg.alias("segment"))
    spec = dict(driving_table="orders", joins=[dict(table="customer", local_key="o_custkey", foreign_key="c_custkey"),
                                               dict(table="nation", local_table="customer", local_key="c_nationkey", foreign_key="n_nationkey")])
    j = relational.joined({"orders": orders, "customer": customers, "nation": t["nation"].select("n_nationkey", "n_name")}, spec)
    rows = j.select(F.col("orders__o_orderkey").alias("row_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in j.columns])
    return rows, spec


@query("VAL7 JOIN1")
def joined_validation(s, d):
    rows, _ = _joined_rows(s, d)
    return validation.validate(rows, JOINED_MAPPING, REG, "ethereum", single_label=True).reasons()


@query("PRF13 VAL7")
def joined_profile(s, d):
    rows, spec = _joined_rows(s, d)
    v = validation.validate(rows, JOINED_MAPPING, REG, "ethereum", single_label=True)
    rec = relational.provenance_record(spec, {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}, JOINED_MAPPING)
    return relational.dataset_profile(claim_ops.build_claims(v.valid, JOINED_MAPPING, "joined_desk", REG, provenance_record=rec))


# ------------------------------------------------------------------ end to end
@query("AGG6 AGG13 AGG23 STA1")
def corpus_report(s, d):
    return corpus_audit.report(corpus(s, d), REG, _as_of())
