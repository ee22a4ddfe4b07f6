"""Policies, coverage, and the audited table against the reference."""
import pytest
from conftest import by, day, one

from attestra.operators import target, trust, verdict

SPEC = {"baseline": "b", "rules": {"all": {"combine": "raw_sum", "keep": []}, "b": {"combine": "dedup_max_per_address", "keep": []},
                                   "collapsed": {"combine": "dedup_max_per_address", "keep": ["root_independent_or_native"]},
                                   "anchored": {"combine": "dedup_max_per_address", "keep": ["anchor_membership"]},
                                   "tiered": {"combine": "raw_sum", "keep": [{"min_evidence_tier": {"tier": "derived"}}]},
                                   "calm": {"combine": "raw_sum", "keep": ["non_circular"]}}}


def _valued(make, lone_resolved):
    from pyspark.sql import functions as F
    rows = [dict(address="1", source="origin", root="r1", resolved=True, native=True, heuristic="curated"), dict(address="1", source="copy", root="r1", resolved=True, native=False),
            dict(address="2", source="lone", root="r2", resolved=lone_resolved, native=False)]
    return make(rows).withColumn("value_usd", F.element_at(F.array(F.lit(10.0), F.lit(7.0), F.lit(5.0)), F.col("claim_seq").cast("int") + 1))


def test_policies(spark, make, reg):
    got = by(trust.drift(_valued(make, False), reg, spark.createDataFrame([("2",)], "address string"), spec=SPEC), "policy")
    assert {k: (v["observations"], v["addresses"], v["value"]) for k, v in got.items()} == {
        "all": (3, 2, 22.0), "b": (2, 2, 15.0), "collapsed": (2, 2, 15.0), "anchored": (1, 1, 5.0), "tiered": (1, 1, 10.0), "calm": (1, 1, 5.0)}
    assert got["anchored"]["coverage_vs_baseline"] == 0.5 and got["all"]["ratio_vs_baseline"] == pytest.approx(22 / 15)
    assert got["all"]["shared_addresses"] == 1


def test_a_lone_copy_is_excluded_and_no_anchor_list_keeps_nothing(make, reg):
    got = by(trust.drift(_valued(make, True), reg, None, spec=SPEC), "policy")
    assert (got["collapsed"]["addresses"], got["collapsed"]["value"]) == (1, 10.0)
    assert (got["anchored"]["addresses"], got["anchored"]["value"]) == (0, 0.0)


def test_bad_specs_are_refused(reg):
    with pytest.raises(KeyError):
        trust.policies(reg, {"baseline": "x", "rules": {"a": {"combine": "raw_sum"}}})
    with pytest.raises(ValueError):
        trust.policies(reg, {"baseline": "a", "rules": {"a": {"combine": "median"}}})


REF = [dict(address="a", source="ransomwhere", canon="ransomware", root="ransomwhere_crowd"), dict(address="a", source="schnoering", canon="exchange", root="ofac_sdn"),
       dict(address="z", source="ransomwhere", canon="mixer", root="ransomwhere_crowd"), dict(address="z", source="schnoering", canon="exchange", root="ofac_sdn")]


def test_reference_disagreement_elsewhere_moves_nothing(make, reg):
    mine = make([dict(address="q", source="up", canon="mixer", root="up:unresolved", resolved=False), dict(address="a", source="up", canon="ransomware", root="up:unresolved", resolved=False)])
    full = target.audit_profile(target.audit_subjects(mine, make(REF), reg))
    less = target.audit_profile(target.audit_subjects(mine, make(REF[:2]), reg))
    assert one(full) == one(less)
    p = one(full)
    assert (p["n_subjects"], p["comparable"], p["no_match"], p["polarity_conflict"], p["confirmed_independent"], p["independence_unresolved"]) == (2, 1, 1, 1, 0, 1)


def test_comparability_states(make, reg):
    def status(root, resolved, ref=REF[:1], canon="ransomware", flagged=None, chain=None):
        mine = make([dict(address="a", source="up", canon=canon, root=root, resolved=resolved, chain=chain)])
        r = one(target.audit_subjects(mine, make(ref), reg, flagged))
        return r["comparability"], r["resolution"], r["outcome"]
    assert status("ransomwhere_crowd", True)[:2] == (target.SAME, "resolved")
    assert status("own_desk", True)[:2] == (target.DISTINCT, "resolved")
    assert status("up:unresolved", False)[:2] == (target.UNRESOLVED, "unresolved")
    # two distinct reference roots do not make the audited table independent
    assert status("up:unresolved", False, REF[:2])[0] == target.UNRESOLVED
    # a known source on another chain never speaks about the identifier
    assert status("own_desk", True, chain="ethereum")[0] == target.NO_MATCH
    assert status("own_desk", True, chain="bitcoin")[0] == target.DISTINCT
    # the audited table said nothing interpretable: reference opinions are not its outcome
    assert status("own_desk", True, REF[:2], canon="unknown")[2] == "incomparable"


def test_inheritance_needs_overlap_and_size(spark, make, reg):
    ref = make([dict(address=f"k{i}", source="ransomwhere") for i in range(8)])
    def names(n, extra=0, fam=""):
        mine = make([dict(address=f"k{i}", source="up", prov_family=fam) for i in range(n)] + [dict(address=f"n{i}", source="up") for i in range(extra)])
        return {r.source: (r.by_containment, r.n_naming) for r in target.inheritance_candidates(mine, ref, reg).collect()}
    assert names(6) == {"ransomwhere": (True, 0)}
    assert names(4) == {}                                        # too few to say
    assert names(6, 1) == {}                                     # 6 of 7 is not containment
    assert names(6, 1, "from the RANSOMWHERE export") == {"ransomwhere": (False, 6)}
    assert names(0, 6) == {}                                     # a name alone, with nothing shared, is no candidate


def test_partial_flagging(spark, make, reg):
    flagged = spark.createDataFrame([("ransomwhere",)], "source string")
    mine = make([dict(address="a", source="up", root="up:unresolved", resolved=False)])
    assert one(target.audit_subjects(mine, make(REF[:1]), reg, flagged))["comparability"] == target.SAME
    r = one(target.audit_subjects(mine, make(REF[:2]), reg, flagged))
    assert (r["comparability"], r["resolution"]) == (target.UNRESOLVED, "partially_resolved")


def test_pairs_are_never_dealt_by_source_alone(spark, make, reg):
    flagged = spark.createDataFrame([("ransomwhere",)], "source string")
    mine = make([dict(address="a", source="up", root="up:unresolved", resolved=False)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as when Spark cannot tell that few sources are flagged
    try:
        plan = target.audit_subjects(mine, make(REF), reg, flagged)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(subject#" in plan and "hashpartitioning(source#" not in plan


BASE = dict(n_input=100, n_rejected=0, n_subjects=100, n_contradicting=0, n_claims=100, n_uninterpretable=0, comparable=80, no_match=20, same_provenance=0, exact=80,
            refined=0, entity_conflict=0, polarity_conflict=0, unresolved=0, stale=0, staleness_computed=True)


@pytest.mark.parametrize("change,want", [
    ({}, "supported"), (dict(n_rejected=1), "supported_with_caveats"), (dict(n_rejected=25), "concerns"), (dict(comparable=29), "not_established"),
    (dict(n_contradicting=2), "concerns"), (dict(exact=72, entity_conflict=8), "concerns"), (dict(exact=78, polarity_conflict=2), "supported_with_caveats"),
    (dict(unresolved=50), "supported_with_caveats"), (dict(stale=50), "supported_with_caveats"), (dict(stale=50, staleness_computed=False), "supported"),
    (dict(comparable=29, exact=0, entity_conflict=29), "not_established"), (dict(n_uninterpretable=25), "supported_with_caveats"), (dict(same_provenance=40), "supported_with_caveats")])
def test_verdicts(spark, reg, change, want):
    facts = spark.createDataFrame([{**BASE, **change}], ", ".join(f"{k} {'boolean' if k == 'staleness_computed' else 'bigint'}" for k in BASE))
    assert verdict.verdict(verdict.findings(facts, reg)).first()[0] == want


def test_coverage_skips_rules_without_their_prerequisite(make, reg):
    from attestra.operators.subjects import subject_table
    claims = make([dict(address="1", source="a", lastmod="2001-01-01"), dict(address="1", source="b", resolved=False, root="u"), dict(address="2", source="a", resolved=False, root="u")])
    ctx, rules, chosen = trust.Context(reg, day("2020-01-01")), reg.analysis["coverage_rules"], ["current_only", "resolved_provenance_only"]
    table = subject_table(claims, reg, measures=trust.coverage_measures(ctx, rules, chosen))
    full = by(trust.trust_coverage(table, ctx, rules, chosen), "mode", "rule")
    assert (full["together", "current_only"]["n_claims"], full["together", "resolved_provenance_only"]["n_claims"]) == (2, 0)
    part = by(trust.trust_coverage(table, ctx, rules, chosen, {"staleness": "not_applicable"}), "mode", "rule")
    assert part["together", "current_only"]["state"] == "not_applicable" and part["together", "current_only"]["n_claims"] is None
    assert part["together", "resolved_provenance_only"]["n_claims"] == 1
