"""Auditing an unseen table: profile, validate, build claims, compare, judge."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import claims as claim_ops, preflight as intake, subjects, target, validation, verdict
from ..registry import Registry
from ..session import written


@dataclass
class Audit:
    preflight: intake.Preflight
    validation: validation.Validation | None = None
    claims: DataFrame | None = None
    candidates: DataFrame | None = None
    subjects: DataFrame | None = None
    states: DataFrame | None = None
    findings: DataFrame | None = None
    verdict: str = "cannot_assess"
    stopped: str | None = None


def _facts(claims: DataFrame, audited: DataFrame, reg: Registry, as_of: Column, counts: DataFrame | None, staleness: Column) -> DataFrame:
    own = subjects.self_consistency(claims, reg).agg(F.count_if(F.col("bucket") == subjects.SELF_CONSISTENCY[3]).alias("n_contradicting"))
    one = (target.audit_profile(audited).join(target.target_facts(claims, reg, as_of))
           .join(own))                                                                  # one row each
    if counts is None:
        rows = one.withColumns({"n_input": F.lit(None).cast("bigint"), "n_rejected": F.lit(None).cast("bigint")})
    else:
        rows = one.join(counts.select("n_input", "n_rejected"))
    return rows.withColumn("staleness_computed", staleness)


def findings_of(claims: DataFrame, reference: DataFrame, reg: Registry, as_of: Column, counts: DataFrame | None = None,
                dated: bool = True) -> DataFrame:
    """The verdict's findings for a table of claims already built."""
    flagged = target.inheritance_candidates(claims, reference, reg)
    audited = target.audit_subjects(claims, reference, reg, flagged)
    has_dates = F.col("n_claims") > F.col("n_without_date") if dated else F.lit(False)
    return verdict.findings(_facts(claims, audited, reg, as_of, counts, has_dates), reg)


def audit(rows: DataFrame, source_id: str, reg: Registry, reference: DataFrame, as_of: Column, choices: dict[str, str] | None = None,
          chain: str | None = None, confirmed: bool = False) -> Audit:
    """The whole route for a table of text cells with ``row_id``.  It stops, with no claims, where the
    profile or the share of valid identifiers says that nothing can be concluded."""
    if source_id in reg.sources:
        raise ValueError(f"{source_id!r} is a known source; choose another id")
    pf = intake.preflight(rows, reg, choices, chain, confirmed)
    out = Audit(pf)
    if not pf.can_analyse:
        out.stopped = pf.status
        return out
    v = validation.validate(rows, pf.mapping, reg, pf.chain, multi_label=pf.label_structure)
    v = validation.Validation(v.rows, written(v.judged))         # judged once, read by every step below
    out.validation = v
    if not validation.passes_floor(v.counts(), reg).first()["passes"]:
        out.stopped = "subject_invalid_full"
        return out
    claims = written(claim_ops.build_claims(v.valid, pf.mapping, source_id, reg))
    out.claims = claims
    out.candidates = target.inheritance_candidates(claims, reference, reg)
    out.subjects = written(target.audit_subjects(claims, reference, reg, out.candidates))
    profile, facts = target.audit_profile(out.subjects), target.target_facts(claims, reg, as_of)
    out.states = verdict.analysis_states(profile, facts, reg, True, pf.currency_basis is not None)
    dated = F.lit(pf.currency_basis is not None) & (F.col("n_claims") > F.col("n_without_date"))
    out.findings = verdict.findings(_facts(claims, out.subjects, reg, as_of, v.counts(), dated), reg)
    out.verdict = verdict.verdict(out.findings).first()["verdict"]
    return out
