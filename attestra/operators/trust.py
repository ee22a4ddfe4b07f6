"""Trust policies: which claims count, and how far an answer moves when the policy changes.

A predicate either looks at one claim (a Column over the claim) or at everything said about its
subject (a Column over the subject's row, which may use measures carried there).  Either way the
claims are read once: every policy or rule becomes conditional counters in the same aggregation.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions.text import ratio
from ..registry import Registry
from . import claims as claim_ops
from .subjects import subject_table


@dataclass
class Context:
    reg: Registry
    as_of: Column | None = None
    #: column of the subject row telling whether an outside anchor list names the address
    anchor_flag: str | None = None


@dataclass(frozen=True)
class Predicate:
    level: str                                             # "claim" or "subject"
    test: Callable[..., Column]                            # (context, **params) -> Column
    measures: Callable[[Context], dict] = field(default=lambda ctx: {})
    needs_evidence: bool = False                           # uses sources, roots or the outcome of the subject


def _conflict_among(*outcomes: str) -> Callable[..., Column]:
    # agreement is only judged where two sources speak; elsewhere there is no outcome to exclude
    return lambda ctx: ~((F.col("n_sources") >= 2) & F.col("outcome").isin(*outcomes))


def _tier_at_least(ctx: Context, tier: str) -> Column:
    order = ctx.reg.analysis["tier_order"]
    wanted = order.index(tier) if tier in order else len(order)
    return evidence.tier_rank(ctx.reg, claim_ops.tier(ctx.reg)) <= wanted


def _anchored(ctx: Context) -> Column:
    return F.coalesce(F.col(ctx.anchor_flag), F.lit(False)) if ctx.anchor_flag else F.lit(False)


PREDICATES: dict[str, Predicate] = {
    "resolved_provenance_only": Predicate("claim", lambda ctx: F.col("prov_resolved")),
    "min_evidence_tier": Predicate("claim", _tier_at_least),
    "current_only": Predicate("claim", lambda ctx: evidence.currency_status(
        ctx.reg, F.col("lastmod"), ctx.as_of) != evidence.STALE),
    # one groundable claim keeps the whole subject
    "root_independent_or_native": Predicate(
        "subject", lambda ctx: F.col("groundable") == 1,
        lambda ctx: {"groundable": ("max", (~F.col("prov_resolved") | F.col("prov_native")).cast("int"))}),
    "anchor_membership": Predicate("subject", _anchored),
    "non_circular": Predicate("subject", lambda ctx: ~F.col("circular"), needs_evidence=True),
    "exclude_conflicts": Predicate("subject", _conflict_among("entity-type conflict", "licit/illicit conflict"),
                                   needs_evidence=True),
    "exclude_licit_illicit_conflict": Predicate("subject", _conflict_among("licit/illicit conflict"), needs_evidence=True),
}


@dataclass(frozen=True)
class Policy:
    name: str
    label: str
    combine: str
    keep: tuple[tuple[str, dict], ...]

    def tests(self, ctx: Context, level: str) -> Column:
        out = F.lit(True)
        for name, params in self.keep:
            if PREDICATES[name].level == level:
                out = out & PREDICATES[name].test(ctx, **params)
        return out


def _named(spec) -> tuple[str, dict]:
    if isinstance(spec, str):
        return spec, {}
    (name, params), = spec.items()
    return name, dict(params or {})


def policies(reg: Registry, spec: dict | None = None) -> tuple[list[Policy], str]:
    spec = spec or reg.analysis["policies"]
    out = [Policy(n, p.get("label", n), p["combine"], tuple(_named(k) for k in p.get("keep", [])))
           for n, p in spec["rules"].items()]
    for p in out:
        if p.combine not in ("raw_sum", "dedup_max_per_address"):
            raise ValueError(f"unknown way to combine: {p.combine!r}")
        unknown = [n for n, _ in p.keep if n not in PREDICATES]
        if unknown:
            raise ValueError(f"unknown predicate {unknown[0]!r}")
    if spec["baseline"] not in [p.name for p in out]:
        raise KeyError(f"baseline policy {spec['baseline']!r} is not among the loaded policies")
    return out, spec["baseline"]


def revenue_claims(rows: DataFrame, reg: Registry) -> DataFrame:
    """Value rows (address, dataset, usd, family, src_letters) as claims with a provenance root."""
    usd = F.coalesce(F.col("usd").cast("string").try_cast("double"), F.lit(0.0))
    empty = F.lit("")
    df = rows.select(
        *(["claim_seq"] if "claim_seq" in rows.columns else [F.monotonically_increasing_id().alias("claim_seq")]),
        "address", F.col("dataset").alias("source"), usd.alias("value_usd"),
        F.concat_ws(":", "dataset", F.coalesce("src_letters", empty)).alias("prov_family"),
        F.coalesce("family", empty).alias("subcat"), empty.alias("raw_label"), F.lit(reg.unknown).alias("canon"),
        F.lit("unknown").alias("polarity"), empty.alias("lastmod"), empty.alias("heuristic"))
    return claim_ops.stamp(df, reg)


def value_per_subject(claims: DataFrame, ctx: Context, rules: list[Policy], value: str = "value_usd",
                      anchors: DataFrame | None = None) -> tuple[DataFrame, Context]:
    """One row per subject with each policy's kept count, sum and maximum (before subject tests)."""
    measures: dict = {}
    needs_evidence = False
    for p in rules:
        ok = p.tests(ctx, "claim")
        measures[f"n_{p.name}"] = ("sum", ok.cast("bigint"))
        measures[f"sum_{p.name}"] = ("sum", F.when(ok, F.col(value)))
        measures[f"max_{p.name}"] = ("max", F.when(ok, F.col(value)))
        for name, _ in p.keep:
            measures.update(PREDICATES[name].measures(ctx))
            needs_evidence |= PREDICATES[name].needs_evidence
    measures["sources_lo"], measures["sources_hi"] = ("min", F.xxhash64("source")), ("max", F.xxhash64("source"))
    if needs_evidence:
        rows = subject_table(claims, ctx.reg, ["subject", "address"], measures)
    else:
        how = {"sum": F.sum, "max": F.max, "min": F.min}
        rows = claims.groupBy("subject", "address").agg(*[how[h](c).alias(n) for n, (h, c) in measures.items()])
    if anchors is not None:
        # both sides have one row per address; Spark picks the join from their actual sizes
        rows = rows.join(anchors.select("address", F.lit(True).alias("anchored")).distinct(), "address", "left")
        ctx = Context(ctx.reg, ctx.as_of, "anchored")
    return rows, ctx


def drift(claims: DataFrame, reg: Registry, anchors: DataFrame | None = None, as_of: Column | None = None,
          spec: dict | None = None, value: str = "value_usd") -> DataFrame:
    """The aggregate under every policy, with its ratio to and coverage of the baseline."""
    rules, baseline = policies(reg, spec)
    rows, ctx = value_per_subject(claims, Context(reg, as_of), rules, value, anchors)
    cols, zero = [], F.lit(0.0)
    for p in rules:
        kept = p.tests(ctx, "subject") & (F.col(f"n_{p.name}") > 0)
        n = F.count_if(kept)
        if p.combine == "raw_sum":
            obs = F.coalesce(F.sum(F.when(kept, F.col(f"n_{p.name}"))), F.lit(0))
            total = F.sum(F.when(kept, F.col(f"sum_{p.name}")))
        else:
            obs, total = n, F.sum(F.when(kept, F.col(f"max_{p.name}")))
        cols += [obs.alias(f"obs_{p.name}"), n.alias(f"adr_{p.name}"), F.coalesce(total, zero).alias(f"val_{p.name}")]
    one = rows.agg(*cols, F.count_if(F.col("sources_lo") != F.col("sources_hi")).alias("shared_addresses"))
    out = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.combine).alias("combine"),
                             F.col(f"obs_{p.name}").alias("observations"), F.col(f"adr_{p.name}").alias("addresses"),
                             F.col(f"val_{p.name}").alias("value"),
                             ratio(F.col(f"val_{p.name}"), F.col(f"val_{baseline}")).alias("ratio_vs_baseline"),
                             ratio(F.col(f"obs_{p.name}"), F.col(f"obs_{baseline}")).alias("coverage_vs_baseline"))
                    for p in rules])
    return one.select(F.explode(out).alias("r"), "shared_addresses").select("r.*", "shared_addresses")


def drift_summary(drifted: DataFrame, names: tuple[str, str, str, str] = ("naive_union", "address_dedup",
                                                                       "inheritance_collapsed", "verified_only")) -> DataFrame:
    """Spreads and losses between the four conditions, from the few rows of ``drift``."""
    a, b, c, d = names

    def val(p: str, col: str = "value") -> Column:
        return F.max(F.when(F.col("policy") == p, F.col(col)))

    one = drifted.agg(*[val(p).alias(f"v{i}") for i, p in enumerate(names)],
                      val(b, "addresses").alias("ab"), val(c, "addresses").alias("ac"),
                      F.max("shared_addresses").alias("double_counted_addresses"))
    r = lambda x, y: ratio(F.col(x), F.col(y))     # noqa: E731
    return one.select((r("v0", "v1") - 1).alias("naive_inflation"), (F.lit(1.0) - r("ac", "ab")).alias("addresses_removed"),
                      (F.lit(1.0) - r("v2", "v1")).alias("value_removed"), r("v1", "v3").alias("spread_b_over_d"),
                      r("v0", "v3").alias("spread_a_over_d"), "double_counted_addresses")


def retained(claims: DataFrame, reg: Registry, policy: str, anchors: DataFrame | None = None, as_of=None,
             value: str = "value_usd") -> DataFrame:
    """The addresses a policy keeps."""
    rule = [p for p in policies(reg)[0] if p.name == policy]
    rows, ctx = value_per_subject(claims, Context(reg, as_of), rule, value, anchors)
    return rows.where(rule[0].tests(ctx, "subject") & (F.col(f"n_{policy}") > 0)).select("address").distinct()


def eligibility_trace(kept: DataFrame, claims: DataFrame, reg: Registry) -> DataFrame:
    """How many retained addresses carry each declared-confidence claim, any of them, or none."""
    criteria = reg.analysis["declared_confidence"]
    hits = [((F.col("source") == c["source"]) & (F.col(c["field"]) == str(c["equals"]))) for c in criteria]
    per_address = claims.groupBy("address").agg(*[F.max(h.cast("int")).alias(f"c{i}") for i, h in enumerate(hits)])
    on_kept = kept.join(per_address, "address", "left")      # one row per address on both sides
    met = [F.coalesce(F.col(f"c{i}"), F.lit(0)) == 1 for i in range(len(hits))]
    any_met = met[0]
    for m in met[1:]:
        any_met = any_met | m
    one = on_kept.agg(F.count("*").alias("n"), F.count_if(any_met).alias("any"),
                      *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(met)])
    rows = [F.struct(F.lit(f"{c['source']}.{c['field']}={c['equals']}").alias("criterion"), F.col(f"n{i}").alias("n_addresses"))
            for i, c in enumerate(criteria)]
    rows += [F.struct(F.lit("any").alias("criterion"), F.col("any").alias("n_addresses")),
             F.struct(F.lit("none").alias("criterion"), (F.col("n") - F.col("any")).alias("n_addresses"))]
    return one.select("n", F.explode(F.array(*rows)).alias("r")).select("r.*", ratio(F.col("r.n_addresses"), F.col("n")).alias("share"))


def roots_at(kept: DataFrame, claims: DataFrame, limit: int = 5) -> DataFrame:
    pairs = claims.select("address", "root").distinct().join(kept, "address", "left_semi")
    return pairs.groupBy("root").agg(F.count("*").alias("n_addresses")).orderBy(F.desc("n_addresses"), "root").limit(limit)


def native_values_at(kept: DataFrame, claims: DataFrame, source: str, field_name: str, limit: int = 8) -> DataFrame:
    """The source's own vocabulary at the retained addresses."""
    value = F.when(F.col(field_name) != "", F.col(field_name)).otherwise("(blank)")
    here = claims.where(F.col("source") == source).groupBy("address", value.alias("value")).agg(F.count("*").alias("n"))
    return (here.join(kept, "address", "left_semi").groupBy("value").agg(F.sum("n").alias("n_claims"))
            .orderBy(F.desc("n_claims"), "value").limit(limit))


def top_by_value(kept: DataFrame, claims: DataFrame, value: str = "value_usd", limit: int = 10) -> DataFrame:
    """The retained addresses of highest value; the last value stated for an address is its value."""
    last = claims.groupBy("address").agg(F.max_by(value, F.struct("claim_seq", value)).alias("usd"))
    return last.join(kept, "address", "left_semi").orderBy(F.desc("usd"), "address").limit(limit)


def trust_coverage(subjects_and_counts: DataFrame, ctx: Context, rules: list[dict], chosen: list[str],
                   states: dict[str, str] | None = None) -> DataFrame:
    """Evidence each rule keeps alone, and the chosen rules keep together in order.  A rule whose
    prerequisite was not computed keeps nothing and removes nothing."""
    states = states or {}
    by_id = {r["id"]: r for r in rules}

    def usable(r: dict) -> bool:
        return states.get(r.get("requires", ""), "computed") == "computed"

    steps, combo = [("alone", r["id"], [r["id"]] if usable(r) else None) for r in rules], []
    for rid in chosen:
        if usable(by_id[rid]):
            combo = combo + [rid]
            steps.append(("together", rid, list(combo)))
        else:
            steps.append(("together", rid, None))
    cols = [F.sum("n_all").alias("c_all"), F.count_if(F.col("n_all") > 0).alias("s_all")]
    for i, (_, _, ids) in enumerate(steps):
        if ids is None:
            cols += [F.max(F.lit(None).cast("bigint")).alias(f"c{i}"), F.max(F.lit(None).cast("bigint")).alias(f"s{i}")]
            continue
        keep = F.lit(True)
        for rid in ids:
            p = PREDICATES[by_id[rid]["predicate"]]
            if p.level == "subject":
                keep = keep & p.test(ctx, **by_id[rid].get("params", {}))
        n = F.when(keep, F.col(_counter(by_id, ids))).otherwise(0)
        cols += [F.sum(n).alias(f"c{i}"), F.count_if(n > 0).alias(f"s{i}")]
    one = subjects_and_counts.agg(*cols)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(mode).alias("mode"), F.lit(rid).alias("rule"),
                              F.lit("computed" if ids is not None else "not_applicable").alias("state"),
                              F.col(f"c{i}").alias("n_claims"), F.col(f"s{i}").alias("n_subjects"))
                     for i, (mode, rid, ids) in enumerate(steps)])
    return (one.select("c_all", F.explode(rows).alias("r"))
            .select("r.*", ratio(F.col("r.n_claims"), F.col("c_all")).alias("claims_share")))


def _claim_rules(by_id: dict, ids: list[str]) -> list[str]:
    return sorted({i for i in ids if PREDICATES[by_id[i]["predicate"]].level == "claim"})


def _counter(by_id: dict, ids: list[str]) -> str:
    kept = _claim_rules(by_id, ids)
    return "n_" + "__".join(kept) if kept else "n_all"


def coverage_measures(ctx: Context, rules: list[dict], chosen: list[str], mine: Column | None = None) -> dict:
    """Counters of claims that pass each needed combination of claim-level rules.  ``mine`` limits
    them to the audited table when reference claims are present for context."""
    by_id = {r["id"]: r for r in rules}
    own = mine if mine is not None else F.lit(True)
    combos = [[r["id"]] for r in rules] + [chosen[:i + 1] for i in range(len(chosen))]
    out = {"n_all": ("sum", own.cast("bigint"))}
    for ids in combos:
        test = own
        for rid in _claim_rules(by_id, ids):
            test = test & PREDICATES[by_id[rid]["predicate"]].test(ctx, **by_id[rid].get("params", {}))
        out[_counter(by_id, ids)] = ("sum", test.cast("bigint"))
    # a skipped rule drops out of later combinations, so every subset that can occur is counted
    for ids in list(combos):
        for rid in ids:
            rest = [i for i in ids if i != rid]
            if rest and _counter(by_id, rest) not in out:
                test = own
                for r2 in _claim_rules(by_id, rest):
                    test = test & PREDICATES[by_id[r2]["predicate"]].test(ctx, **by_id[r2].get("params", {}))
                out[_counter(by_id, rest)] = ("sum", test.cast("bigint"))
    return out
