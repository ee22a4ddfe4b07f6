"""Auditing a corpus end to end: the claims are read for a few shared intermediates, and every
reported figure is taken from those."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, currency, metrics, overlap, roots
from ..operators.subjects import subject_table
from ..registry import Registry
from ..session import written


def intermediates(claims: DataFrame, reg: Registry, keep: bool = True) -> dict[str, DataFrame]:
    """The tables every figure derives from.  ``keep`` writes them to the shared checkpoint folder, so
    a lost executor re-reads files instead of the whole corpus."""
    parts = {"subjects": subject_table(claims, reg), "source_sets": overlap.source_set_counts(claims),
             "root_claims": roots.root_claims(claims)}
    return {k: written(v) for k, v in parts.items()} if keep else parts


def report(claims: DataFrame, reg: Registry, as_of: Column, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, value, basis) rows: agreement, coverage, overlap, kappa, roots, currency."""
    t = shared or intermediates(claims, reg, keep=False)
    kappa = agreement.kappa(claims, reg)
    parts = [
        metrics.keyed(agreement.outcomes(t["subjects"]), "agreement", ["outcome"], ["n", "share"]),
        metrics.keyed(agreement.coverage(t["subjects"]), "coverage", [], ["n_subjects", "n_multi_source", "multi_source_rate"]),
        metrics.keyed(roots.circular_subjects(t["subjects"]), "independence", [], ["n_circular"]),
        metrics.keyed(overlap.source_sizes(t["source_sets"]), "sources", ["source"], ["n_subjects", "n_covered"]),
        metrics.keyed(overlap.containment(t["source_sets"]), "containment", ["source", "inside"], ["share_of_a"]),
        metrics.keyed(agreement.kappa_summary(kappa), "kappa", [], ["n_pairs", "n_undefined", "n_substantial"]),
        metrics.keyed(t["root_claims"].agg(F.count("*").alias("total"), F.count_if("root_known").alias("identified")), "roots", [], ["total", "identified"]),
        metrics.keyed(currency.freshness(claims, reg, as_of).withColumn("who", F.coalesce("source", F.lit("total"))), "currency", ["who"],
                      ["current", "stale", "currency_unknown"])]
    return reduce(DataFrame.unionByName, parts)
