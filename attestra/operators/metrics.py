"""Figures as long-form rows that carry their population, so shares never cross populations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..registry import Registry
from . import currency, overlap, roots
from .subjects import OUTCOMES, subject_table

CLAIMS, NORMAL, RAW = "claims", "normalised_addresses", "raw_address_keys"


def _records(one: DataFrame, rows: list[tuple[str, str, Column, Column | None, Column | None]]) -> DataFrame:
    """(metric, population, value, numerator, denominator) of a one-row frame -> long form.  A missing
    value is unavailable; a share exists only when numerator and denominator do."""
    null = F.lit(None).cast("bigint")
    structs = [F.struct(F.lit(m).alias("metric"), F.lit(pop).alias("population"), v.cast("bigint").alias("value"),
                        (n.cast("bigint") if n is not None else null).alias("numerator"),
                        (d.cast("bigint") if d is not None else null).alias("denominator")) for m, pop, v, n, d in rows]
    return (one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
            .withColumns({"share": ratio(F.col("numerator"), F.col("denominator")),
                          "quality": F.when(F.col("value").isNull(), "unavailable").otherwise("live"),
                          "unit": F.when(F.col("population") == CLAIMS, "claims").otherwise("addresses")}))


def overview(claims: DataFrame, reg: Registry, as_of: Column) -> DataFrame:
    """The headline figures of a corpus, each inside one population."""
    subjects = subject_table(claims, reg)
    multi = F.col("n_sources") >= 2
    s = subjects.agg(F.count("*").alias("n"), F.count_if(multi).alias("multi"),
                     *[F.count_if(multi & (F.col("outcome") == o)).alias(f"o{i}") for i, o in enumerate(OUTCOMES)])
    n, m = F.col("n"), F.col("multi")
    parts = [_records(s, [("normalised_addresses", NORMAL, n, None, None), ("multi_dataset", NORMAL, m, m, n),
                          ("single_source", NORMAL, n - m, n - m, n)]
                      + [(f"agreement.{o}", NORMAL, F.col(f"o{i}"), F.col(f"o{i}"), m) for i, o in enumerate(OUTCOMES)])]
    raw = claims.agg(F.count_distinct("raw_address").alias("raw"))
    parts.append(_records(raw, [("raw_address_keys", RAW, F.col("raw"), None, None)]))
    u = roots.unresolved_subjects(claims)
    parts.append(_records(u, [("unresolved_provenance", NORMAL, F.col("n_unresolved"), F.col("n_unresolved"), F.col("n_subjects"))]))
    fresh = currency.freshness(claims, reg, as_of)
    total = fresh.where("source IS NULL")
    c = F.col("n_claims")
    parts.append(_records(total, [("claims", CLAIMS, c, None, None)] + [(f"currency.{k}", CLAIMS, F.col(k), F.col(k), c)
                                                                       for k in ("current", "stale", "currency_unknown")]))
    rt = roots.root_totals(claims)
    parts.append(_records(rt, [("provenance_roots", CLAIMS, F.col("n_roots"), None, None),
                               ("identified_roots", CLAIMS, F.col("n_identified"), None, None)]))
    per = fresh.where("source IS NOT NULL").select(F.concat(F.lit("claims_of."), "source").alias("metric"), "n_claims") \
        .join(F.broadcast(total.select(F.col("n_claims").alias("all_claims"))))                  # one row
    parts.append(per.select("metric", F.lit(CLAIMS).alias("population"), F.col("n_claims").alias("value"),
                            F.col("n_claims").alias("numerator"), F.col("all_claims").alias("denominator"),
                            ratio(F.col("n_claims"), F.col("all_claims")).alias("share"), F.lit("live").alias("quality"),
                            F.lit("claims").alias("unit")))
    return reduce(DataFrame.unionByName, parts)


def keyed(df: DataFrame, prefix: str, keys: list[str], values: list[str], basis: str = "LIVE") -> DataFrame:
    """Result columns -> (key, value, basis) with dotted keys."""
    key = F.concat_ws(".", F.lit(prefix), *[F.col(k).cast("string") for k in keys])
    rows = F.array(*[F.struct(F.concat_ws(".", key, F.lit(v)).alias("key"), F.col(v).cast("double").alias("value")) for v in values])
    out = df.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("basis", F.when(F.col("value").isNull(), "UNAVAILABLE").otherwise(basis))


def basis_of(full: bool, complete: set[str], has_manifest: bool, *sources: str) -> str:
    """LIVE for what the loaded claims determine, else what a manifest froze, else unavailable."""
    if full or (sources and set(sources) <= complete):
        return "LIVE"
    return "FROZEN_MANIFEST" if has_manifest else "UNAVAILABLE"


def paper_metrics(claims: DataFrame, reg: Registry, as_of: Column, drifted: DataFrame | None = None) -> DataFrame:
    """Every headline figure of a corpus as (key, value, basis)."""
    sets = overlap.source_set_counts(claims)
    table = currency.corpus_table(claims).withColumn("who", F.coalesce("source", F.lit("total")))
    parts = [keyed(table, "corpus", ["who"], ["n_claims", "n_subjects"]),
             keyed(roots.root_totals(claims), "corpus", [], ["n_roots", "n_identified", "n_unresolved"]),
             keyed(overlap.depth_buckets(sets), "coverage.depth", ["depth"], ["n_subjects", "share"]),
             keyed(overlap.overlap_matrix(sets), "coverage.overlap", ["source", "other"], ["intersection", "share_of_source"]),
             keyed(currency.freshness(claims, reg, as_of).withColumn("who", F.coalesce("source", F.lit("total"))), "currency",
                   ["who"], ["current", "stale", "currency_unknown", "stale_share_of_dated"]),
             keyed(roots.unresolved_subjects(claims), "unresolved", [], ["n_unresolved", "unresolved_share"])]
    if drifted is not None:
        parts.append(keyed(drifted, "drift", ["policy"], ["observations", "addresses", "value", "ratio_vs_baseline", "coverage_vs_baseline"]))
    return reduce(DataFrame.unionByName, parts)
