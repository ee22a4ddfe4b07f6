"""Which analyses may run, and the closing judgement of an audited table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..registry import Registry

COMPUTED, NOT_APPLICABLE, INSUFFICIENT, UNSUPPORTED = "computed", "not_applicable", "insufficient_data", "unsupported_schema"
ANALYSES = ("provenance", "reference_match", "conflicts", "staleness", "trust")


def analysis_states(profile: DataFrame | None, facts: DataFrame, reg: Registry, has_reference: bool = True,
                    has_currency_column: bool = True, supported: bool = True) -> DataFrame:
    """computed / not_applicable / insufficient_data / unsupported_schema per analysis: a figure that
    cannot be computed is never shown as zero."""
    one = facts.join(F.broadcast(profile)) if profile is not None else facts.withColumn("comparable", F.lit(0))   # one row each
    cls = reg.intake["source_class"]
    n, d = F.col("n_claims"), F.col("n_distinct_declared")
    a_class = (d <= cls["max_distinct"]) & (n > cls["min_rows_per_value"] * d)
    states = {
        "provenance": F.when((F.col("n_declared") == 0) | a_class, INSUFFICIENT).otherwise(COMPUTED),
        "reference_match": F.lit(COMPUTED if has_reference else NOT_APPLICABLE),
        "conflicts": F.when(F.col("comparable") > 0, COMPUTED).otherwise(NOT_APPLICABLE),
        "staleness": (F.when(n == F.col("n_without_date"), INSUFFICIENT).otherwise(COMPUTED) if has_currency_column
                      else F.lit(NOT_APPLICABLE)),
        "trust": F.when(n > 0, COMPUTED).otherwise(INSUFFICIENT)}
    rows = F.array(*[F.struct(F.lit(a).alias("analysis"), (states[a] if supported else F.lit(UNSUPPORTED)).alias("state"))
                     for a in ANALYSES])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _level(reg: Registry, measure: str, share: Column) -> Column:
    caveat, fail = reg.analysis["verdict"]["levels"][measure]
    out = F.when(share >= F.lit(float(caveat)), "caveat").otherwise("ok")
    return out if fail is None else F.when(share >= F.lit(float(fail)), "fail").otherwise(out)


def findings(facts: DataFrame, reg: Registry) -> DataFrame:
    """One row per measured share with its level.  ``facts`` is one row with n_input, n_rejected,
    n_subjects, n_contradicting, n_claims, n_uninterpretable, comparable, no_match, same_provenance,
    the outcome counts, unresolved, stale and staleness_computed."""
    enough = F.col("comparable") >= reg.analysis["verdict"]["min_comparable"]
    conflict = F.col("entity_conflict") + F.col("polarity_conflict")
    judged = F.col("exact") + F.col("refined") + conflict
    shares = {
        "rejected_row_share": (ratio(F.col("n_rejected"), F.col("n_input")), F.lit(True)),
        "internal_contradiction_share": (ratio(F.col("n_contradicting"), F.col("n_subjects")), F.lit(True)),
        "uninterpretable_label_share": (ratio(F.col("n_uninterpretable"), F.col("n_claims")), F.lit(True)),
        "no_reference_match_share": (ratio(F.col("no_match"), F.col("n_subjects")), enough),
        "reference_conflict_share": (ratio(conflict, judged), enough & (judged > 0)),
        "same_provenance_share": (ratio(F.col("same_provenance"), F.col("comparable")), enough & (F.col("same_provenance") > 0)),
        "unresolved_provenance_share": (ratio(F.col("unresolved"), F.col("n_subjects")), F.lit(True)),
        "stale_share": (ratio(F.col("stale"), F.col("n_claims")), F.col("staleness_computed"))}
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.when(ok, s).alias("share"),
                              F.when(ok & s.isNotNull(), _level(reg, m, s)).otherwise("info").alias("level"))
                     for m, (s, ok) in shares.items()])
    return facts.select(enough.alias("enough"), F.explode(rows).alias("r")).select("r.*", "enough")


def verdict(found: DataFrame) -> DataFrame:
    """Five-way verdict.  Too little external evidence is never support."""
    one = found.agg(F.bool_or(F.col("level") == "fail").alias("fail"), F.bool_or(F.col("level") == "caveat").alias("caveat"),
                    F.bool_and("enough").alias("enough"), F.count("*").alias("n"))
    return one.select(F.when(F.col("n") == 0, "cannot_assess").when(F.col("fail"), "concerns")
                      .when(~F.col("enough"), "not_established").when(F.col("caveat"), "supported_with_caveats")
                      .otherwise("supported").alias("verdict"))


def reliability_profile(counts: DataFrame | None, subjects: DataFrame | None, roots: DataFrame | None, fresh: DataFrame | None) -> DataFrame:
    """Long-form reliability dimensions; a dimension nothing was computed for is unavailable, not zero."""
    from functools import reduce

    def part(dimension: str, df: DataFrame | None, metrics: dict[str, Column], spark_df: DataFrame) -> DataFrame:
        if df is None:
            return spark_df.select(F.lit(dimension).alias("dimension"), F.lit(None).cast("string").alias("metric"),
                                   F.lit(None).cast("double").alias("value"), F.lit(False).alias("available"))
        one = df.agg(*[c.cast("double").alias(m) for m, c in metrics.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(dimension).alias("dimension"), F.lit(m).alias("metric"), F.col(m).alias("value"),
                                                       F.lit(True).alias("available")) for m in metrics])).alias("r")).select("r.*")

    present = next(d for d in (counts, subjects, roots, fresh) if d is not None)
    blank = present.sparkSession.range(1)
    multi = F.col("n_sources") >= 2
    parts = [
        part("data_quality", counts, {"input_records": F.max("n_input"), "valid_records": F.max("n_valid"), "rejected": F.max("n_rejected")}, blank),
        part("provenance", roots, {"roots_total": F.max("n_roots"), "roots_identified": F.max("n_identified"), "roots_unresolved": F.max("n_unresolved")}, blank),
        part("corroboration", subjects, {"single_source": F.count_if(~multi), "multi_source": F.count_if(multi)}, blank),
        part("consistency", subjects, {"exact": F.count_if(multi & (F.col("outcome") == "exact")),
                                       "hierarchical_refinement": F.count_if(multi & (F.col("outcome") == "hierarchical refinement")),
                                       "entity_type_conflict": F.count_if(multi & (F.col("outcome") == "entity-type conflict")),
                                       "licit_illicit_conflict": F.count_if(multi & (F.col("outcome") == "licit/illicit conflict")),
                                       "incomparable": F.count_if(multi & (F.col("outcome") == "incomparable"))}, blank),
        part("independence", subjects, {"apparent_multisource": F.count_if(multi), "one_root_only": F.count_if(multi & (F.col("n_roots") == 1))}, blank),
        part("currency", fresh, {"current": F.max(F.when(F.col("source").isNull(), F.col("current"))), "stale": F.max(F.when(F.col("source").isNull(), F.col("stale"))),
                                 "currency_unknown": F.max(F.when(F.col("source").isNull(), F.col("currency_unknown")))}, blank),
        part("verifiability", subjects, {"externally_comparable": F.count_if(multi), "unverifiable": F.count_if(~multi)}, blank)]
    return reduce(DataFrame.unionByName, parts)
