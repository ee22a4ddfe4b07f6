"""Generated metrics against declared values, with the stated rounding and nothing implicit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparison rules and claim classes.
RULES = ["exact_integer", "exact_string", "rounded_percent", "rounded_decimal", "range", "approximate_text"]
CLASSES = ["HEADLINE_STABLE", "SUPPORTING_STABLE", "DIAGNOSTIC", "SENSITIVITY", "LIMITATION"]
QUIET = ["DIAGNOSTIC", "SENSITIVITY"]
DECLARED = ("id string, metric string, class string, comparison string, expected string, min string, max string, "
            "decimals int, scale double, experiment string, machine_checkable boolean")
_DEC = "decimal(38,12)"


def _number(text: Column) -> Column:
    return text.cast("string").try_cast("double").cast("string").try_cast(_DEC)


def _half_up(x: Column, decimals: Column) -> Column:
    """Decimal rounding half up to a per-row number of places."""
    places = F.pow(F.lit(10), F.coalesce(decimals, F.lit(0))).cast("decimal(20,0)")
    return F.round(x.cast("decimal(38,12)") * places, 0) / places


def verify(metrics: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per declared claim: PASS / FAIL / NOT_REPRODUCED / INFORMATIONAL / NOT_MACHINE_CHECKABLE."""
    # declared values are written by hand: the small side, and the one every row of which is kept
    df = declared.join(metrics.select(F.col("key").alias("metric"), F.col("value").cast("string").alias("generated"), "basis"), "metric", "left")
    g, e = _number(F.col("generated")), _number(F.col("expected"))
    rule, places = F.col("comparison"), F.col("decimals")
    scaled = g * F.when(rule == "rounded_percent", F.lit(100)).otherwise(F.coalesce("scale", F.lit(1.0))).cast("decimal(20,6)")
    wanted = e * F.when(rule == "rounded_percent", F.lit(100)).otherwise(F.lit(1)).cast("decimal(20,6)")
    lo, hi = _number(F.col("min")), _number(F.col("max"))
    ok = (F.when(rule == "exact_string", F.col("generated") == F.col("expected"))
          .when(g.isNull(), F.lit(False))
          .when(rule == "exact_integer", F.round(g, 0) == e)
          .when(rule.isin("rounded_percent", "rounded_decimal", "approximate_text"), _half_up(scaled, places) == _half_up(wanted, places))
          .when(rule == "range", (lo.isNull() | (g >= lo)) & (hi.isNull() | (g <= hi))))
    ok = F.coalesce(ok, F.lit(False))
    nothing_declared = F.col("expected").isNull() & F.col("min").isNull() & F.col("max").isNull()
    status = (F.when(~F.col("class").isin(CLASSES), "FAIL")
              .when(~F.coalesce("machine_checkable", F.lit(True)), "NOT_MACHINE_CHECKABLE")
              .when(F.col("basis").isNull(), F.when(F.col("class").isin(QUIET), "NOT_REPRODUCED").otherwise("FAIL"))
              .when(nothing_declared, "INFORMATIONAL")
              .when(~rule.isin(RULES), "FAIL")
              .when(F.col("basis") == "UNAVAILABLE", "NOT_REPRODUCED")
              .when(F.col("basis") == "LIVE", F.when(ok, "PASS").otherwise("FAIL"))
              .when(~ok & (F.col("basis") == "FROZEN_MANIFEST"), "FAIL").otherwise("NOT_REPRODUCED"))
    return df.withColumns({"status": status, "delta": F.when(rule == "exact_integer", (g - e).cast("double"))}).select(
        "id", "metric", "class", "comparison", "expected", "generated", "basis", "experiment", "status", "delta")


def class_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("class", "status").agg(F.count("*").alias("n"))


def overall(verified: DataFrame) -> DataFrame:
    """FAIL, BLOCKED or PASS: quiet classes never decide it."""
    loud = ~F.col("class").isin(QUIET)
    one = verified.agg(F.coalesce(F.bool_or(loud & (F.col("status") == "FAIL")), F.lit(False)).alias("failing"),
                       F.coalesce(F.bool_or(loud & (F.col("status") == "NOT_REPRODUCED")), F.lit(False)).alias("blocked"))
    return one.select(F.when(F.col("failing"), "FAIL").when(F.col("blocked"), "BLOCKED").otherwise("PASS").alias("status"))


def experiment_status(verified: DataFrame) -> DataFrame:
    has = {s: F.bool_or(F.col("status") == s) for s in ("FAIL", "NOT_REPRODUCED", "PASS", "NOT_MACHINE_CHECKABLE")}
    return verified.groupBy(F.coalesce("experiment", F.lit("(none)")).alias("experiment")).agg(
        F.count("*").alias("n_claims"),
        F.when(has["FAIL"], "FAIL").when(has["NOT_REPRODUCED"], "NOT_REPRODUCED").when(has["PASS"], "PASS")
        .when(has["NOT_MACHINE_CHECKABLE"], "NOT_MACHINE_CHECKABLE").otherwise("INFORMATIONAL").alias("status"))


def group_status(experiments: DataFrame, ids: list[str]) -> DataFrame:
    mine = experiments.where(F.col("experiment").isin(ids))
    return mine.agg(F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "NOT_REPRODUCED"), "NOT_REPRODUCED")
                    .when(F.bool_or(F.col("status") == "PASS"), "PASS").otherwise("NOT_MACHINE_CHECKABLE").alias("status"))
