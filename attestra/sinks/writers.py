"""Writing results: deterministic files, manifests, and exports that are safe to open."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.claims import OBSERVATION, claim_id

#: Fixed value: columns of the normalised-claims export.
EXPORT = ["claim_id", "address", "source", "raw_label", "canon", "polarity", "root", "heuristic", "confidence_raw", "lastmod",
          "chain", "entity", "label_cell"]


def formula_safe(c: Column) -> Column:
    """A cell a spreadsheet would run as a formula is written as text."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_cells(df: DataFrame) -> DataFrame:
    return df.select(*[formula_safe(F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_observations(rows: DataFrame, path: str, fmt: str = "parquet", partition_by_source: bool = False) -> None:
    """Same rows, same files: range-sorted by content, so the write stays parallel.  Partitioned by
    source it can be pruned; the sort keeps one address's rows together for later joins."""
    keys = ["claim_seq"] if fmt == "csv" and "claim_seq" in rows.columns else ["address", "source", "claim_seq"]
    df = rows.select("claim_seq", *OBSERVATION) if fmt == "parquet" else rows.select(*OBSERVATION, "claim_seq")
    df = df.orderBy(*[k for k in keys if k in df.columns])
    w = (df if fmt == "parquet" else df.drop("claim_seq")).write.mode("overwrite")
    if partition_by_source:
        w = w.partitionBy("source")
    if fmt == "csv":
        w = w.option("header", True).option("compression", "gzip").option("escape", '"')
    w.format(fmt).save(path)


def write_anchors(addresses: DataFrame, path: str) -> None:
    addresses.select("address").orderBy("address").write.mode("overwrite").option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A table as CSV with guarded cells; ``single`` only for a result already known to be small."""
    out = safe_cells(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small result table as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def claims_export(claims: DataFrame) -> DataFrame:
    """The normalised claims, thirteen columns, cells guarded."""
    df = claims if "claim_id" in claims.columns else claims.withColumn("claim_id", claim_id())
    cols = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in EXPORT]
    return safe_cells(df.select(*cols))


def manifest(rows: DataFrame, dropped: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Per-source claims, addresses and dropped rows, totals (source NULL), and warnings."""
    pairs = rows.groupBy("source", "address").agg(F.count("*").alias("n"))
    per = pairs.groupBy("source").agg(F.sum("n").alias("claims"), F.count("*").alias("addresses"))
    total = pairs.groupBy("address").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.count("*").alias("addresses")) \
        .select(F.lit(None).cast("string").alias("source"), "claims", "addresses")
    out = per.unionByName(total)
    out = out.join(dropped, "source", "full") if dropped is not None else out.withColumn("n_dropped", F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    out = out.select("source", F.coalesce("claims", zero).alias("claims"), F.coalesce("addresses", zero).alias("addresses"),
                     F.coalesce("n_dropped", zero).alias("dropped"), F.lit(None).cast("string").alias("warning"))
    if warnings is not None:
        out = out.unionByName(warnings.select("source", F.col("n_rows").alias("claims"), zero.alias("addresses"), zero.alias("dropped"), "warning"))
    return out


def as_one_object(parts: dict[str, DataFrame]) -> DataFrame:
    """Small result tables as one JSON object: ``parts`` are summaries of a few hundred rows at most."""
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")) for name, df in parts.items()]
    every = functools.reduce(DataFrame.unionByName, rows)
    return every.groupBy("part").agg(F.array_sort(F.collect_list("row")).alias("rows")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "rows"))))).alias("json"))
