"""Looking into a corpus: the index of comparable subjects, pages, filters, one subject explained."""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, provenance
from ..functions.text import lookup
from ..registry import Registry
from ..session import written
from . import claims as claim_ops
from .subjects import KIND_OF_OUTCOME, flags_and_tier, source_lists, subject_table

LISTED_KINDS = ["polarity", "entity", "hierarchical", "incomparable"]


def subject_index(claims: DataFrame, reg: Registry) -> DataFrame:
    """Every comparable subject (two or more sources) with its outcome, relationship and sources.
    The table behind conflict pages and subject filters; write it once and query it."""
    table = subject_table(claims, reg, ["subject", "address", "chain"]).where("n_sources >= 2")
    return (table.join(source_lists(claims), "subject")         # one row per subject on both sides
            .withColumn("kind", lookup(KIND_OF_OUTCOME, F.col("outcome")))
            .select("subject", "address", "chain", "outcome", "kind", "circular", "relationship", "n_sources", "confirmed_roots",
                    "unresolved_sources", "sources"))


def target_index(audited: DataFrame) -> DataFrame:
    """The same shape from audited subjects that have a reference match."""
    return (audited.where("reference_sources > 0").withColumn("kind", lookup(KIND_OF_OUTCOME, F.col("outcome")))
            .select("subject", "address", "chain", "outcome", "kind", "circular", "relationship", "n_sources", "confirmed_roots",
                    "unresolved_sources"))


def kind_counts(index: DataFrame) -> DataFrame:
    from .subjects import count_named
    return count_named(index, "kind", ["exact"] + LISTED_KINDS).select("kind", "n")


def filter_by_subject(claims: DataFrame, index: DataFrame, outcome: str | None = None, comparable: str | None = None) -> DataFrame:
    """Keep claims by what is known of their subject; ``single-source`` means not in the index."""
    if outcome == "single-source" or comparable == "no":
        claims = claims.join(index.select("subject"), "subject", "left_anti")
    if outcome and outcome != "single-source":
        claims = claims.join(index.where(F.col("outcome") == outcome).select("subject"), "subject", "left_semi")
    if comparable == "yes":
        claims = claims.join(index.select("subject"), "subject", "left_semi")
    return claims


def filter_conflicts(index: DataFrame, kind: str | None = None, source_a: str | None = None, source_b: str | None = None,
                     relationship: str | None = None, text: str | None = None) -> DataFrame:
    df = index.where(F.col("kind").isin(LISTED_KINDS) if kind in (None, "", "all") else F.col("kind") == kind)
    for s in (source_a, source_b):
        if s:
            df = df.where(F.array_contains("sources", s))
    if relationship:
        df = df.where(F.col("relationship") == relationship)
    if text and text.strip():
        df = df.where(F.lower("address").contains(text.strip().lower()))
    return df


def page(df: DataFrame, order: list[str], offset: int, limit: int, after: dict | None = None) -> DataFrame:
    """One page of ``limit`` rows in a stated order.  ``after`` (the order columns of the last row seen) continues from there by a
    filter, so a deep page costs what the first one does; an ``offset`` is for shallow pages only."""
    if limit < 1 or offset < 0:
        raise ValueError(f"no page has {limit} rows from row {offset} on")
    df = df if after is None else df.where(_beyond(order, after))
    return df.orderBy(*order).offset(offset).limit(limit)


def _beyond(order: list[str], after: dict) -> Column:
    out, tied = F.lit(False), F.lit(True)
    for c in order:
        out = out | (tied & (F.col(c) > F.lit(after[c])))
        tied = tied & (F.col(c) == F.lit(after[c]))
    return out


def claims_page(claims: DataFrame, reg: Registry, offset: int = 0, limit: int = 100, after: dict | None = None) -> DataFrame:
    view = claim_ops.claim_view(claims, reg).withColumn("chain", F.coalesce("chain", F.lit("")))
    return page(view, ["address", "chain", "source", "claim_seq"], offset, limit, after)


def conflicts_page(index: DataFrame, reg: Registry, offset: int = 0, limit: int = 50, after: dict | None = None, **filters) -> DataFrame:
    return page(filter_conflicts(index, **filters), ["subject"], offset, limit, after)


@dataclass(frozen=True)
class Pages:
    """A table in a stated order, cut into parts of known length, so that a page anywhere reads the part or parts it lies in.

    ``starts`` holds the rows before each part and, last, all rows: one number per part of the table, on the driver."""
    rows: DataFrame
    order: tuple[str, ...]
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the whole order; fewer, or none, where the table ends."""
        if limit < 1 or offset < 0:
            raise ValueError(f"no page has {limit} rows from row {offset} on")
        offset = min(offset, self.total)
        first = max(bisect_right(self.starts, offset) - 1, 0)
        last = max(bisect_right(self.starts, min(offset + limit, self.total) - 1) - 1, first)
        read = self.rows.where(F.col(PART).between(first, last)).drop(PART)
        return read.orderBy(*self.order).offset(offset - self.starts[first]).limit(limit)


PART = "page_part"


def pages(df: DataFrame, order: list[str], rows_per_part: int = 1_000_000) -> Pages:
    """Writes ``df`` once, dealt by ranges of ``order``, and counts each range.

    Ranges come from a sample of the keys and so are of about ``rows_per_part`` rows, however the keys are distributed, as long as the
    order tells rows apart; rows that tie in all of it stay in one part.  Nulls come first, an empty table has no page with rows."""
    if PART in df.columns:
        raise ValueError(f"{PART} is the name of the part a row lies in")
    n = -(-df.count() // rows_per_part)
    if n == 0:
        return Pages(df.withColumn(PART, F.lit(0)).limit(0), tuple(order), (0,))
    ranged = df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    rows = written(ranged.sortWithinPartitions(PART, *order), None, (PART,))
    counts = {r[PART]: r["n"] for r in rows.groupBy(PART).agg(F.count("*").alias("n")).collect()}       # a row per part
    return Pages(rows, tuple(order), tuple(accumulate((counts.get(i, 0) for i in range(n)), initial=0)))


def claims_pages(claims: DataFrame, reg: Registry, rows_per_part: int = 1_000_000) -> Pages:
    view = claim_ops.claim_view(claims, reg).withColumn("chain", F.coalesce("chain", F.lit("")))
    return pages(view, ["address", "chain", "source", "claim_seq"], rows_per_part)


def page_totals(claims: DataFrame) -> DataFrame:
    """What a page header states: claims and distinct subjects behind the filters."""
    per_subject = claims.groupBy("subject").agg(F.count("*").alias("n"))
    return per_subject.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_claims"), F.count("*").alias("n_subjects"))


def conflict_export(claims: DataFrame, index: DataFrame, reg: Registry) -> DataFrame:
    """One row per claim at each listed subject."""
    listed = filter_conflicts(index).select("subject", "kind", "outcome", F.col("relationship").alias("provenance_relationship"))
    view = claim_ops.claim_view(claims, reg)
    return (view.join(listed, "subject")
            .select("address", "kind", "outcome", "provenance_relationship", "source", "canon", "raw_label", "polarity", "root",
                    "root_kind", "provenance", F.coalesce("lastmod", F.lit("")).alias("lastmod"), F.coalesce("chain", F.lit("")).alias("chain")))


def by_address(claims: DataFrame, row_group_bytes: int = 16 << 20) -> DataFrame:
    """The claims laid out for questions about one identifier: ranges of addresses, so that least and largest values exclude most files and
    row groups, and a Bloom filter that excludes those in between.  ``claim_seq`` divides an address with very many claims."""
    ranged = claims.repartitionByRange("address", "claim_seq").sortWithinPartitions("address", "claim_seq")
    return written(ranged, **{"parquet.bloom.filter.enabled#address": "true", "parquet.block.size": str(row_group_bytes)})


def ambiguous_identifiers(claims: DataFrame) -> DataFrame:
    """Identifiers that the table states on several chains, with those chains: each is more than one subject."""
    stated = claims.where(F.coalesce("chain", F.lit("")) != "").groupBy("address", "chain").agg(F.count("*").alias("n"))
    return (stated.groupBy("address").agg(F.count("*").alias("n_chains"), F.array_sort(F.collect_list("chain")).alias("chains"), F.sum("n").alias("n_claims"))
            .where("n_chains > 1"))


def chains_of(claims: DataFrame, address: str) -> DataFrame:
    """The chains a table states an identifier on: more than one means more than one subject."""
    return claims.where((F.col("address") == address) & (F.coalesce("chain", F.lit("")) != "")).select("chain").distinct()


def explain(claims: DataFrame, reg: Registry, address: str, as_of: Column, chain: str | None = None,
            reference: DataFrame | None = None) -> DataFrame:
    """Everything known about one identifier.  The filter reaches the scan, so only its claims are read.

    Without a chain, an identifier stated on several is answered as ambiguous, never merged."""
    here = claims.where(F.col("address") == address)
    if chain is not None:
        here = here.where(F.col("chain").isNull() | (F.col("chain") == chain))
    n_chains = here.agg(F.count_distinct(F.when(F.coalesce("chain", F.lit("")) != "", F.col("chain"))).alias("n_chains"),
                        F.array_sort(F.collect_set("chain")).alias("chains"),
                        F.count("*").alias("n_own"), F.max("chain").alias("_chain"),
                        F.count_if(F.col("canon") != reg.unknown).alias("n_own_known"))
    both = here
    if reference is not None:
        theirs = reference.where(F.col("address") == address)
        if chain is not None:
            theirs = theirs.where(claim_ops.same_chain(F.lit(chain), provenance.source_chain(reg, F.col("source"))))
        both = here.unionByName(theirs, allowMissingColumns=True)
    one = flags_and_tier(both.withColumn("subject", F.lit(address)), reg, as_of)
    roots = both.agg(F.array_sort(F.collect_set("root")).alias("roots"), F.array_sort(F.collect_set("source")).alias("datasets"))
    df = n_chains.join(roots).join(one, F.lit(True), "left")              # one row each
    silent = (F.col("n_own") > 0) & (F.col("n_own_known") == 0) if reference is not None else F.lit(False)
    outcome = (F.when(F.col("n_sources") < 2, "single-source").when(silent, "incomparable").otherwise(F.col("outcome")))
    return df.select(F.lit(address).alias("address"), (F.col("n_chains") > 1).alias("ambiguous"), "chains",
                     (F.col("n_claims").isNotNull() & (F.col("n_chains") <= 1)).alias("found"), "n_claims", "datasets", "roots",
                     F.col("n_sources").alias("apparent_corroboration"), F.col("confirmed_roots").alias("actual_corroboration"),
                     "circular", outcome.alias("outcome"), "tier", "flags", "independence_min", "independence_max")


def claims_at(claims: DataFrame, reg: Registry, address: str, as_of: Column) -> DataFrame:
    """The claims behind an explanation, each with its currency."""
    here = claim_ops.claim_view(claims.where(F.col("address") == address), reg)
    return here.withColumn("currency", evidence.currency_status(reg, F.coalesce("lastmod", F.lit("")), as_of))
