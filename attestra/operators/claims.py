"""Claim tables: stamping loaded observations, and building claims from validated rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, identifiers, labels, provenance
from ..functions.text import cell, strip
from ..registry import Registry

#: Fixed value: the columns of an observation table.
OBSERVATION = ["address", "source", "raw_label", "canon", "polarity", "prov_family", "lastmod", "heuristic", "subcat"]


def stamp(observations: DataFrame, reg: Registry) -> DataFrame:
    """Observations -> claims: the identifier without its source's marker, the subject, and the
    provenance root with its flags.  Needs ``claim_seq``; ``chain`` is optional."""
    df = observations
    if "chain" not in df.columns:
        df = df.withColumn("chain", F.lit(None).cast("string"))
    if "raw_address" not in df.columns:
        df = df.withColumn("raw_address", F.col("address"))
    df = df.withColumn("address", provenance.strip_source_prefix(reg, F.col("source"), F.col("address")))
    df = df.withColumn("subject", identifiers.subject_key(F.col("chain"), F.col("address")))
    return provenance.with_provenance(df, reg)


def claim_id() -> Column:
    """The same claim has the same id in every run."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "chain", "address", "raw_label", "prov_family")]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def tier(reg: Registry) -> Column:
    return evidence.evidence_tier(reg, F.col("prov_verified"), F.col("root"), F.col("heuristic"))


def claim_view(claims: DataFrame, reg: Registry) -> DataFrame:
    """What a reader sees of a claim."""
    return claims.select(
        "claim_seq", "subject", "address", "chain", "source", "canon", "raw_label", "polarity", "root",
        F.col("prov_kind").alias("root_kind"),
        provenance.provenance_status(F.col("prov_resolved"), F.col("prov_native")).alias("provenance"),
        tier(reg).alias("tier"), F.when(F.col("lastmod") != "", F.col("lastmod")).alias("lastmod"))


def recategorise_unknown(claims: DataFrame, reg: Registry) -> DataFrame:
    """Candidate build: only claims the source's own vocabulary left unknown are read again."""
    again = F.when(F.col("canon") == reg.unknown, labels.canonical_category(reg, F.col("raw_label")))
    return (claims.withColumn("rederived", again.isNotNull() & (again != reg.unknown))
            .withColumn("canon", F.when(F.col("canon") == reg.unknown, F.coalesce(again, F.lit(reg.unknown)))
                        .otherwise(F.col("canon")))
            .withColumn("polarity", labels.polarity_of(reg, F.col("canon"))))


def rederived_counts(claims: DataFrame, reg: Registry) -> DataFrame:
    return (recategorise_unknown(claims, reg).where("rederived")
            .groupBy("source", "canon").agg(F.count("*").alias("n_claims")))


def _mapped(mapping: dict, role: str) -> Column:
    return cell(F.col(f"`{mapping[role]}`")) if mapping.get(role) else F.lit("")


def declared_source(mapping: dict) -> Column:
    return _mapped(mapping, "source")


def build_claims(rows: DataFrame, mapping: dict, source_id: str, reg: Registry, default_heuristic: str = "unknown",
                 provenance_record: Column | None = None) -> DataFrame:
    """Validated rows -> one claim per row, or per label token of a row that lists several.

    ``rows`` carries ``row_id``, ``row_chain`` and ``tokens`` (ARRAY<STRUCT<pos, token>>, NULL when the
    row's own cell is the label) as validation leaves them.  The category column is read before the
    label column; a token replaces the cell it came from, which stays in ``label_cell``.
    """
    if source_id in reg.sources:
        raise ValueError(f"{source_id!r} is a known source; a new table may not take its provenance rule")
    exploded = rows.withColumn("_t", F.explode(F.coalesce(
        F.col("tokens"), F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("token"))))))
    token = F.col("_t.token")
    category, label = _mapped(mapping, "category"), _mapped(mapping, "label")
    chosen_category = F.when(token.isNotNull() & (category != ""), token).otherwise(category)
    chosen_label = F.when(token.isNotNull() & (category == ""), token).otherwise(label)
    raw = _mapped(mapping, "address")
    df = exploded.select(
        F.col("row_id").alias("record_id"), F.col("_t.pos").alias("_pos"), F.col("row_chain").alias("chain"),
        raw.alias("raw_address"),
        identifiers.canonical_identifier(reg, F.col("row_chain"), raw).alias("address"),
        F.lit(source_id).alias("source"), chosen_label.alias("raw_label"), chosen_category.alias("subcat"),
        F.when(token.isNotNull(), F.when(category != "", category).otherwise(label)).alias("label_cell"),
        declared_source(mapping).alias("prov_family"),
        evidence.normal_date(F.col(f"`{mapping['timestamp']}`")).alias("lastmod") if mapping.get("timestamp")
        else F.lit("").alias("lastmod"),
        _mapped(mapping, "actor").alias("actor"), _mapped(mapping, "entity").alias("entity"),
        _mapped(mapping, "confidence").alias("confidence_raw"), F.lit(default_heuristic).alias("heuristic"),
        *([provenance_record.alias("provenance_record")] if provenance_record is not None else []))
    declared = F.lower(F.col("prov_family"))
    df = labels.with_category(df, reg, ["subcat", "raw_label"])
    df = df.withColumns({
        "polarity": labels.polarity_of(reg, F.col("canon")),
        "source_url": F.when(declared.startswith("http://") | declared.startswith("https://"),
                             F.col("prov_family")).otherwise(""),
        "notes": F.when(F.coalesce("structured_entity", F.lit("")) != "",
                        F.concat(F.lit("structured_label_entity="), "structured_entity")).otherwise(""),
        # row order, then position in the row, as one exact number
        "claim_seq": (F.col("record_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_pos").cast("decimal(10,0)")).cast("decimal(38,0)")}).drop("_pos", "structured_entity")
    return stamp(df, reg).withColumn("claim_id", claim_id())


def filter_claims(claims: DataFrame, reg: Registry, *, source: str | None = None, canon: str | None = None,
                  evidence_tier: str | None = None, currency: str | None = None, provenance_is: str | None = None,
                  text: str | None = None, as_of=None) -> DataFrame:
    """Per-claim filters; each is a plain predicate the scan can take over."""
    df = claims
    if source:
        df = df.where(F.col("source") == source)
    if canon:
        df = df.where(F.col("canon") == canon)
    if provenance_is:
        df = df.where(provenance.provenance_status(F.col("prov_resolved"), F.col("prov_native")) == provenance_is)
    if evidence_tier:
        df = df.where(tier(reg) == evidence_tier)
    if currency:
        df = df.where(evidence.currency_status(reg, F.col("lastmod"), as_of) == currency)
    needle = (text or "").strip().lower()
    if needle:
        hay = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("address", "raw_label", "source")]
        df = df.where(hay[0].contains(needle) | hay[1].contains(needle) | hay[2].contains(needle))
    return df


def same_chain(claim_chain: Column, source_chain: Column) -> Column:
    """A reference source speaks about an identifier unless both state different chains."""
    return claim_chain.isNull() | source_chain.isNull() | (claim_chain == source_chain)


def snapshot_date(observations: DataFrame, declared: str | None = None) -> DataFrame:
    """One row with the day freshness is judged against: the declared day when it is a date, else
    the newest revision text of the table when that is one."""
    day = F.substring(strip(F.coalesce(F.col("lastmod"), F.lit(""))), 1, 10)
    newest = F.max(F.when(day != "", day))
    return observations.agg(F.coalesce(evidence.iso_day(F.lit(declared or "")),
                                       evidence.iso_day(newest)).alias("as_of"))
