"""Row validation: every input row ends up valid or rejected with exactly one reason.

"First occurrence" is a minimum over row ids, which combines on the map side, so a row or claim
repeated millions of times never gathers in one task the way a window over the copies would.

Rows move once, to meet their copies, and what moves at a time is bounded: large tables are read in slices of about ``SLICE`` rows by
a hash, and what a slice shuffled goes when its part is written.  From then on claims are a digest and a token, and only rows that may
be valid meet the tokens they are the first to state.
"""
from __future__ import annotations

import functools
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.text import cell, ratio
from ..registry import Registry
from ..session import written
from .claims import declared_source

#: Fixed value: reasons in the order they are tested.
REASONS = ["duplicate row", "empty address", "unresolved chain", "invalid address", "missing label", "duplicate claim"]
#: rows that are shuffled at a time, about
SLICE = 50_000_000


@dataclass
class Validation:
    rows: DataFrame          # the input
    judged: DataFrame        # first occurrence of every distinct row, with its reason (NULL = valid)

    @property
    def valid(self) -> DataFrame:
        """Valid rows with ``row_chain`` and ``tokens`` (NULL unless the label cell was split)."""
        return self.judged.where("reason IS NULL")

    @property
    def duplicates(self) -> DataFrame:
        return self.rows.select("row_id").join(self.judged.select("row_id"), "row_id", "left_anti")

    @property
    def rejected(self) -> DataFrame:
        """row_id, reason, address, chain of every row that did not become a claim."""
        judged = self.judged.where("reason IS NOT NULL").select(
            "row_id", "reason", F.when(F.col("reason") != REASONS[1], F.col("_address")).alias("address"),
            F.when(F.col("reason").isin(REASONS[3], REASONS[5]), F.col("row_chain")).alias("chain"))
        none = F.lit(None).cast("string")
        return judged.unionByName(self.duplicates.select("row_id", F.lit(REASONS[0]).alias("reason"),
                                                         none.alias("address"), none.alias("chain")))

    def reasons(self) -> DataFrame:
        """Rows per outcome ('valid' included): adds up to the input."""
        return self.judged.groupBy("reason").agg(F.count("*").alias("first"), F.sum("copies").alias("all")).select(
            F.explode(F.array(
                F.struct(F.coalesce("reason", F.lit("valid")).alias("outcome"), F.col("first").alias("n")),
                F.struct(F.lit(REASONS[0]).alias("outcome"), (F.col("all") - F.col("first")).alias("n")))).alias("r")) \
            .select("r.*").groupBy("outcome").agg(F.sum("n").alias("n_rows")).where("n_rows > 0")

    def counts(self) -> DataFrame:
        """One row of totals, from the same table."""
        r, ok = F.col("reason"), F.col("reason").isNull()
        checked = F.col("checked")
        return self.judged.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("n_input"), F.count_if(ok).alias("n_valid"),
            F.coalesce(F.sum(F.when(ok, F.col("n_tokens"))), F.lit(0)).cast("bigint").alias("n_claims"),
            F.count_if(checked).alias("n_checked"), F.count_if(r == REASONS[3]).alias("n_invalid"),
            F.count_if(r == REASONS[1]).alias("n_empty_address"),
            F.count_if(checked & F.coalesce(r != REASONS[3], F.lit(True)) & F.col("trimmed")).alias("n_trimmed")) \
            .withColumn("n_rejected", F.col("n_input") - F.col("n_valid")) \
            .withColumn("valid_identifier_share", ratio(F.col("n_checked") - F.col("n_invalid"), F.col("n_checked")))

    def per_chain(self) -> DataFrame:
        bad = F.count_if(F.col("reason") == REASONS[3])
        return (self.judged.where("checked").groupBy(F.col("row_chain").alias("chain"))
                .agg(F.count("*").alias("checked"), bad.alias("invalid"), F.count_if(F.col("reason").isNull()).alias("valid_rows"))
                .withColumn("valid_share", ratio(F.col("checked") - F.col("invalid"), F.col("checked"))))

    def checksum_states(self, reg: Registry) -> DataFrame:
        return (self.judged.where(F.col("checked") & F.col("row_chain").isin(reg.evm_chains))
                .groupBy(F.col("row_chain").alias("chain"), F.coalesce("state", F.lit("not_an_address")).alias("state"))
                .agg(F.count("*").alias("n_rows")))

    def limitations(self, reg: Registry) -> DataFrame:
        """Chains most of whose identifiers failed, and chains without any checksum to check."""
        floor = float(reg.intake["min_valid_rate"])
        failing = (self.per_chain().where(ratio(F.col("invalid"), F.col("checked")) > 1 - floor)
                   .select("chain", F.lit("identifiers_failed").alias("limitation"), F.col("invalid").alias("n_rows")))
        s = self.checksum_states(reg).groupBy("chain").agg(
            *[F.coalesce(F.sum(F.when(F.col("state") == v, F.col("n_rows"))), F.lit(0)).alias(v)
              for v in ("not_encoded", "valid", "invalid")])
        bare = s.where("not_encoded > 0 AND valid = 0 AND invalid = 0").select(
            "chain", F.lit("no_checksum_encoded").alias("limitation"), F.col("not_encoded").alias("n_rows"))
        wrong = s.where("invalid > 0").select("chain", F.lit("checksum_failed").alias("limitation"), F.col("invalid").alias("n_rows"))
        return failing.unionByName(bare).unionByName(wrong)


def label_tokens(text: Column, multi_label: dict | None, reg: Registry) -> Column:
    """The tokens of a label cell if the column was found to hold lists and this cell is one."""
    whole = F.array(text)
    if not multi_label or multi_label.get("status") != "multi_label":
        return whole
    parts = F.split(text, r"\Q" + multi_label["separator"] + r"\E", -1)
    pattern = r"\A(?:" + reg.intake["multi_label"]["token"] + r")\z"
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(pattern)), parts).otherwise(whole)


def digest(*cells: Column) -> Column:
    """16 bytes that stand for text cells, null ones too."""
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])))


def _slices(df: DataFrame, by: list[str], slices: int) -> list[DataFrame]:
    """The rows in so many tables; those that agree in ``by`` are in one."""
    return [df] if slices == 1 else [df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(slices)) == i) for i in range(slices)]


def _kept(parts: list[DataFrame], keep: bool) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [written(p, compression="zstd") if keep else p for p in parts])


def validate(rows: DataFrame, mapping: dict, reg: Registry, default_chain: str | None = None, dedupe: bool = True, multi_label: dict | None = None,
             single_label: bool = False, keep: bool = True, carry: Collection[str] | None = None) -> Validation:
    """Judge every row of ``rows`` (a unique ``row_id`` and text cells).

    A blank chain cell falls back to ``default_chain``; a chain name that resolves to nothing is
    rejected, never replaced.  A row with several labels is a duplicate only when none is new.
    ``single_label`` reads the mapped category, or else label, column alone (joined tables).
    ``keep`` writes the rows with their first tests to the shared folder, so identifiers are checked once.
    ``carry`` names the cells that the judged rows still have (all, if not given); without the address no list of rejected rows can be made.
    """
    if default_chain is None and not mapping.get("chain"):
        raise ValueError("address validation needs a chain: none was given or mapped")
    cells = [c for c in rows.columns if c != "row_id"]
    raw = F.coalesce(F.col(f"`{mapping['address']}`"), F.lit("")) if mapping.get("address") else F.lit("")
    chain = F.lit(default_chain).cast("string")
    if mapping.get("chain"):
        stated = cell(F.col(f"`{mapping['chain']}`"))
        chain = F.when(stated != "", identifiers.resolve_chain(reg, stated)).otherwise(chain)
    fields = [mapping[r] for r in ("category", "label") if mapping.get(r)]
    fields = fields[:1] if single_label else fields
    label, split_cell = F.lit(""), F.lit(False)
    for f in reversed(fields):
        here = cell(F.col(f"`{f}`"))
        split_cell = F.when(here != "", F.lit(bool(multi_label) and multi_label.get("column") == f)).otherwise(split_cell)
        label = F.when(here != "", here).otherwise(label)
    own = [c for c in cells if carry is None or c in carry]
    listed = F.size("_tokens") > 1

    def tested(first: DataFrame) -> DataFrame:
        df = first.withColumns({"_address": cell(raw), "row_chain": chain, "_label": label, "_split": split_cell})
        df = df.withColumn("trimmed", F.col("_address") != raw)
        df = df.withColumn("state", identifiers.checksum_state(F.when(F.col("row_chain").isin(reg.evm_chains), F.col("_address"))))
        valid = F.when(F.col("row_chain").isin(reg.evm_chains), F.coalesce(F.col("state").isin("not_encoded", "valid"), F.lit(False))) \
            .otherwise(identifiers.address_valid(reg, F.col("row_chain"), F.col("_address"), without=("evm",)))
        df = df.withColumns({"_ok": valid, "checked": (F.col("_address") != "") & F.col("row_chain").isNotNull()})
        reason = (F.when(F.col("_address") == "", REASONS[1]).when(F.col("row_chain").isNull(), REASONS[2])
                  .when(~F.col("_ok"), REASONS[3]))
        if fields:
            reason = reason.when(F.col("_label") == "", REASONS[4])
        tokens = F.when(F.col("_split"), label_tokens(F.col("_label"), multi_label, reg)).otherwise(F.array("_label"))
        # what a claim says beside its token
        base = digest(F.col("row_chain"), identifiers.canonical_identifier(reg, F.col("row_chain"), F.col("_address")), declared_source(mapping))
        df = df.withColumns({"reason": reason, "_tokens": tokens}).withColumn("_base", F.when(F.col("reason").isNull(), base))
        return df.select("row_id", *[F.col(f"`{c}`") for c in own], "copies", "row_chain", "trimmed", "state", "checked", "reason", "_tokens", "_base")

    def finished(df: DataFrame) -> DataFrame:
        return df.withColumn("_address", cell(raw)) if not mapping.get("address") or mapping["address"] in own else df

    if not dedupe:
        df = tested(rows.withColumn("copies", F.lit(1).cast("bigint")))
        df = finished(_kept([df], keep))
        taken = F.transform("_tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
        return Validation(rows, _tidy(df.withColumn("tokens", F.when(listed, taken)).withColumn("n_tokens", F.size("_tokens"))))
    slices = max(1, -(-rows.count() // SLICE)) if keep else 1
    # the group keys are the row, so the first occurrence is the aggregate's own output
    df = _kept([tested(part.groupBy(*[F.col(f"`{c}`") for c in cells]).agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies")))
                for part in _slices(rows, cells, slices)], keep)
    # the row that states a claim first; a row without an id is never later than another
    claims = df.where("reason IS NULL").select("row_id", "_base", F.explode(F.array_distinct("_tokens")).alias("token"))
    firsts = _kept([part.groupBy("_base", "token").agg(F.min("row_id").alias("row_id")).where("row_id IS NOT NULL").select("row_id", "token")
                    for part in _slices(claims, ["_base", "token"], slices)], keep)
    won = firsts.groupBy("row_id").agg(F.collect_list("token").alias("_won"))             # tokens of one row
    df = finished(df)
    good = df.where("reason IS NULL").join(won, "row_id", "left")
    stated = F.array_distinct("_tokens")
    new = F.when(F.col("row_id").isNull(), stated).otherwise(F.array_intersect(stated, F.coalesce("_won", F.array().cast("array<string>"))))
    good = good.withColumn("_new", F.when(F.size(new) > 0, new))
    taken = F.array_sort(F.transform("_new", lambda t: F.struct((F.array_position(F.col("_tokens"), t) - F.lit(1)).cast("int").alias("pos"),
                                                                t.alias("token"))))
    good = good.withColumns({"reason": F.when(F.col("_new").isNull(), REASONS[5]), "tokens": F.when(listed, taken),
                             "n_tokens": F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new"))})
    bad = df.where("reason IS NOT NULL").withColumns({"tokens": F.lit(None).cast(good.schema["tokens"].dataType), "n_tokens": F.lit(0)})
    return Validation(rows, _tidy(bad).unionByName(_tidy(good)))


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop("_tokens", "_base", "_won", "_new")


def passes_floor(counts: DataFrame, reg: Registry) -> DataFrame:
    """May the table be analysed at all?  The share of valid identifiers over every checked row."""
    floor = float(reg.intake["min_valid_rate"])
    return counts.select("n_checked", "n_invalid", "valid_identifier_share",
                         F.coalesce(F.col("valid_identifier_share") >= floor, F.lit(False)).alias("passes"))
