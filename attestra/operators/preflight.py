"""May tables be audited, and how: decisions over the evidence of their columns.

Any number of tables are surveyed at once, with the table as a further key from the scan on.  Their cells are reduced to one row of evidence per
column; each column is scored against each meaning (a table of columns x meanings), the best offers are taken in order, and one row per table
says what kind of table it is and what stands in the way.  All of that is DataFrames the size of the schemas.  Where a decision
needs a second look at the rows (identifiers under the chain their row states, lists of labels, classes of sources), the tables it concerns
are read once more, together.  A user's choices replace scores, never checks.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profiling
from ..registry import Registry
from ..session import written

#: Fixed value: what each dataset type amounts to.
STATE_OF_TYPE = {"attribution_claims": "supported_attribution_data",
                 "unsupported_subject_kind": "attribution_like_schema_unresolved",
                 "unsupported_chain_attribution": "attribution_like_schema_unresolved",
                 "attribution_like_unresolved": "attribution_like_schema_unresolved",
                 "mapping_unresolved": "schema_unresolved", "market_timeseries": "not_attribution_data",
                 "crypto_non_attribution": "not_attribution_data", "non_crypto": "not_attribution_data"}
NUMERIC_REST, NO_PART, DATE_REST, CANDLE, MARKET = "numeric_unclassified", "unmapped", "ts_unclassified", "ts_market_candle", "market_numeric"
MEANINGS = "place int, meaning string, test string, role string, shared boolean, whole array<string>, words array<string>, slot string, kind string, never_identifier boolean, unnamed boolean, strict boolean"
SCHEMA = "table string, position int, column string, plain string, chosen string, said_chain string, family string"


@dataclass
class Part:
    """The part one column plays."""
    column: str
    meaning: str
    confidence: float | None
    status: str
    origin: str
    rejected_as_subject: bool = False

    @property
    def usable(self) -> bool:
        return self.status != "invalid"


@dataclass
class Preflight:
    """What was established about a table, and whether it may be audited."""
    n_rows: int
    columns: list[Part]
    subject: str | None
    subject_kind: str | None
    chain: str | None
    chain_status: str
    chain_rates: dict[str, float]
    dataset_type: str
    status: str
    blockers: list[str]
    mapping: dict[str, str | None]
    currency_basis: str | None
    label_structure: dict
    warnings: list[str] = field(default_factory=list)
    established: list[str] = field(default_factory=list)

    @property
    def can_analyse(self) -> bool:
        return self.status == "ready"

    @property
    def dataset_state(self) -> str:
        return STATE_OF_TYPE[self.dataset_type]


@dataclass
class Survey:
    """``parts``: a row per column; ``tables``: a row per table; ``choices``: a row per choice of the user, with what speaks against it."""
    parts: DataFrame
    tables: DataFrame
    choices: DataFrame


def slot(meaning: str) -> str:
    """Meanings of which a table has at most one share a slot."""
    return "subject" if meaning.startswith("subject_") else meaning


def _meanings(spark, reg: Registry) -> DataFrame:
    c = reg.intake
    return spark.createDataFrame([(i, m, t, r, s, w, k, slot(m), t.partition(":")[2] or None, m in c["never_identifiers"], m in c["from_values_alone"], m in c["strict_values"])
                                  for i, (m, (t, r, s, w, k)) in enumerate(c["meanings"].items())], MEANINGS)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ evidence
def evidence(tables: dict[str, DataFrame], reg: Registry, choices: dict[str, dict[str, str]] | None = None, chains: dict[str, str] | None = None) -> DataFrame:
    """One row per table and column of all tables (``row_id`` plus text columns): its profile, what it may be, and the user's choice."""
    c, spark = reg.intake, next(iter(tables.values())).sparkSession
    cells = _union([profiling.column_cells(df).select(F.struct(F.lit(t).alias("table"), "column").alias("column"), "row_id", "value") for t, df in tables.items()])
    profiles = written(profiling.column_profiles(cells, reg).withColumns({"table": F.col("column")["table"], "column": F.col("column")["column"]}))
    choices, chains = choices or {}, chains or {}
    schema = spark.createDataFrame([(t, i, x, profiling.normal_name(x), choices.get(t, {}).get(x), chains.get(t), reg.chains[chains[t]]["family"] if t in chains else None)
                                    for t, df in tables.items() for i, x in enumerate(x for x in df.columns if x != "row_id")], SCHEMA)
    share = lambda x, least: (F.col("n") > 0) & (F.coalesce(x, F.lit(0.0)) >= c[least])
    named = lambda hints: F.lower("column").rlike("|".join(c[hints]))
    best = lambda check: F.greatest(F.lit(0.0), *(F.when(F.coalesce(F.col("family") == f, F.lit(True)), F.col(f"{check}_{f}")) for f in sorted({s["family"] for s in reg.chains.values()})))
    facts = schema.join(profiles, ["table", "column"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "counter": F.coalesce("counter", F.lit(False))})
    facts = facts.withColumns({"is_number": share(F.col("numeric"), "number_share"), "is_date": share(F.col("date"), "date_share"), "best_address": best("address"), "best_transaction": best("transaction"),
                               "address_named": named("address_name_hints"), "asset_named": named("asset_name_hints")})
    market = F.size(F.collect_set(F.when(F.col("is_number") & F.col("plain").isin(c["market"]["columns"]), F.col("plain"))).over(Window.partitionBy("table")))
    return facts.withColumns({"is_identifier": (F.col("n") > 0) & ~F.col("counter") & ~F.col("is_number") & (F.col("best_address") >= c["min_valid_rate"]),
                              "is_market": market >= c["market"]["at_least"]})


def value_tests(reg: Registry) -> dict[str, Column]:
    """How well the values of a column pass each test; a name that fits lets a source be text as well."""
    number = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    fit = lambda how: F.lit(how["fixed_score"]) if how["check"] is None else F.when(F.col("is_number"), 0.0).otherwise(F.col(f"best_{how['check']}"))
    return {**{f"subject:{k}": F.when(F.col("counter"), 0.0).otherwise(fit(how)) for k, how in reg.intake["subject_kinds"].items()},
            "date": number("date"), "number": number("numeric"), "text": number("text"), "chain": number("chain_named"),
            "source": number("url"), "source, named": F.least(F.lit(1.0), number("url") + number("text")),
            "grade": (F.col("is_number") | (number("graded") >= reg.intake["number_share"])).cast("double")}


def scores(facts: DataFrame, reg: Registry) -> DataFrame:
    """(table, column, meaning, name, value, as_chosen, confidence) of every column and meaning.  ``as_chosen`` is the value score under a user's choice,
    which counts the name as right."""
    c, w = reg.intake, reg.intake["weights"]
    tests = F.map_from_arrays(*(F.array(*x) for x in zip(*((F.lit(k), v) for k, v in value_tests(reg).items()))))
    both = facts.withColumn("tests", tests).crossJoin(F.broadcast(_meanings(facts.sparkSession, reg)))          # columns x meanings
    name = (F.when(F.array_contains("whole", F.col("plain")), c["name_score"]["whole"])
            .when(F.arrays_overlap(F.split("plain", "_"), F.col("words")), c["name_score"]["word"]).otherwise(0.0))
    shape = F.when(F.col("meaning") == CANDLE, "date").when(F.col("meaning").isin(MARKET, NUMERIC_REST), "number").otherwise(F.col("test"))
    void = (F.col("n") == 0) | (F.col("never_identifier") & F.col("is_identifier"))
    passed = lambda named: F.when(void, 0.0).otherwise(F.coalesce(F.element_at("tests", F.when(named & (shape == "source"), "source, named").otherwise(shape)), F.lit(0.0)))
    return (both.withColumn("name", name).withColumns({"value": passed(F.col("name") > 0), "as_chosen": passed(F.lit(True))})
            .withColumn("confidence", F.round(w["name"] * F.col("name") + w["value"] * F.col("value"), 4))
            .select("table", "position", "column", "place", "meaning", "test", "role", "shared", "slot", "kind", "never_identifier", "unnamed", "strict", "chosen", "name", "value", "as_chosen", "confidence"))


# ------------------------------------------------------------------ the parts of columns
def best_offers(offers: DataFrame) -> DataFrame:
    """(table, column, meaning, confidence): offers taken from the best on, each closing its column and, unless shared, its slot.

    ``offers``: (table, column, meaning, slot or null, place, confidence).  A fold over each table's offers in order; ties go by the order of meanings, then columns."""
    row = F.struct((-F.col("confidence")).alias("less"), "place", "column", "slot", "meaning", "confidence")
    start = F.struct(F.array().cast("array<struct<column: string, meaning: string, confidence: double>>").alias("taken"), F.array().cast("array<string>").alias("columns"), F.array().cast("array<string>").alias("slots"))

    def take(got: Column, o: Column) -> Column:
        closed = F.array_contains(got["columns"], o["column"]) | F.coalesce(F.array_contains(got["slots"], o["slot"]), F.lit(False))
        return F.when(closed, got).otherwise(F.struct(
            F.array_append(got["taken"], F.struct(o["column"].alias("column"), o["meaning"].alias("meaning"), o["confidence"].alias("confidence"))).alias("taken"),
            F.array_append(got["columns"], o["column"]).alias("columns"),
            F.concat(got["slots"], F.when(o["slot"].isNull(), F.array().cast("array<string>")).otherwise(F.array(o["slot"]))).alias("slots")))

    folded = offers.groupBy("table").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, take)["taken"].alias("taken"))      # as many as columns x meanings
    return folded.select("table", F.inline("taken"))


def assign(facts: DataFrame, scored: DataFrame, reg: Registry) -> DataFrame:
    """The part of each column, with its facts: choices first, then a market table's columns, then the best offers; what is left is told apart by its
    values only."""
    c = reg.intake
    full = scored.where((F.col("meaning") == F.col("chosen")) & ~F.col("shared")).groupBy("table").agg(F.collect_set("slot").alias("full"))
    market = F.when(F.col("is_market") & F.col("is_number"), MARKET).when(F.col("is_market") & F.col("is_date"), CANDLE)
    free = facts.where(F.col("chosen").isNull() & market.isNull()).select("table", "column")
    open_slot = F.col("shared") | ~F.coalesce(F.array_contains("full", F.col("slot")), F.lit(False))
    considered = (scored.join(free, ["table", "column"], "left_semi").join(full, "table", "left")
                  .where((F.col("test") != "shape") & open_slot & ((F.col("name") > 0) | F.col("unnamed"))))
    refused = (considered.where((F.col("confidence") < c["review"]) & (F.col("name") > 0) & (F.col("slot") == "subject"))
               .select("table", "column", F.lit(True).alias("rejected_as_subject")).distinct())
    taken = best_offers(considered.where(F.col("confidence") >= c["review"])
                        .select("table", "column", "meaning", F.when(~F.col("shared"), F.col("slot")).alias("slot"), "place", "confidence")).withColumnsRenamed({"meaning": "offered", "confidence": "offer"})
    share = F.round(F.when(F.col("is_number"), F.col("numeric")).otherwise(F.col("date")), 4)
    rest = F.when(F.col("is_date"), DATE_REST).when(F.col("is_number"), NUMERIC_REST).otherwise(NO_PART)
    unasked = F.col("chosen").isNull()
    sure = F.when(market.isNotNull(), share).otherwise(F.coalesce("offer", F.when(F.col("is_date"), F.round(F.col("date") * c["weights"]["value"], 4))))
    parts = (facts.join(taken, ["table", "column"], "left").join(refused, ["table", "column"], "left")
             .withColumn("meaning", F.coalesce("chosen", market, "offered", rest)).withColumn("sure", F.when(unasked, sure))
             .withColumn("origin", F.when(unasked, "inferred").otherwise("user")).withColumn("rejected_as_subject", F.coalesce("rejected_as_subject", F.lit(False))))
    of = scored.select("table", "column", "meaning", "role", "kind", "never_identifier", "strict", "name", "value", "as_chosen")
    return _judged(parts.join(of, ["table", "column", "meaning"]), reg)


def objections(reg: Registry) -> Column:
    """What speaks against the part of a column, by name; empty if nothing does."""
    c, user = reg.intake, F.col("origin") == "user"
    checked = [k for k, how in c["subject_kinds"].items() if how["check"]]
    timed = F.col("meaning").startswith("ts_")
    real = F.col("meaning") != NO_PART
    found = {"identifiers_do_not_fit_the_name": F.col("rejected_as_subject") & F.col("meaning").isin(NO_PART, NUMERIC_REST),
             "too_few_valid_identifiers": real & F.coalesce(F.col("kind").isin(checked), F.lit(False)) & (F.col("score") < c["min_valid_rate"]),
             "no_values": real & user & (F.col("n") == 0), "not_dates": real & user & timed & ~F.col("is_date"),
             "holds_identifiers": real & user & F.col("never_identifier") & F.col("is_identifier"),
             "values_do_not_fit": real & user & (timed | F.col("strict")) & (F.col("score") < c["review"])}
    return F.filter(F.array(*(F.when(holds, F.lit(k)) for k, holds in found.items())), lambda x: x.isNotNull())


def _judged(parts: DataFrame, reg: Registry) -> DataFrame:
    """A part is invalid if anything speaks against it, unused, for review if it is unsure, and else ok."""
    user = F.col("origin") == "user"
    unsure = ~user & ((F.col("meaning") == DATE_REST) | ((F.col("sure") < reg.intake["accept"]) & ~F.col("meaning").isin(MARKET, CANDLE)))
    status = (F.when(F.size("objections") > 0, "invalid").when(F.col("meaning").isin(NO_PART, NUMERIC_REST), "unused")
              .when(F.coalesce(unsure, F.lit(False)), "review").otherwise("ok"))
    return (parts.withColumn("score", F.when(user, F.col("as_chosen")).otherwise(F.col("value"))).withColumn("objections", objections(reg)).withColumn("status", status)
            .withColumn("confidence", F.when(user & (F.col("meaning") != NO_PART), F.round("score", 4)).otherwise(F.col("sure"))))


# ------------------------------------------------------------------ the tables
def _one(parts: Column, holds) -> Column:
    """The first part of an array that holds, or null."""
    return F.get(F.filter(parts, holds), F.lit(0))


def _usable(parts: Column, meaning: str) -> Column:
    return _one(parts, lambda p: (p["meaning"] == meaning) & (p["status"] != "invalid"))


def _chains(parts: DataFrame, reg: Registry) -> DataFrame:
    """One row per table: its parts in order, its subject, and the chain of its identifiers: the user's, the column's, or the one that most of them fit."""
    c = reg.intake
    kept = ["position", "column", "meaning", "role", "kind", "origin", "status", "confidence", "name", "rejected_as_subject", "n", "chains", "chain_named", "best_address", "address_named", "asset_named",
            "opaque", "lengths", "shortest", "longest", "names_asset", *(f"{x}_{f}" for x in ("address", "transaction") for f in sorted({s["family"] for s in reg.chains.values()}))]
    rows = parts.groupBy("table", "said_chain").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("parts"))
    subject, check = F.col("subject"), F.col("check")
    kinds = c["subject_kinds"]
    rows = rows.withColumn("subject", _one(F.col("parts"), lambda p: p["kind"].isNotNull())).withColumn("kind", subject["kind"])
    rows = rows.withColumn("check", reduce(lambda out, k: out.when(F.col("kind") == k, F.lit(kinds[k]["check"])), kinds, F.when(F.lit(False), F.lit(None).cast("string"))))
    rate = lambda f: F.coalesce(F.when(check == "address", subject[f"address_{f}"]).when(check == "transaction", subject[f"transaction_{f}"]), F.lit(0.0))
    rates = F.filter(F.array(*(F.struct(rate(s["family"]).alias("rate"), F.lit(x).alias("chain")) for x, s in reg.chains.items())),
                     lambda r: check.isNotNull() & F.coalesce(r["chain"] == F.col("said_chain"), F.lit(True)))
    rows = rows.withColumn("rates", rates).withColumn("fits", F.sort_array(F.filter("rates", lambda r: r["rate"] >= c["min_valid_rate"]), asc=False))
    rows = rows.withColumn("column", _usable(F.col("parts"), "chain"))
    named, fits = F.coalesce(F.col("column")["chains"], F.array().cast("array<string>")), F.col("fits")
    alone = (F.size(named) == 1) & (F.col("column")["chain_named"] == 1.0)
    close = (F.size(fits) > 1) & (F.get(fits, F.lit(0))["rate"] - F.get(fits, F.lit(1))["rate"] <= c["chain_margin"])
    needs = F.coalesce(F.col("kind").isin([k for k, how in kinds.items() if how["needs_chain"]]), F.lit(False))
    status = (F.when(~needs, "not_required").when(F.col("said_chain").isNotNull() | alone, "determined").when((F.size(named) > 0) & (F.col("kind") == "address"), "per_row")
              .when(F.size(fits) == 0, "undetermined").when(close, "ambiguous").otherwise("determined"))
    chain = F.when(F.col("chain_status") == "determined", F.coalesce("said_chain", F.when(alone, named[0]), F.get(fits, F.lit(0))["chain"]))
    return rows.withColumn("chain_status", status).withColumn("chain", chain).drop("fits")


def _rescored(rows: DataFrame, stated: DataFrame, reg: Registry) -> DataFrame:
    """Scores subjects by the chain that each row states, where rows do; and refuses subjects that do not fit the table's chain."""
    c, w, subject = reg.intake, reg.intake["weights"], F.col("subject")
    per_row, user = F.col("chain_status") == "per_row", F.col("subject")["origin"] == "user"
    known = stated.where("chain IS NOT NULL").groupBy("table").agg(
        F.sum("n").alias("n"), F.sum("n_valid").alias("n_valid"), F.array_sort(F.collect_list(F.struct((F.col("n_valid") / F.col("n")).alias("rate"), "chain"))).alias("stated"))
    odd = stated.where("chain IS NULL").select("table", F.lit(True).alias("odd")).distinct()
    rows = rows.join(known, "table", "left").join(odd, "table", "left")
    rate = F.coalesce(F.round(F.col("n_valid") / F.col("n"), 4), F.lit(0.0))
    confidence = F.when(user, rate).otherwise(F.round(w["name"] * subject["name"] + w["value"] * rate, 4))
    own = F.coalesce(_one(F.col("rates"), lambda r: r["chain"] == F.col("chain"))["rate"], F.lit(0.0))
    status = (F.when(per_row & (rate < c["min_valid_rate"]), "invalid")
              .when(per_row & ~user & (subject["status"] != "invalid"), F.when(confidence >= c["accept"], "ok").otherwise("review"))
              .when((F.col("kind") == "address") & F.col("chain").isNotNull() & (own < c["min_valid_rate"]), "invalid").otherwise(subject["status"]))
    moved = lambda p: p.withField("status", status).withField("confidence", F.when(per_row, confidence).otherwise(p["confidence"]))
    rows = rows.withColumns({"parts": F.transform("parts", lambda p: F.when(p["position"] == subject["position"], moved(p)).otherwise(p)),
                             "rates": F.when(per_row, F.coalesce("stated", F.array().cast("array<struct<rate: double, chain: string>>"))).otherwise(F.col("rates"))})
    low = F.transform(F.sort_array(F.transform(F.filter("rates", lambda r: r["rate"] < c["min_valid_rate"]), lambda r: r["chain"])), lambda x: F.concat(F.lit("chain_mostly_invalid:"), x))
    warnings = F.when(per_row, F.concat(low, F.when(F.col("odd"), F.array(F.lit("rows_name_unsupported_chain"))).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("warnings", warnings).withColumn("subject", _one(F.col("parts"), lambda p: p["kind"].isNotNull())).drop("n", "n_valid", "stated", "odd")


def _decided(rows: DataFrame, reg: Registry, confirmed: set[str]) -> DataFrame:
    """The kind of each table, what blocks it, and the roles of its columns."""
    c, parts, subject = reg.intake, F.col("parts"), F.col("subject")
    rows = rows.withColumns({"label": F.coalesce(*(_usable(parts, m) for m in ("attribution_category", "attribution_label", "attribution_entity"))),
                             "wrong": F.filter(parts, lambda p: (p["origin"] == "user") & (p["status"] == "invalid")),
                             "failed": F.filter(parts, lambda p: p["rejected_as_subject"] | (p["kind"].isNotNull() & (p["status"] == "invalid")))})
    # identifiers of a chain that cannot be checked, or an asset by name; both only where no column holds valid identifiers
    shape, filled = c["opaque_shape"], F.filter(parts, lambda p: p["n"] > 0)
    weight = lambda p: p["best_address"] + F.when(p["address_named"], c["address_name_bonus"]).otherwise(0.0)
    likeliest = _one(filled, lambda p: weight(p) == F.array_max(F.transform(filled, weight)))
    none_valid = F.coalesce(likeliest["best_address"] < c["rate_bands"]["low"], F.lit(True))
    alike = lambda p: (p["n"] >= shape["min_values"]) & (p["lengths"] <= shape["max_lengths"]) & p["opaque"] & (p["shortest"] >= shape["min_chars"]) & (p["longest"] <= shape["max_chars"])
    foreign = none_valid & F.exists(filled, lambda p: p["address_named"] & alike(p))
    asset = none_valid & ~F.exists(filled, lambda p: p["address_named"] & alike(p)) & F.exists(filled, lambda p: p["asset_named"] & p["names_asset"])
    labelled = F.col("label").isNotNull() & (F.size("failed") > 0)
    good = subject.isNotNull() & (subject["status"] != "invalid")
    lost = F.coalesce(subject["status"] == "invalid", F.lit(False))
    analysable = F.coalesce(F.col("kind").isin([k for k, how in c["subject_kinds"].items() if how["analysable"]]), F.lit(False))
    kind = (F.when(good & analysable, "attribution_claims").when(good, "unsupported_subject_kind").when(F.size("wrong") > 0, "mapping_unresolved")
            .when(labelled & _usable(parts, "chain").isNotNull(), "attribution_like_unresolved").when(foreign, "unsupported_chain_attribution")
            .when(F.exists(parts, lambda p: (p["meaning"] == MARKET) & (p["origin"] == "inferred")), "market_timeseries").when(labelled, "attribution_like_unresolved")
            .when(asset | F.exists(parts, lambda p: p["meaning"] == "chain"), "crypto_non_attribution").otherwise("non_crypto"))
    rows = rows.withColumn("dataset_type", kind)
    some = lambda *cases: F.filter(F.array(*(F.when(holds, F.lit(x)) for holds, x in cases)), lambda x: x.isNotNull())
    review = F.coalesce(subject["status"] == "review", F.lit(False)) | F.coalesce(F.col("label")["status"] == "review", F.lit(False))
    unlabelled = F.col("label").isNull()
    blockers = (F.when(F.col("dataset_type") == "attribution_claims", some((F.col("chain_status").isin("undetermined", "ambiguous"), "chain_required"), (unlabelled, "missing_label"),
                                                                           (review & ~F.col("table").isin(list(confirmed)), "needs_confirmation")))
                .when(F.col("dataset_type") == "mapping_unresolved", F.concat(F.array_repeat(F.lit("user_mapping_invalid"), F.size("wrong")), some((lost, "subject_invalid"))))
                .when(F.col("dataset_type") == "unsupported_subject_kind", some((F.lit(True), "subject_kind_unsupported")))
                .otherwise(some((lost, "subject_invalid"), (~lost, "missing_subject"), (unlabelled, "missing_label"))))
    rows = rows.withColumn("blockers", blockers)
    hopeless = F.col("dataset_type").isin([t for t, s in STATE_OF_TYPE.items() if s == "not_attribution_data"] + ["unsupported_chain_attribution"])
    status = (F.when(hopeless, "unsupported").when(F.exists("blockers", lambda b: b != "needs_confirmation"), "blocked").when(F.size("blockers") > 0, "needs_confirmation").otherwise("ready"))
    roles = F.map_from_entries(F.transform(F.filter(parts, lambda p: (p["status"] != "invalid") & p["role"].isNotNull()), lambda p: F.struct(p["role"], p["column"])))
    established = F.when(F.col("dataset_type") == "attribution_like_unresolved", F.concat(
        F.array(F.concat(F.lit("labels:"), F.col("label")["column"])),
        F.transform(F.filter(parts, lambda p: (p["meaning"] == "chain") & (p["status"] != "invalid")), lambda p: F.concat(F.lit("chain_per_row:"), p["column"])),
        F.transform("failed", lambda p: F.concat(F.lit("identifiers_do_not_validate:"), p["column"])))).otherwise(F.array().cast("array<string>"))
    return rows.select("table", "parts", subject["column"].alias("subject"), "kind", "chain", "chain_status", "rates", "dataset_type", status.alias("status"), "blockers", roles.alias("roles"),
                       F.coalesce(*(_usable(parts, m)["column"] for m in c["currency_roles"])).alias("currency_basis"),
                       F.coalesce(*(_usable(parts, m)["column"] for m in ("attribution_category", "attribution_label"))).alias("lists"),
                       _usable(parts, "attribution_source")["column"].alias("source"), "warnings", established.alias("established"))


# ------------------------------------------------------------------ the user's choices
def check_choices(choices: dict[str, str], columns: list[str], reg: Registry) -> None:
    """Raises for a column that is not there, an unknown meaning, and two columns for one slot."""
    known = reg.intake["meanings"]
    if lost := sorted(set(choices) - set(columns)):
        raise ValueError(f"no such column in the table: {', '.join(lost)}")
    if odd := sorted(set(choices.values()) - set(known)):
        raise ValueError(f"no such meaning: {', '.join(odd)}")
    slots = [slot(m) for m in choices.values() if not known[m][2]]
    if twice := sorted({x for x in slots if slots.count(x) > 1}):
        raise ValueError(f"more than one column is chosen as {', '.join(twice)}")


def choices_from_roles(roles: dict[str, str | None], columns: list[str], reg: Registry) -> dict[str, str]:
    """{role: column} turned into {column: meaning}; roles without a column are left to inference."""
    pairs = [(col, reg.intake["role_names"].get(role, role)) for role, col in roles.items() if col is not None]
    out = dict(pairs)
    if any(out[col] != meaning for col, meaning in pairs):
        raise ValueError("one column is given several roles")
    check_choices(out, columns, reg)
    return out


def survey(tables: dict[str, DataFrame], reg: Registry, choices: dict[str, dict[str, str]] | None = None, chains: dict[str, str] | None = None,
           confirmed: set[str] | frozenset[str] = frozenset()) -> Survey:
    """Profile tables (``row_id`` plus text columns) and decide which of them claims can be built from.

    ``choices`` ({table: {column: meaning}}) and ``chains`` ({table: chain}) are the user's.  A choice of a column that is not there, of an unknown meaning,
    or of a slot that is chosen twice is set aside; ``Survey.choices`` says so, and lists what the values say against the others."""
    spark, wanted = next(iter(tables.values())).sparkSession, choices or {}
    refused = {(t, x): why for t, w in wanted.items() for x, why in _set_aside(w, tables[t].columns, reg).items()}
    heeded = {t: {x: m for x, m in w.items() if (t, x) not in refused} for t, w in wanted.items()}
    facts = written(evidence(tables, reg, heeded, chains))
    scored = written(scores(facts, reg))
    parts = assign(facts, scored, reg)
    rows = written(_chains(parts, reg))
    # second looks: only tables that a decision made so far concerns, all in one job
    per_row = rows.where("chain_status = 'per_row'").select("table", F.col("column")["column"].alias("chain"), F.col("subject")["column"].alias("subject")).collect()       # a row a table
    stated = [profiling.chain_pairs(tables[r["table"]], r["chain"], r["subject"], reg).select(F.lit(r["table"]).alias("table"), "chain", "n", "n_valid") for r in per_row]
    stated = _union(stated) if stated else spark.createDataFrame([], "table string, chain string, n bigint, n_valid bigint")
    found = written(_decided(_rescored(rows, stated, reg), reg, set(confirmed)))
    looks = found.select("table", "dataset_type", "lists", "source").collect()                                                # a row a table
    lists = [profiling.multi_label(tables[r["table"]], r["lists"], reg).where("is_multi_label").select(F.lit(r["table"]).alias("table"), "separator")
             for r in looks if r["lists"] and r["dataset_type"] == "attribution_claims"]
    classes = [profiling.is_source_class(tables[r["table"]], r["source"], reg).where("is_class").select(F.lit(r["table"]).alias("table"), F.lit(r["source"]).alias("class")) for r in looks if r["source"]]
    counts = _union([df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t, df in tables.items()])
    out = found.join(counts, "table", "left")
    out = out.join(_union(lists).groupBy("table").agg(F.min("separator").alias("separator")) if lists else spark.createDataFrame([], "table string, separator string"), "table", "left")
    out = out.join(_union(classes) if classes else spark.createDataFrame([], "table string, class string"), "table", "left")
    out = written(out.withColumn("warnings", F.when(F.col("class").isNotNull(), F.array_append("warnings", F.concat(F.lit("source_is_a_class:"), "class"))).otherwise(F.col("warnings"))).drop("class"))
    # a subject may have been scored anew, so the parts are those of the decided tables
    flat = out.select("table", F.inline("parts")).select("table", "position", "column", "meaning", "confidence", "status", "origin", "rejected_as_subject", "name", "n")
    asked = spark.createDataFrame([(t, x, m, refused.get((t, x))) for t, w in wanted.items() for x, m in w.items()], "table string, column string, meaning string, set_aside string")
    against = parts.where("origin = 'user'").select("table", "column", "objections", "confidence")
    said = (asked.join(against, ["table", "column"], "left")
            .select("table", "column", "meaning", F.explode_outer(F.when(F.col("set_aside").isNotNull(), F.array("set_aside")).otherwise(F.col("objections"))).alias("objection"), "confidence"))
    return Survey(flat, out, said)


def _set_aside(choices: dict[str, str], columns: list[str], reg: Registry) -> dict[str, str]:
    """{column: why} of choices that cannot be tried at all."""
    known = reg.intake["meanings"]
    sensible = [slot(m) for x, m in choices.items() if x in columns and m in known and not known[m][2]]
    out = {}
    for x, m in choices.items():
        why = [(x not in columns, "no_such_column"), (m not in known, "no_such_meaning"), (m in known and not known[m][2] and sensible.count(slot(m)) > 1, "slot_chosen_twice")]
        out |= {x: next(reason for holds, reason in why if holds)} if any(h for h, _ in why) else {}
    return out


def preflight(rows: DataFrame, reg: Registry, choices: dict[str, str] | None = None, chain: str | None = None, confirmed: bool = False) -> Preflight:
    """The survey of one table, on the driver.  Choices that cannot be tried raise."""
    columns = [x for x in rows.columns if x != "row_id"]
    check_choices(dict(choices or {}), columns, reg)
    if chain not in (None, *reg.chains):
        raise ValueError(f"{chain!r} is none of the supported chains ({', '.join(sorted(reg.chains))})")
    s = survey({"": rows}, reg, {"": dict(choices or {})}, {"": chain} if chain else {}, {""} if confirmed else frozenset())
    t = s.tables.collect()[0]
    parts = [Part(p["column"], p["meaning"], p["confidence"], p["status"], p["origin"], p["rejected_as_subject"]) for p in t["parts"]]
    mapping: dict[str, str | None] = {m[1]: None for m in reg.intake["meanings"].values() if m[1]}
    mapping |= {**t["roles"], "timestamp": t["currency_basis"]}
    if not mapping.get("label") and not mapping.get("category"):
        mapping["label"] = mapping.get("entity")
    structure = dict(status="multi_label" if t["separator"] else "single_label", column=t["lists"], separator=t["separator"])
    return Preflight(t["n_rows"], parts, t["subject"], t["kind"], t["chain"], t["chain_status"], {r["chain"]: round(r["rate"], 4) for r in t["rates"]}, t["dataset_type"], t["status"],
                     list(t["blockers"]), mapping, t["currency_basis"], structure, list(t["warnings"]), list(t["established"]))
