"""Labels, provenance rules, evidence classes, currency."""
import dataclasses

from conftest import by, day
from pyspark.sql import functions as F

from attestra import Registry
from attestra.functions import evidence, labels, provenance
from attestra.operators import claims as C


def test_label_lookup_and_structured_labels(spark, reg):
    cases = {" Ransom ": ("ransomware", None), "onlinewallet:flexcoin": ("wallet_service", "flexcoin"), "ransom:a:b": ("ransomware", "a:b"),
             "http://x": (None, None), "class_3": (None, None), "CASINO": ("gambling", None), "": (None, None), "strange:mixer": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: (r.c, r.e) for r in df.select("n", labels.canonical_category(reg, F.col("n")).alias("c"),
                                              labels.structured_entity(reg, F.col("n")).alias("e")).collect()}
    assert got == cases


def _stamp(spark, reg, rows):
    cols = "claim_seq bigint, address string, source string, raw_label string, canon string, polarity string, prov_family string, lastmod string, heuristic string, subcat string"
    return C.stamp(spark.createDataFrame([(i, a, s, "", "mixer", "illicit", fam, "", h, sub) for i, (a, s, fam, sub, h) in enumerate(rows)], cols), reg)


def test_each_kind_of_rule(spark, reg):
    rows = [("1", "ellipticpp", "", "", ""), ("#2", "watchyourback", "", "hydra-market", "manual_verified"), ("#3", "tagpack", "tagpack:X", "", "curated"),
            ("4", "watchyourback", "", "other", "manual_verified"), ("5", "rodwald_ransom", "rodwald:SR", "montreal", ""), ("6", "rodwald_ransom", "rodwald:s", "Montreal9", ""),
            ("7", "rodwald_ransom", "rodwald:", "locky", ""), ("8", "rodwald_ransom", "R", "locky", ""), ("9", "tagpack", "nothing", "", ""),
            ("10", "tagpack", "tagpack:PAQUET-Clouston", "", ""), ("11", "schnoering", "", "SDN", ""), ("12", "schnoering", "", "sdn", ""), ("13", "stranger", "x:R", "SDN", "")]
    got = by(_stamp(spark, reg, rows), "claim_seq")
    view = {k: (r["address"], r["root"], r["prov_resolved"], r["prov_native"], r["prov_verified"], r["prov_kind"], r["root_known"]) for k, r in got.items()}
    assert view == {
        0: ("1", "elliptic_undisclosed", False, True, False, "DECLARED", False),
        1: ("2", "ofac_sdn", True, False, True, "DECLARED", True),
        2: ("#3", "tagpack_X", True, True, False, "INFERRED", True),                       # only the declaring source's marker is dropped
        3: ("4", "watchyourback_manual", True, True, False, "DECLARED", True),             # a default that is itself declared
        4: ("5", "ransomwhere_crowd", True, False, False, "INFERRED", True),               # the code wins over the residue
        5: ("6", "montreal_paquet_clouston_2019", True, False, False, "INFERRED", True),
        6: ("7", "rodwald_own_unknown", False, True, False, "INFERRED", False),
        7: ("8", "rodwald_own_unknown", False, True, False, "INFERRED", False),            # no colon: no code
        8: ("9", "tagpack_unknown", True, True, False, "INFERRED", True),
        9: ("10", "montreal_paquet_clouston_2019", True, False, False, "INFERRED", True),
        10: ("11", "ofac_sdn", True, False, True, "DECLARED", True),
        11: ("12", "schnoering_other", False, False, False, "INFERRED", False),
        12: ("13", "stranger:unresolved", False, False, False, "UNKNOWN", False)}
    assert got[1]["raw_address"] == "#2"


def test_root_names_are_judged_by_the_ledger(spark, reg):
    names = {"ofac_sdn": True, "tagpack_any": True, "rodwald_own_S": False, "elliptic_undisclosed": False, "never_assigned": False}
    df = spark.createDataFrame([(k,) for k in names], "r string")
    assert {r.r: r.k for r in df.select("r", provenance.root_known(reg, F.col("r")).alias("k")).collect()} == names


def test_a_template_that_meets_an_exact_name_follows_the_exact_name(spark):
    reg = Registry.load(sources={"s": dict(rule=dict(kind="contains", field="prov_family", fragments=[], fallback=["own_{value}", [True, True, False]])),
                                 "t": dict(rule=dict(kind="fixed", root="own_x", flags=[False, True, False]))})
    got = by(_stamp(spark, reg, [("1", "s", "x", "", ""), ("2", "s", "y", "", "")]), "claim_seq")
    assert [(got[i]["root"], got[i]["root_known"], got[i]["prov_resolved"]) for i in (0, 1)] == [("own_x", False, True), ("own_y", True, True)]


def test_tiers(spark, reg):
    df = spark.createDataFrame([(True, "x", "none"), (False, "ofac_sdn", "none"), (False, "x", "curated"), (False, "x", ""), (False, "x", "unknown"), (False, "x", "new")],
                               "v boolean, r string, h string")
    assert [r[0] for r in df.select(evidence.evidence_tier(reg, F.col("v"), F.col("r"), F.col("h"))).collect()] == [
        "verified", "verified", "derived", "unverified-report", "unknown", "unverified-report"]


def test_currency_needs_a_real_date_and_is_strict(spark, reg):
    cases = {"": "currency-unknown", "2020-1-1": "currency-unknown", "20200101": "currency-unknown", "soon": "currency-unknown", "2020-02-30": "currency-unknown",
             "2023-01-02T03:04:05Z": "current", "2021-01-01": "current", "2020-12-31": "stale", " 2019-05-05 ": "stale"}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    # 2021-01-01 .. 2024-01-01 is 1095 days = 2.998 years
    got = {r.d: r.s for r in df.select("d", evidence.currency_status(reg, F.col("d"), day("2024-01-01")).alias("s")).collect()}
    assert got == cases


def test_snapshot_day(spark, make):
    rows = make([dict(lastmod="2020-01-01"), dict(lastmod="2021-05-06T1"), dict(lastmod="")])
    assert str(C.snapshot_date(rows).first()[0]) == "2021-05-06"
    assert str(C.snapshot_date(rows, "2022-01-01").first()[0]) == "2022-01-01"
    assert C.snapshot_date(make([dict(lastmod="zzz"), dict(lastmod="2020-01-01")])).first()[0] is None


def test_a_wide_tree_uses_several_words(spark, reg):
    extra = {f"k{i}": labels_category(reg, f"k{i}") for i in range(90)}
    big = dataclasses.replace(reg, categories={**reg.categories, **extra})
    codes = labels.CategoryCodes(big)
    assert codes.words == 2
    df = codes.with_codes(spark.createDataFrame([("k80",), ("k3",), ("illicit_unspec",)], "canon string")).agg(*codes.merge())
    assert df.select(codes.n_categories(), codes.relationship()).first()[:] == (3, "entity-type conflict")


def labels_category(reg, name):
    return dataclasses.replace(reg.categories["mixer"], name=name, aliases=())
