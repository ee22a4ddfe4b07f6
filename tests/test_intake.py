"""Row validation, table profiles, joins: small tables with known answers, and brute force."""
import os
import random

import pytest
from conftest import by, one
from pyspark.sql import functions as F

from attestra.operators import claims as C, preflight as PF, profiling as P, relational as L, validation as V
from attestra.plans import upload_audit

BTC = ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]
HEX = [f"0x{i:040x}" for i in range(11, 60)]
MAP = dict(address="addr", chain="net", category="cat", label="lab", source="src", timestamp=None, actor=None, entity=None, confidence=None)
MULTI = dict(status="multi_label", column="cat", separator=",")


def table(spark, cols, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, " + ", ".join(f"`{c}` string" for c in cols))


def test_reasons_in_order(spark, reg):
    rows = [(BTC[0], "btc", "mixer", "", "s"), (BTC[0], "btc", "mixer", "", "s"), ("", "btc", "mixer", "", "s"), ("  ", "nochain", "", "", ""),
            (BTC[1], "dogecoin", "mixer", "", ""), (BTC[1], "", "mixer", "", ""), (HEX[0], "", "mixer", "", ""), (BTC[1], "btc", "", " ", ""),
            (BTC[1], "btc", "", "lab1", ""), (f" {BTC[0]} ", "btc", "mixer", "x", "s"), (BTC[0], "btc", "mixer,scam", "", "s"),
            (BTC[0], "btc", "scam,mixer", "", "s"), (BTC[0], "btc", "scam,scam,hack", "", "s"), (HEX[0].upper().replace("0X", "0x"), "eth", "hack", "", ""), (HEX[0], "eth", "hack", "", "")]
    v = V.validate(table(spark, ["addr", "net", "cat", "lab", "src"], rows), MAP, reg, "bitcoin", multi_label=MULTI)
    assert {r.row_id: r.reason for r in v.rejected.collect()} == {
        1: "duplicate row", 2: "empty address", 3: "empty address", 4: "unresolved chain", 6: "invalid address", 7: "missing label", 9: "duplicate claim",
        11: "duplicate claim", 14: "duplicate claim"}
    tokens = {r.row_id: [(t.pos, t.token) for t in r.tokens] if r.tokens else None for r in v.valid.collect()}
    assert tokens == {0: None, 5: None, 8: None, 10: [(1, "scam")], 12: [(2, "hack")], 13: None}
    c = one(v.counts())
    assert (c["n_input"], c["n_valid"], c["n_rejected"], c["n_claims"], c["n_checked"], c["n_invalid"], c["n_trimmed"]) == (15, 6, 9, 6, 11, 1, 1)
    assert sum(r.n_rows for r in v.reasons().collect()) == 15
    built = C.build_claims(v.valid, MAP, "desk", reg)
    got = {(r.record_id, r.subcat, r.raw_label): (r.canon, r.label_cell, r.subject) for r in built.collect()}
    assert got[10, "scam", ""] == ("scam", "mixer,scam", f"bitcoin:{BTC[0]}") and got[8, "", "lab1"] == ("unknown", None, f"bitcoin:{BTC[1]}")
    assert got[13, "hack", ""][2] == f"ethereum:{HEX[0]}"
    with pytest.raises(ValueError):
        C.build_claims(v.valid, MAP, "tagpack", reg)
    with pytest.raises(ValueError):
        V.validate(v.rows, dict(MAP, chain=None), reg, None)


def test_random_rows_match_a_sequential_reading(spark, reg):
    rnd = random.Random(5)
    rows = [(rnd.choice(HEX[:4] + ["", "bad"]) if rnd.random() > .34 else HEX[0], rnd.choice(["eth", "bsc", "", "zzz"]), rnd.choice(["mixer", "mixer,scam", "scam", "", "hack,hack"]), "",
             rnd.choice("pq")) for _ in range(300)]
    v = V.validate(table(spark, ["addr", "net", "cat", "lab", "src"], rows).repartition(5), MAP, reg, "ethereum", multi_label=MULTI)
    chain = {"eth": "e", "bsc": "b", "": "e"}
    seen, claims, want = set(), set(), {}
    for i, (a, n, c, _, s) in enumerate(rows):
        if (a, n, c, s) in seen:
            want[i] = "duplicate row"
            continue
        seen.add((a, n, c, s))
        why = "empty address" if not a else "unresolved chain" if n not in chain else "invalid address" if a == "bad" else "missing label" if not c else None
        if why is None:
            new = {(chain[n], a, t, s) for t in c.split(",")} - claims
            claims |= new
            why = None if new else "duplicate claim"
        if why:
            want[i] = why
    assert {r.row_id: r.reason for r in v.rejected.collect()} == want
    assert one(v.counts())["n_claims"] == len(claims)


def kinds(pf):
    return {m.column: m.meaning for m in pf.columns}


def test_tables_are_recognised_by_what_they_hold(spark, reg):
    cases = [
        (["wallet_address", "entity_type", "notes_url", "last_seen"], [(BTC[i % 3], ["ransomware", "exchange", "scam"][i % 3], f"https://e.org/{i}", "2025-01-01") for i in range(6)], "attribution_claims", "ready"),
        (["name", "age", "city"], [("Ann", "30", "Ulm"), ("Bo", "25", "Graz")], "non_crypto", "unsupported"),
        (["address", "label"], [(f"Qm4hVw9dKz2LrTb8Yx6sNc3PfGj7uEa5M{c}", f"House {c}") for c in "hkmp"], "unsupported_chain_attribution", "unsupported"),
        (["account_id", "plan"], [(f"member/{i}/x", "basic") for i in range(4)], "non_crypto", "unsupported"),
        (["Date", "Symbol", "Open", "Close"], [(f"2024-01-0{i}", "BTC-USD", f"4{i}000", f"4{i}500") for i in range(1, 5)], "crypto_non_attribution", "unsupported"),
        (["Date", "Symbol", "Open", "Close"], [(f"2024-01-0{i}", "ACME", f"18{i}", f"18{i}") for i in range(1, 5)], "non_crypto", "unsupported"),
        (["Date", "Price"], [(f"2010-07-1{i}", f"0.0{i}") for i in range(1, 5)], "non_crypto", "unsupported"),
        (["date", "open", "high", "low", "volume"], [(f"2024-01-0{i}", "1", "2", "0.5", "100") for i in range(1, 5)], "market_timeseries", "unsupported"),
        (["address", "label"], [(HEX[i], "mixer") for i in range(5)], "attribution_claims", "blocked"),      # every hexadecimal chain fits
        (["address", "category", "chain"], [(HEX[i], "mixer", ["eth", "bsc"][i % 2]) for i in range(6)], "attribution_claims", "ready"),
        (["address", "category"], [(str(i), "mixer") for i in range(10)], "attribution_like_unresolved", "blocked"),
        (["x", "category"], [(BTC[i % 3], "mixer") for i in range(6)], "attribution_claims", "needs_confirmation")]
    for cols, rows, kind, status in cases:
        pf = PF.preflight(table(spark, cols, rows), reg)
        assert (pf.dataset_type, pf.status) == (kind, status), (cols, pf)
    pf = PF.preflight(table(spark, *cases[0][:2]), reg)
    assert kinds(pf) == {"wallet_address": "subject_address", "entity_type": "attribution_label", "notes_url": "attribution_source", "last_seen": "ts_observation"}
    assert pf.chain == "bitcoin" and pf.currency_basis is None and pf.mapping["timestamp"] is None
    assert PF.preflight(table(spark, *cases[8][:2]), reg, chain="polygon").status == "ready"
    assert PF.preflight(table(spark, *cases[9][:2]), reg).chain_status == "per_row"
    assert PF.preflight(table(spark, *cases[11][:2]), reg, confirmed=True).can_analyse


def test_choices_select_but_never_waive(spark, reg):
    t = table(spark, ["address", "when", "kind"], [(BTC[i % 3], f"2024-01-0{i + 1}", "mixer") for i in range(5)])
    assert PF.preflight(t, reg, {"kind": "attribution_label"}).status == "ready"
    pf = PF.preflight(t, reg, {"when": "ts_attribution_last_updated"})
    assert pf.currency_basis == "when"
    assert PF.preflight(t, reg, {"kind": "subject_address"}).dataset_type == "mapping_unresolved"
    assert PF.preflight(t, reg, {"address": "attribution_label"}).status == "blocked"
    for bad in ({"nope": "chain"}, {"kind": "no_such"}, {"kind": "attribution_label", "when": "attribution_label"}):
        with pytest.raises(ValueError):
            PF.preflight(t, reg, bad)
    assert PF.choices_from_roles({"label": "kind", "source": None}, ["kind"], reg) == {"kind": "attribution_label"}
    with pytest.raises(ValueError):
        PF.choices_from_roles({"label": "kind", "category": "kind"}, ["kind"], reg)


def test_token_lists_are_established_by_the_column(spark, reg):
    def is_list(values):
        return one(P.multi_label(table(spark, ["c"], [(v,) for v in values]), "c", reg))["is_multi_label"]
    assert is_list(["a", "a", "b", "b", "a,b"]) and not is_list(["a", "b", "a,b"]) and not is_list(["a", "a", "b", "b", "a, b"]) and not is_list(["a", "a"])


WALLETS = dict(driving_table="wallets", joins=[dict(table="labels", local_key="label_id", foreign_key="label_id"),
                                               dict(table="sources", local_table="labels", local_key="source_id", foreign_key="source_id")])


@pytest.fixture
def tables(spark):
    w = spark.createDataFrame([(HEX[i], i % 4 if i % 5 else None, f"2024-0{1 + i % 9}-10") for i in range(40)], "address string, label_id int, first_seen string")
    return {"wallets": w, "labels": spark.createDataFrame([(0, "exchange", 1), (1, "mixer", 2), (2, "ransomware", 9)], "label_id int, category string, source_id int"),
            "sources": spark.createDataFrame([(1, "List A", "https://a.org"), (2, "Tip", "")], "source_id int, source_name string, source_url string")}


def test_joins(tables, reg):
    j = L.joined(tables, WALLETS)
    assert j.count() == 40 and j.where("labels__category IS NULL").count() == sum(1 for i in range(40) if i % 5 == 0 or i % 4 == 3)
    assert {(r.local_key, r.orphan_rows) for r in L.orphan_keys(tables, WALLETS).collect()} == {("label_id", sum(1 for i in range(40) if i % 5 and i % 4 == 3)), ("source_id", 1)}
    rel = {(r.from_table, r.from_column, r.to_table) for r in L.relationships(tables, reg).collect()}
    assert {("wallets", "label_id", "labels"), ("labels", "source_id", "sources")} <= rel and ("labels", "label_id", "wallets") not in rel
    roles = {r["table"]: r["role"] for r in L.table_roles(tables, reg).collect()}
    assert roles["labels"] == "attribution" and roles["wallets"] == "claim_subject"
    for bad in ({"joins": []}, dict(driving_table="nope"), dict(driving_table="wallets", joins=[dict(table="labels", local_table="sources", local_key="source_id", foreign_key="label_id")]),
                dict(driving_table="wallets", joins=[dict(table="labels", local_key="zzz", foreign_key="label_id")])):
        with pytest.raises(ValueError):
            L.check_join(tables, bad)


def test_citations_match_every_pair(spark, make, reg):
    rnd = random.Random(3)
    words = ["tip", "List A", "list a, 2020", "ab", "abc", "xABCx", "see List A", "Tip", "z" * 40, "zz", "zzz"] + ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(3, 12))).strip() for _ in range(60)]
    rows = make([dict(prov_family=w, address=str(i)) for i, w in enumerate(words)])
    t = {w for w in words if w}
    assert {(r.citing, r.cited) for r in L.citations(rows, reg).collect()} == {(a, b) for a in t for b in t if a != b and b.lower() in a.lower() and len(b) >= 3}


def test_the_whole_route(spark, make, reg):
    ref = make([dict(address=HEX[i], source="ransomwhere", canon="mixer", root="ransomwhere_crowd") for i in range(5)] + [dict(address=BTC[0], source="ransomwhere", canon="mixer", root="ransomwhere_crowd")])
    t = table(spark, ["address", "category", "chain", "source", "last_updated"], [(HEX[i], "mixer", "eth", f"post {i}", "2024-01-01") for i in range(20)] + [(BTC[0], "exchange", "btc", "post", "2024-01-01")])
    a = upload_audit.audit(t, "desk", reg, ref, F.lit("2024-06-01").cast("date"))
    assert a.stopped is None and a.claims.count() == 21 and a.verdict == "not_established"
    # hexadecimal identifiers are on another chain than the reference source's, whatever the string
    assert one(a.subjects.where("reference_sources > 0"))["address"] == BTC[0]
    assert {r.analysis: r.state for r in a.states.collect()}["staleness"] == "computed"
    stopped = upload_audit.audit(table(spark, ["a", "b"], [("1", "2")]), "desk", reg, ref, F.lit("2024-06-01").cast("date"))
    assert stopped.stopped == "unsupported" and stopped.claims is None and stopped.verdict == "cannot_assess"


def test_a_column_filled_once_is_profiled(spark, reg):
    rows = spark.range(60000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 41234, BTC[0]).otherwise("").alias("wallet_address"), F.lit("mixer").alias("category"))
    got = by(P.column_profiles(P.column_cells(rows), reg), "column")
    assert got["wallet_address"]["n"] == 1 and got["wallet_address"]["address_bitcoin"] == 1.0 and got["category"]["n"] == 60000
    assert kinds(PF.preflight(rows, reg))["wallet_address"] == "subject_address"


def test_slices_of_an_upload_are_judged_as_one(spark, reg, monkeypatch):
    """Slices hold all copies of a row and all statements of a claim, whatever ids and cells are null or repeat."""
    rnd = random.Random(8)
    some = [(rnd.choice([*HEX[:5], HEX[0].upper().replace("0X", "0x"), "", "bad", None]), rnd.choice(["eth", "bsc", None, "zzz"]), rnd.choice(["mixer", "mixer,scam", "scam,hack", "", None]), "",
             rnd.choice(["p", "", None])) for _ in range(400)]
    ids = [None if rnd.random() < 0.1 else i for i in range(400)]
    rows = spark.createDataFrame([(i, *r) for i, r in zip(ids, some)] + [(ids[k], *some[k]) for k in range(0, 400, 9)],
                                 "row_id bigint, addr string, net string, cat string, lab string, src string").repartition(5)

    def found():
        v = V.validate(rows, MAP, reg, "ethereum", multi_label=MULTI)
        plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
        return [plain(x) for x in (v.judged, v.rejected, v.reasons(), v.counts(), v.per_chain(), v.checksum_states(reg))]

    whole = found()
    monkeypatch.setattr(V, "SLICE", 70)
    assert found() == whole and len(whole[0]) > 200 and any("duplicate claim" in r for r in whole[1])


def test_a_judged_upload_is_small_on_disk(spark, reg):
    """Only the cells asked for are written, and none as a second spelling of another."""
    rnd = random.Random(9)
    n = 20_000
    rows = table(spark, ["addr", "net", "cat", "lab", "src"], [(f"0x{rnd.getrandbits(160):040x}", "eth", rnd.choice(["mixer", "scam"]), f"note {rnd.getrandbits(200)}", "s") for _ in range(n)])
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    v = V.validate(rows, MAP, reg, "ethereum", multi_label=MULTI, carry=())
    assert size(v.judged) < 60 * n and not {"addr", "_address", "lab"} & set(v.judged.columns) and one(v.counts())["n_claims"] == n
    address = V.validate(rows, MAP, reg, "ethereum", multi_label=MULTI, carry=["addr"])
    assert size(address.judged) < 90 * n and address.rejected.count() == 0


def test_three_hundred_tokens_are_three_hundred_places(spark, reg):
    cats = ",".join(f"t{i}" for i in range(300))
    rows = table(spark, ["addr", "net", "cat", "lab", "src"], [(BTC[0], "btc", cats, "", "s")] * 1 + [(BTC[1], "btc", "t1,t2", "", "s")])
    v = V.validate(rows, MAP, reg, "bitcoin", multi_label=MULTI)
    built = C.build_claims(v.valid, MAP, "desk", reg).collect()
    order = [r["subcat"] for r in sorted(built, key=lambda r: r["claim_seq"])]
    assert len({r["claim_seq"] for r in built}) == 302 and order == [f"t{i}" for i in range(300)] + ["t1", "t2"]


def test_citations_in_a_long_text(spark, make, reg):
    long = "x" * 20000 + " List A " + "y" * 20000
    rows = make([dict(prov_family=long, address="1"), dict(prov_family="list a", address="2"), dict(prov_family="none", address="3")])
    assert [(r.citing, r.cited) for r in L.citations(rows, reg).collect()] == [(long, "list a")]


def test_best_offers_are_those_taken_one_by_one(spark):
    rnd = random.Random(8)
    offers = [(t, f"c{rnd.randrange(6)}", f"m{m}", None if m < 2 else f"s{m % 4}", m, rnd.choice([.5, .7, .7, .9, 1.0])) for t in "xyz" for m in range(8) for _ in range(3)]
    offers = list({(o[0], o[1], o[2]): o for o in offers}.values())
    want = set()
    for t in "xyz":
        left = [o for o in offers if o[0] == t]
        while left:
            top = min(left, key=lambda o: (-o[5], o[4], o[1]))
            want.add((t, top[1], top[2], top[5]))
            left = [o for o in left if o[1] != top[1] and (o[3] is None or o[3] != top[3])]
    df = spark.createDataFrame(offers, "table string, column string, meaning string, slot string, place int, confidence double").repartition(4)
    assert {tuple(r) for r in PF.best_offers(df).collect()} == want
    assert PF.best_offers(df.limit(0)).count() == 0


def test_tables_are_surveyed_together_as_alone(spark, reg):
    tables = {"a": table(spark, ["address", "category", "chain"], [(HEX[i], "mixer", ["eth", "bsc"][i % 2]) for i in range(6)]),
              "b": table(spark, ["date", "open", "high", "low", "volume"], [(f"2024-01-0{i}", "1", "2", "0.5", "100") for i in range(1, 5)]),
              "c": table(spark, ["address", "category"], [(str(i), "mixer") for i in range(10)]),
              "d": table(spark, ["wallet", "address", "note"], [(HEX[i], HEX[i + 1], None) for i in range(5)]), "e": table(spark, ["x"], [])}
    choices = {"d": {"note": "attribution_label", "wallet": "attribution_entity", "gone": "chain", "address": "no_such"}}
    s = PF.survey(tables, reg, choices)
    assert {r["table"]: (r["dataset_type"], r["status"], r["n_rows"]) for r in s.tables.collect()} == {
        "a": ("attribution_claims", "ready", 6), "b": ("market_timeseries", "unsupported", 4), "c": ("attribution_like_unresolved", "blocked", 10), "d": ("attribution_claims", "blocked", 5),
        "e": ("non_crypto", "unsupported", 0)}
    for t in "abc":
        alone = PF.preflight(tables[t], reg)
        assert {(p.column, p.meaning, p.status, p.confidence) for p in alone.columns} == {tuple(r) for r in s.parts.where(F.col("table") == t).select("column", "meaning", "status", "confidence").collect()}
    assert {(r["column"], r["objection"]) for r in s.choices.collect()} == {("note", "no_values"), ("wallet", "holds_identifiers"), ("gone", "no_such_column"), ("address", "no_such_meaning")}
    assert {r["column"]: r["meaning"] for r in s.parts.where("table = 'd'").collect()}["address"] == "subject_address"
    roles = {r["table"]: r["role"] for r in L.table_roles(tables, reg).collect()}
    assert roles == {"a": "claim_subject", "b": "lookup_or_provenance", "c": "attribution", "d": "claim_subject", "e": "unknown"}


def test_citations_among_long_texts_of_many_lengths(spark, make, reg):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(n)).strip() for n in range(3, 603)] + ["Aaa", "aaaa", "AAAAA", "ab", "İ-list", "the i̇-list of 2020", "line\nbreak here", "e\nb"]
    long = ["".join(rnd.choice("abcdefghij ") for _ in range(10_000)) for _ in range(3)]
    long[1] = long[1][:5000] + texts[300] + long[1][5000:]
    long[2] = texts[1] + long[2] + texts[590]
    rows = make([dict(address=str(i), prov_family=x) for i, x in enumerate(texts + [x.strip() for x in long])])
    distinct = {x for x in (x.strip() for x in texts + long) if x}
    want = {(a, b) for a in distinct for b in distinct if a != b and len(b) >= 3 and b.lower() in a.lower()}
    assert {(r.citing, r.cited) for r in L.citations(rows.repartition(5), reg).collect()} == want and len(want) > 20
    assert L.citations(rows.limit(0), reg).count() == 0


def test_equal_cells_are_judged_once(spark, reg):
    values = [BTC[0], HEX[0], "7", "2024-01-02", "mixer", "btc", " "]
    rows = table(spark, ["a", "b"], [(values[i % 7], str(i + 5)) for i in range(700)])
    df = P.column_profiles(P.column_cells(rows), reg)
    got = by(df, "column")
    a, b = got["a"], got["b"]
    assert (a["n"], a["distinct"], a["counter"], b["n"], b["distinct"], b["counter"]) == (600, 6, False, 700, 700, True)
    assert (a["numeric"], a["date"], a["address_bitcoin"], a["address_evm"]) == pytest.approx((1 / 6,) * 4) and a["chains"] == ["bitcoin"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("HashAggregate")          # checksums come after equal cells are one
    assert "Exchange" in plan[plan.rindex("ArrowEvalPython"):]
