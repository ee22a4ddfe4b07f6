"""Independence, agreement and self-consistency: stated cases, and brute force on random claims."""
import dataclasses
import random

import pytest
from conftest import by, one

from attestra.operators import agreement, overlap, roots, subjects as S

X, Y, U1, U2 = ("x", True), ("y", True), ("u1", False), ("u2", False)
#: claims (source, root); apparent, confirmed, unresolved sources, shared, min, max, circular
CASES = {"same root": ([("a", X), ("b", X)], (2, 1, 0, 1, 1, 1, True)), "distinct roots": ([("a", X), ("b", Y)], (2, 2, 0, 0, 2, 2, False)),
         "resolved and unresolved": ([("a", X), ("b", U1)], (2, 1, 1, 0, 1, 2, False)), "both unresolved": ([("a", U1), ("b", U2)], (2, 0, 2, 0, 1, 2, False)),
         "one source, two roots": ([("a", X), ("a", Y)], (1, 2, 0, 0, 2, 2, False)), "many sources, one root": ([("a", X), ("b", X), ("c", X)], (3, 1, 0, 2, 1, 1, True)),
         "mixed": ([("a", X), ("b", X), ("c", U1)], (3, 1, 1, 1, 1, 2, True)), "two roots, one shared": ([("s", X), ("t", Y), ("t", X)], (2, 2, 0, 1, 2, 2, True))}


def test_independence_cases(make, reg):
    rows = [dict(address=name, source=s, root=r, resolved=ok) for name, (spec, _) in CASES.items() for s, (r, ok) in spec]
    got = by(S.subject_table(make(rows), reg), "subject")
    for name, (_, want) in CASES.items():
        g = got[name]
        assert (g["n_sources"], g["confirmed_roots"], g["unresolved_sources"], g["shared_roots"], g["independence_min"], g["independence_max"], g["circular"]) == want, name
    assert S.collapsed_claims(make(rows), reg).where("subject = 'many sources, one root'").count() == 2


@pytest.mark.parametrize("cats,outcome", [
    (["mixer", "mixer"], "exact"), (["mixer", "illicit_unspec"], "hierarchical refinement"), (["mixer", "scam"], "entity-type conflict"),
    (["mixer", "exchange"], "licit/illicit conflict"), (["mixer", "unknown"], "incomparable"), (["unknown", "unknown"], "incomparable"),
    (["licit_unspec", "illicit_unspec"], "licit/illicit conflict"), (["elsewhere", "elsewhere"], "exact"), (["elsewhere", "mixer"], "entity-type conflict"),
    (["elsewhere", "illicit_unspec"], "hierarchical refinement"), (["here", "there"], "entity-type conflict")])
def test_outcomes(make, reg, cats, outcome):
    assert one(S.subject_table(make([dict(source=f"s{i}", canon=c) for i, c in enumerate(cats)]), reg))["outcome"] == outcome


def test_one_source_with_two_opinions_is_not_two_sources(make, reg):
    assert one(S.subject_table(make([dict(source="a", canon="mixer"), dict(source="a", canon="exchange"), dict(source="b", canon="unknown")]), reg))["outcome"] == "incomparable"


def test_a_deeper_branch_refines_and_siblings_conflict(make, reg):
    cat = reg.categories["exchange"]
    deep = dataclasses.replace(reg, categories={**reg.categories, "cex": dataclasses.replace(cat, name="cex", parent="exchange", aliases=()),
                                                "cex_desk": dataclasses.replace(cat, name="cex_desk", parent="cex", aliases=()),
                                                "dex": dataclasses.replace(cat, name="dex", parent="exchange", aliases=())})
    rows = [("1", ["exchange", "cex_desk", "cex"]), ("2", ["cex", "dex"]), ("3", ["exchange", "dex", "licit_unspec"]), ("4", ["cex_desk", "dex", "exchange"])]
    claims = make([dict(address=a, source=f"s{i}", canon=c) for a, cs in rows for i, c in enumerate(cs)])
    got = {k: v["outcome"] for k, v in by(S.subject_table(claims, deep), "subject").items()}
    assert got == {"1": "hierarchical refinement", "2": "entity-type conflict", "3": "hierarchical refinement", "4": "entity-type conflict"}


@pytest.mark.parametrize("claims,bucket", [
    ([("exchange", "e"), ("exchange", "e")], "repeated observation"), ([("exchange", "e"), ("exchange", "E again")], "repeated same label"),
    ([("illicit_unspec", "i"), ("ransomware", "r")], "compatible multi-label claim"), ([("exchange", "e"), ("ransomware", "r")], "internal contradiction"),
    ([("unknown", "a"), ("unknown", "b")], "uninterpretable multi-label"), ([("exchange", "e"), ("unknown", "x")], "uninterpretable multi-label"),
    ([("unknown", "a"), ("unknown", "a")], "repeated observation"), ([("illicit_unspec", "i"), ("ransomware", "r"), ("ransomware", "again")], "compatible multi-label claim")])
def test_self_consistency(make, reg, claims, bucket):
    assert one(S.self_consistency(make([dict(source="u", canon=c, raw_label=r) for c, r in claims]), reg))["bucket"] == bucket


def test_two_chains_are_two_subjects(make, reg):
    rows = make([dict(source="u", canon="exchange", chain="bitcoin"), dict(source="u", canon="ransomware", chain="litecoin")])
    assert S.self_consistency(rows, reg).count() == 0


def _brute(rows, reg):
    out = {}
    for a in {r["address"] for r in rows}:
        cl = [r for r in rows if r["address"] == a]
        pairs = {(r["source"], r["root"], r["known"]) for r in cl}
        res = {(s, r) for s, r, k in pairs if k}
        roots_ = {r for _, r in res}
        cats = {r["canon"] for r in cl} - {"unknown"}
        if len({r["source"] for r in cl if r["canon"] != "unknown"}) < 2:
            o = "incomparable"
        elif len(cats) == 1:
            o = "exact"
        elif len({reg.categories[c].polarity for c in cats} - {"unknown"}) > 1:
            o = "licit/illicit conflict"
        else:
            spec = cats - set(reg.generic)
            line = {c: set(reg.lineage(c)) for c in spec}
            o = "hierarchical refinement" if len(spec) <= 1 or all(x in line[y] or y in line[x] for x in spec for y in spec) else "entity-type conflict"
        out[a] = (len(cl), len({r["source"] for r in cl}), len({s for s, _, k in pairs if not k}), len(roots_), len(res) - len(roots_), o)
    return out


def _random_rows(seed, n=400):
    rnd = random.Random(seed)
    cats = ["unknown", "mixer", "scam", "illicit_unspec", "exchange", "licit_unspec", "gambling"]
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.34                                   # one subject and one source hold a third of the rows
        root = rnd.choice(["x", "y", "z", "u", "v"])
        rows.append(dict(address="hot" if hot else f"a{rnd.randrange(60)}", source="big" if rnd.random() < 0.34 else f"s{rnd.randrange(4)}", canon=rnd.choice(cats),
                         root=root, resolved=root in "xyz", known=root in "xyz", seq=rnd.randrange(10 ** 6)))
    return rows


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 16)])
def test_random_claims_match_brute_force_under_any_partitioning(spark, make, reg, seed, partitions):
    rows = _random_rows(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        claims = make(rows).repartition(partitions)
        got = {k: (v["n_claims"], v["n_sources"], v["unresolved_sources"], v["confirmed_roots"], v["shared_roots"], v["outcome"])
               for k, v in by(S.subject_table(claims, reg), "subject").items()}
        assert got == _brute(rows, reg)
        # overlap, depth and kappa against direct counting
        named = {(r["source"], r["address"]) for r in rows}
        sets = overlap.source_set_counts(claims)
        for r in overlap.overlap_matrix(sets).collect():
            a, b = ({x for s, x in named if s == r[k]} for k in ("source", "other"))
            assert (r.intersection, r.share_of_source, r.jaccard) == (len(a & b), len(a & b) / len(a), len(a & b) / len(a | b))
        best = {}
        for s, a in named:
            cl = sorted((r for r in rows if r["source"] == s and r["address"] == a), key=lambda r: r["seq"])
            cnt = {}
            for r in cl:
                cnt[r["canon"]] = cnt.get(r["canon"], 0) + 1
            best[s, a] = max(cnt, key=lambda c: (cnt[c], -min(r["seq"] for r in cl if r["canon"] == c)))
        for r in agreement.kappa(claims, reg).collect():
            pairs = [(best[r.source_a, a], best[r.source_b, a]) for a in {x for _, x in named} if (r.source_a, a) in best and (r.source_b, a) in best]
            n, agree = len(pairs), sum(x == y for x, y in pairs) / len(pairs)
            pe = sum(sum(x == k for x, _ in pairs) * sum(y == k for _, y in pairs) for k in {c for p in pairs for c in p}) / n ** 2
            assert r.n == n and r.percent_agreement == pytest.approx(agree)
            assert r.cohen_kappa == (pytest.approx((agree - pe) / (1 - pe)) if abs(1 - pe) > 1e-12 else None)
        dom = {}
        for a in {x for _, x in named}:
            cl = [r for r in rows if r["address"] == a]
            cnt = {x: sum(r["root"] == x for r in cl) for x in {r["root"] for r in cl}}
            dom[a] = max(cnt, key=lambda x: (cnt[x], -min(r["seq"] for r in cl if r["root"] == x)))
        assert {r.subject: r.root for r in roots.dominant_root(claims).collect()} == dom
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_no_executor_side_state_grows_with_a_hot_subject(make, reg):
    """The plan never windows or collects over the claims of a subject: claims are combined by
    (subject, source, root) before the only exchange by subject."""
    plan = S.subject_table(make([dict(), dict(source="b")]), reg)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_" not in plan and "SortAggregate" not in plan
    # what is below each exchange of claims: an aggregate that has combined them already (a join's side may be combined twice)
    lines = plan.split("\n")
    fed = [next(x for x in lines[i + 1:] if "Sort " not in x and "AQE" not in x) for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert len(fed) >= 3 and all("HashAggregate" in x or "Project" in x for x in fed) and "partial_count" in plan


def test_every_category_outside_the_tree_counts(make, reg):
    rows = [dict(address="a", source=s, root="r", canon=c) for s, c in (("a", "odd1"), ("a", "odd2"), ("b", "odd3"), ("c", "odd4"), ("c", "mixer"))] + [dict(address="b", canon="mixer")]
    got = by(S.subject_table(make(rows), reg), "subject")
    assert (got["a"]["n_categories"], got["b"]["n_categories"]) == (5, 1)
    mine = [dict(address="a", source="s", raw_label=c, canon=c) for c in ("odd1", "odd2", "odd3", "odd4")]
    assert one(S.self_consistency(make(mine), reg))["n_categories"] == 4


def test_a_subject_with_very_many_roots(spark, make, reg):
    from pyspark.sql import functions as F
    base = make([dict(address="hot")]).drop("root", "claim_seq")
    rows = base.crossJoin(spark.range(200_000).select(F.col("id").alias("claim_seq"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("root"))).repartition(8)
    table = S.subject_table(rows, reg)
    got = one(table)
    assert (got["n_claims"], got["n_roots"], got["confirmed_roots"], got["n_sources"]) == (200_000, 200_000, 200_000, 1)
    assert "REPARTITION_BY_COL" not in table._jdf.queryExecution().executedPlan().toString()
