"""Rounding rules, intervals, resampling, metric records, pages."""
import math

import numpy as np
import pytest
from conftest import by, day, one
from pyspark.sql import functions as F

from attestra.functions import draws, stats
from attestra.operators import anchors, explore, inheritance, metrics, verification as V
from attestra.operators.subjects import subject_table


def test_comparison_rules(spark):
    metrics_rows = [("i", "12.5", "LIVE"), ("p", "0.12345", "LIVE"), ("d", "2.345", "LIVE"), ("r", "7", "LIVE"), ("s", "True", "LIVE"), ("f", "5", "FROZEN_MANIFEST"), ("x", "5", "SAMPLE_OBSERVED"), ("u", None, "UNAVAILABLE")]
    m = spark.createDataFrame(metrics_rows, "key string, value string, basis string")
    S = "SUPPORTING_STABLE"
    rows = [("i13", "i", S, "exact_integer", "13"), ("i12", "i", S, "exact_integer", "12"), ("p", "p", S, "rounded_percent", "0.1235", None, None, 2), ("p1", "p", S, "rounded_percent", "0.123", None, None, 1),
            ("d", "d", S, "rounded_decimal", "2.35", None, None, 2), ("d0", "d", S, "rounded_decimal", "2.34", None, None, 2), ("r", "r", S, "range", None, "7", "7"), ("r8", "r", S, "range", None, "8", None),
            ("s", "s", S, "exact_string", "True"), ("f", "f", S, "exact_integer", "5"), ("f6", "f", S, "exact_integer", "6"), ("x", "x", S, "exact_integer", "5"), ("u", "u", S, "exact_integer", "5"),
            ("odd", "i", S, "nearly", "5"), ("cls", "i", "NEW", "exact_integer", "13"), ("gone", "zz", "DIAGNOSTIC", "exact_integer", "5"), ("gone2", "zz", S, "exact_integer", "5")]
    d = spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) + ((r[7] if len(r) > 7 else 0), 1.0, "e", True) if len(r) < 8 else tuple(r[:7]) + (r[7], 1.0, "e", True) for r in rows], V.DECLARED)
    got = {k: v["status"] for k, v in by(V.verify(m, d), "id").items()}
    assert got == dict(i13="PASS", i12="FAIL", p="PASS", p1="PASS", d="PASS", d0="FAIL", r="PASS", r8="FAIL", s="PASS", f="NOT_REPRODUCED", f6="FAIL", x="NOT_REPRODUCED",
                       u="NOT_REPRODUCED", odd="FAIL", cls="FAIL", gone="NOT_REPRODUCED", gone2="FAIL")
    v = V.verify(m, d)
    assert V.overall(v).first()[0] == "FAIL" and V.overall(v.where("id IN ('i13', 'x')")).first()[0] == "BLOCKED" and V.overall(v.where("id IN ('i13', 'gone')")).first()[0] == "PASS"
    assert V.group_status(V.experiment_status(v), ["e"]).first()[0] == "FAIL"


def test_wilson_and_percentile(spark):
    lo, hi = stats.wilson(F.lit(8), F.lit(10), 0.95)
    r = spark.range(1).select(lo, hi, stats.index_percentile(F.array(*[F.lit(float(i)) for i in range(10)]), 0.25), stats.index_percentile(F.array().cast("array<double>"), 0.5)).first()
    assert (round(r[0], 4), round(r[1], 4), r[2], r[3]) == (0.4902, 0.9433, 2.0, None)


def test_resampling_is_exact_where_it_can_be(spark, make, reg):
    rows = [dict(address=f"{i}", source=s, root=f"r{i % 7}", canon="mixer" if i % 3 else ("scam" if s == "a" else "mixer")) for i in range(70) for s in ("a", "b")] \
        + [dict(address=f"u{i}", source="a", root="u", resolved=False) for i in range(10)]
    claims = make(rows)
    a = by(anchors.bootstrap(claims, reg, replicates=300), "statistic")
    b = by(anchors.bootstrap(claims.repartition(9), reg, replicates=300), "statistic")
    assert a == b                                                   # draws do not depend on how the table is split
    assert a["multi_source_rate"]["point"] == 70 / 80 and a["multi_source_rate"]["n_clusters"] == 8
    assert a["exact"]["point"] == 46 / 70 and a["exact"]["ci_low"] <= a["exact"]["point"] <= a["exact"]["ci_high"]
    up = by(anchors.bootstrap(claims, reg, upper=True, replicates=300), "statistic")
    assert up["multi_source_rate"]["n_clusters"] == 17 and up["exact"]["point"] == 46 / 70


def test_binomial_draws_have_the_exact_distribution(spark):
    cases = [(1, .5), (9, .3), (20, .45), (1000, .004), (1000, .02), (300, .93), (10 ** 12, 1e-12), (10 ** 9, .37)]
    rows = spark.createDataFrame([(float(n), p) for n, p in cases], "n double, p double").join(spark.range(20000))
    drawn = rows.select("n", "p", draws.binomial(F.col("n"), F.col("p"), F.concat_ws(":", F.lit("7"), "n", "p", "id")).alias("k"))
    for r in drawn.groupBy("n", "p").agg(F.avg("k").alias("mean"), F.variance("k").alias("var"), F.min("k").alias("low"), F.max("k").alias("high")).collect():
        mean, var = r["n"] * r["p"], r["n"] * r["p"] * (1 - r["p"])
        assert abs(r["mean"] - mean) < 5 * (var / 20000) ** .5 and abs(r["var"] / var - 1) < .06 and 0 <= r["low"] <= r["high"] <= r["n"]
    # each probability of a small and of a middling binomial, the second by rejection
    for n, p in ((9, .3), (300, .93)):
        seen = {int(r["k"]): r["count"] for r in drawn.where((F.col("n") == n) & (F.col("p") == p)).groupBy("k").count().collect()}
        for k in range(n + 1):
            want = 20000 * math.comb(n, k) * p ** k * (1 - p) ** (n - k)
            assert abs(seen.get(k, 0) - want) <= 5 * max(want, 1) ** .5
    fixed = spark.range(3).select(draws.binomial(F.lit(0.0), F.lit(.5), F.lit("a")), draws.binomial(F.lit(7.0), F.lit(0.0), F.lit("a")), draws.binomial(F.lit(7.0), F.lit(1.0), F.lit("a")))
    assert {tuple(r) for r in fixed.collect()} == {(0.0, 0.0, 7.0)}


def test_resampling_draws_as_many_clusters_as_there_are(spark):
    clusters = spark.createDataFrame([(g, i % k, 1) for g, k, n in (("a", 50, 700), ("b", 1, 3), ("c", 400, 400)) for i in range(n)], "g string, v int, one int")
    got = anchors.resampled(clusters, ["g"], ["v", "one"], 200, 5).collect()
    assert len(got) == 600 and {(r["g"], r["one"]) for r in got} == {("a", 700.0), ("b", 3.0), ("c", 400.0)}
    v = [r["v"] for r in got if r["g"] == "c"]
    mean, var = 400 * 199.5, 400 * (400 ** 2 - 1) / 12
    assert abs(sum(v) / 200 - mean) < 4 * (var / 200) ** .5 and .7 < sum((x - mean) ** 2 for x in v) / 200 / var < 1.4
    again = anchors.resampled(clusters.repartition(7), ["g"], ["v", "one"], 200, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    deep = anchors.resampled(clusters, ["g"], ["v", "one"], 20, 5, depth=0).collect()
    assert {(r["g"], r["one"]) for r in deep} == {("a", 700.0), ("b", 3.0), ("c", 400.0)}
    assert anchors.resampled(clusters.limit(0), [], ["v"], 5, 1).count() == 0


def test_anchors_exclude_their_own_root(spark, make, reg):
    truth = spark.createDataFrame([("1", "ransom", "ofac_sdn"), ("2", "cex", "ofac_sdn"), ("3", "nonsense", "ofac_sdn"), ("4", "cex", "ofac_sdn")], "address string, label string, root string")
    claims = make([dict(address="1", source="a", canon="ransomware", root="ofac_sdn"), dict(address="1", source="b", canon="ransomware", root="x"), dict(address="1", source="b", canon="scam", root="y"),
                   dict(address="1", source="b", canon="ransomware", root="w"), dict(address="2", source="b", canon="licit_unspec", root="x"), dict(address="2", source="c", canon="unknown", root="x"),
                   dict(address="3", source="b", canon="mixer", root="x"), dict(address="4", source="a", canon="exchange", root="ofac_sdn")])
    s = one(anchors.anchor_summary(claims, truth, reg))
    assert (s["anchors"], s["usable"], s["excluded_self_root_claims"], s["uninterpretable"]) == (4, 3, 2, 1)
    v = by(anchors.validation(claims, truth, reg), "source")
    assert set(v) == {"b", "c"}
    assert (v["b"]["n"], v["b"]["exact"], v["b"]["hierarchical"], v["b"]["independent_roots"], v["b"]["estimable"]) == (2, 1, 1, 2, True)
    assert (v["c"]["n"], v["c"]["incomparable"], v["c"]["agreement"], v["c"]["estimable"]) == (0, 1, None, False)


def test_every_metric_record_keeps_to_one_population(make, reg):
    rows = make([dict(address=str(i % 5), source="ab"[i % 2], canon=["mixer", "scam", "unknown"][i % 3], lastmod=["", "2020-01-01"][i % 2]) for i in range(12)])
    got = metrics.overview(rows.withColumn("raw_address", F.col("address")), reg, day("2024-01-01")).collect()
    for r in got:
        assert r.unit == ("claims" if r.population == metrics.CLAIMS else "addresses")
        assert (r.share is None) == (r.numerator is None or r.denominator is None)
        assert r.numerator is None or 0 <= r.numerator <= r.denominator
    m = {r.metric: r for r in got}
    assert m["multi_dataset"].value + m["single_source"].value == m["normalised_addresses"].value == 5
    assert sum(m[f"currency.{k}"].value for k in ("current", "stale", "currency_unknown")) == m["claims"].value == 12


def test_all_decode_verdicts(make, reg):
    codes = {"R": (6, 6), "S": (6, 0), "M": (6, 3), "Q": (3, 3), "R-S": (6, 6)}
    rows = [dict(address=f"{c}{i}", source="rodwald_ransom", prov_family=f"x:{c}") for c, (n, _) in codes.items() for i in range(n)] \
        + [dict(address=f"{c}{i}", source="ransomwhere") for c, (_, k) in codes.items() for i in range(k)]
    g = inheritance.decode_groups(make(rows), reg, "rodwald_ransom", "prov_family", "ransomwhere")
    assert {r.code: r.verdict for r in g.collect()} == {"R": "inherited", "S": "independent", "M": "mixed", "Q": "insufficient", "R-S": "malformed"}
    s = one(inheritance.decode_summary(g, reg))
    assert s["inherited_subjects"] == 6 + 3 + 6 and s["clean_split"] is False
    assert one(inheritance.decode_summary(g.where("code <> 'M'"), reg))["clean_split"] is True
    assert [r.letter for r in inheritance.decoded_letters(g).collect()] == ["R"]


def test_pages_join_up(make, reg):
    claims = make([dict(address=f"{i % 7}", source=f"s{i % 3}", seq=i) for i in range(30)])
    whole = explore.claims_page(claims, reg, 0, 500).collect()
    assert len(whole) == 30 and [tuple(r) for r in whole[10:15]] == [tuple(r) for r in explore.claims_page(claims, reg, 10, 5).collect()]
    last = whole[9]
    after = explore.claims_page(claims, reg, limit=5, after=dict(address=last.address, chain="", source=last.source, claim_seq=last.claim_seq)).collect()
    assert [tuple(r) for r in after] == [tuple(r) for r in whole[10:15]]
    assert explore.claims_page(claims, reg, 0, 5000).count() == 30
    with pytest.raises(ValueError):
        explore.claims_page(claims, reg, 0, 0)


def test_an_identifier_on_several_chains_is_ambiguous(make, reg):
    rows = make([dict(chain="ethereum", address="q", source="u"), dict(chain="polygon", address="q", source="u"), dict(address="7", source="a"), dict(address="7", source="b", canon="scam")])
    e = one(explore.explain(rows, reg, "q", day("2024-01-01")))
    assert e["ambiguous"] and not e["found"] and e["chains"] == ["ethereum", "polygon"]
    assert one(explore.explain(rows, reg, "q", day("2024-01-01"), chain="polygon"))["found"]
    e = one(explore.explain(rows, reg, "7", day("2024-01-01")))
    assert e["outcome"] == "entity-type conflict" and e["flags"] == ["conflicting", "circular", "currency-unknown"]
    assert not one(explore.explain(rows, reg, "nobody", day("2024-01-01")))["found"]
    assert subject_table(rows, reg).count() == 3


def test_pages_anywhere_read_only_their_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(None if rng.random() < 0.1 else str(int(rng.integers(0, 5))), i, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i bigint, part string")
    p = explore.pages(df, ["k", "i"], rows_per_part=60)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert p.total == 1000 and len(p.starts) == 18
    for offset, limit in [(0, 10), (990, 60), (137, 300), (p.starts[5], 1), (p.starts[5] - 1, 2), (999, 1), (0, 5000)]:
        assert [tuple(r) for r in p.page(offset, limit).collect()] == want[offset:offset + limit]
    assert p.page(1000, 5).count() == p.page(10 ** 12, 5).count() == 0
    late = p.page(995, 5)
    assert "PartitionFilters: [isnotnull(page_part" in late._jdf.queryExecution().executedPlan().toString()
    whole = lambda f: {r[0] for r in f.select(F.input_file_name()).distinct().collect()}
    assert len(whole(p.rows.where(F.col("page_part") == 16))) == 1 and len(whole(p.rows)) == 17
    none = explore.pages(df.limit(0), ["k", "i"])
    assert none.total == 0 and none.page(0, 5).columns == df.columns and none.page(0, 5).count() == 0
    with pytest.raises(ValueError):
        p.page(0, 0)
    with pytest.raises(ValueError):
        explore.pages(df.withColumnRenamed("part", "page_part"), ["k"])


def test_layout_by_address_skips_and_answers_alike(spark, reg, make):
    rows = make([dict(address=str(i % 400), source=f"s{i % 3}", seq=i) for i in range(4000)] + [dict(address="hot", seq=4000 + i) for i in range(4000)])
    laid_out = explore.by_address(rows, row_group_bytes=1 << 20)
    for a in ("7", "hot", "nobody"):
        assert one(explore.explain(laid_out, reg, a, day("2024-01-01"))) == one(explore.explain(rows, reg, a, day("2024-01-01")))
    assert sorted(map(tuple, laid_out.select(*rows.columns).collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert "PushedFilters: [IsNotNull(address), EqualTo(address,7)]" in laid_out.where("address = '7'")._jdf.queryExecution().executedPlan().toString()


def test_ambiguous_identifiers(spark, reg, make):
    rows = make([dict(address="a", chain="x"), dict(address="a", chain="y"), dict(address="a", chain="y"), dict(address="b", chain="x"), dict(address="b"), dict(address="c", chain=""), dict(address="c", chain="x")])
    assert one(explore.ambiguous_identifiers(rows)) == dict(address="a", n_chains=2, chains=["x", "y"], n_claims=3)
    assert explore.ambiguous_identifiers(rows.limit(0)).count() == 0
    for chain, found in ((None, False), ("x", True), ("z", False)):
        e = one(explore.explain(rows, reg, "a", day("2024-01-01"), chain))
        assert e["found"] is found and e["ambiguous"] is (chain is None)


def test_parts_of_a_shuffle_follow_what_moves(spark):
    keys = spark.range(600_000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 512).alias("k"))
    assert keys.groupBy("k").count().select(F.spark_partition_id()).distinct().count() > 8          # the session asks for 4
