"""Readers and adapters on tiny files of each public shape, and what is written back."""
import gzip
import hashlib
import json

import pytest
from conftest import by
from pyspark.sql import functions as F

from attestra.operators import claims as C
from attestra.sinks import writers as wr
from attestra.sources import adapters as A, readers as R

ID = [f"1{c}" * 12 + "QQQQQQQQQQQQ" for c in "mnpqrstuvw"]      # only the length matters here


@pytest.fixture
def files(tmp_path):
    (tmp_path / "classes.csv").write_text(f"address,class\n{ID[0]},1\n{ID[1]},2\n{ID[2]},3\ntooshort,1\n{ID[3]},9\n")
    (tmp_path / "curated.csv").write_text(f"address,category,source\n{ID[0]},marketplace,Montréal\n{ID[3]},BET,BitcoinTalk\n\"{ID[4]}\",new word,Padua\n", encoding="utf-8")
    (tmp_path / "ransom.csv").write_text(f"address;family;source;SUM_REC_USD\n{ID[4]};Fam1;RSH;12.5\n{ID[5]};Fam2;S;bad\n")
    (tmp_path / "mixers.csv").write_text(f"address,family,source\n{ID[6]},Blender,S\n")
    records = [dict(address=ID[4], blockchain="bitcoin", family="Fam1", updatedAt="2024-05-06T01:02:03Z", transactions=[{"amountUSD": 10}, {"amountUSD": 5.5}, {"amountUSD": None}]),
               dict(address="0xOther", blockchain="ethereum", family="x")]
    (tmp_path / "wrapped.json").write_text(json.dumps({"result": records}))
    (tmp_path / "bare.json").write_text(json.dumps(records))
    packs = tmp_path / "tree" / "packs" / "deep"
    packs.mkdir(parents=True)
    (packs / "one.yaml").write_text("creator: Crew\nlastmod: 2023-01-02\nlabel: pack label\nconfidence: web_crawl\ntags:\n"
                                    f"  - {{address: {ID[7]}, label: 'x mixing service y', confidence: forensic}}\n  - {{address: {ID[8]}, label: Pool, currency: ETH}}\n"
                                    f"  - {{address: {ID[9]}, category: sanctions, abuse: nothing, lastmod: 2022-03-04}}\n  - {{label: no address}}\n")
    (packs / "bad.yaml").write_text("a: [1, 2\n")
    (packs / "other.yaml").write_text("just: text\n")
    (tmp_path / "notes.csv").write_text(f"#{ID[9]},btc,tormarket,hydra-market,,http://x\n{ID[7]},BTC,ransomware,fam,,http://y\n{ID[8]},eth,ransomware,z,,http://z\n")
    return tmp_path


def test_adapters_build_one_table(spark, reg, files):
    parts = [A.coded_classes(spark, f"{files}/classes.csv", reg), A.curated_categories(spark, f"{files}/curated.csv", reg),
             A.family_list(spark, f"{files}/ransom.csv", "rodwald_ransom", "ransomware", ";"), A.family_list(spark, f"{files}/mixers.csv", "rodwald_mixers", "mixer"),
             A.crowd_reports(spark, f"{files}/wrapped.json"), A.tag_packs(spark, f"{files}/tree", reg), A.annotation_list(spark, f"{files}/notes.csv", reg)]
    rows, dropped, warnings = A.build(parts, reg)
    got = {k: (v["canon"], v["polarity"], v["prov_family"], v["lastmod"], v["heuristic"], v["subcat"]) for k, v in by(rows, "source", "address").items()}
    assert got == {
        ("ellipticpp", ID[0]): ("illicit_unspec", "illicit", "elliptic_undisclosed", "", "undisclosed", ""),
        ("ellipticpp", ID[1]): ("licit_unspec", "licit", "elliptic_undisclosed", "", "undisclosed", ""),
        ("ellipticpp", ID[2]): ("unknown", "unknown", "elliptic_undisclosed", "", "undisclosed", ""),
        ("schnoering", ID[0]): ("darknet_market", "illicit", "schnoering:Montréal", "", "multi_input", "Montréal"),
        ("schnoering", ID[3]): ("gambling", "licit", "schnoering:BitcoinTalk", "", "multi_input", "BitcoinTalk"),
        ("schnoering", ID[4]): ("unknown", "unknown", "schnoering:Padua", "", "multi_input", "Padua"),
        ("rodwald_ransom", ID[4]): ("ransomware", "illicit", "rodwald:RSH", "", "inherited", "Fam1"),
        ("rodwald_ransom", ID[5]): ("ransomware", "illicit", "rodwald:S", "", "inherited", "Fam2"),
        ("rodwald_mixers", ID[6]): ("mixer", "illicit", "rodwald:S", "", "inherited", "Blender"),
        ("ransomwhere", ID[4]): ("ransomware", "illicit", "ransomwhere:crowd", "2024-05-06", "none", "Fam1"),
        ("tagpack", ID[7]): ("mixer", "illicit", "tagpack:Crew", "2023-01-02", "curated", "forensic"),
        ("tagpack", ID[9]): ("sanctioned", "illicit", "tagpack:Crew", "2022-03-04", "curated", "web_crawl"),
        ("watchyourback", "#" + ID[9]): ("unknown", "unknown", "wyb:manual", "", "manual_verified", "hydra-market"),
        ("watchyourback", ID[7]): ("ransomware", "illicit", "wyb:manual", "", "manual_verified", "fam")}
    assert {r.source: r.n_dropped for r in dropped.collect()} == {"ellipticpp": 1}
    assert sorted(r.source for r in warnings.collect()) == ["ellipticpp", "tagpack"]
    # filling is opt-in and touches unknown labels only
    filled, _, _ = A.build(parts, reg, fill_unknown=True)
    changed = {k: v["canon"] for k, v in by(filled, "source", "address").items() if v["canon"] != got[k][0]}
    assert changed == {("watchyourback", "#" + ID[9]): "darknet_market"}
    # the build is written, read back, and its marker is dropped only in the working identifier
    wr.write_observations(rows, f"{files}/obs_csv", "csv")
    wr.write_observations(rows, f"{files}/obs", "parquet", partition_by_source=True)
    back = C.stamp(R.observations(spark, f"{files}/obs_csv"), reg)
    assert back.count() == len(got) == spark.read.parquet(f"{files}/obs").count()
    marked = back.where("raw_address <> address").collect()
    assert [(r.address, r.raw_address, r.root) for r in marked] == [(ID[9], "#" + ID[9], "ofac_sdn")]
    m = {r.source: (r.claims, r.addresses, r.dropped) for r in wr.manifest(rows, dropped, warnings).where("warning IS NULL").collect()}
    assert m[None] == (14, 9 + 1, 0) and m["ellipticpp"] == (3, 3, 1)


def test_bare_and_wrapped_records_are_the_same(spark, files):
    rows = [sorted(map(tuple, A.crowd_reports(spark, f"{files}/{f}.json").rows.drop("n").collect())) for f in ("bare", "wrapped")]
    assert rows[0] == rows[1] and len(rows[0]) == 1


def test_values_and_anchors(spark, files):
    rev = A.revenue_rows(spark, f"{files}/ransom.csv", f"{files}/wrapped.json")
    assert {(r.dataset, r.address): r.usd for r in rev.collect()} == {("rodwald_ransom", ID[4]): 12.5, ("rodwald_ransom", ID[5]): 0.0, ("ransomwhere", ID[4]): 15.5}
    anchors = A.anchor_addresses(spark, f"{files}/notes.csv", f"{files}/tree")
    assert [r.address for r in anchors.collect()] == [ID[7]]
    wr.write_anchors(anchors, f"{files}/anchors")
    assert [r.address for r in R.anchors(spark, f"{files}/anchors").collect()] == [ID[7]]


def test_csv_cells_stay_text(spark, tmp_path):
    text = '﻿address,label,n\n1,"two\nlines, quoted ""x""",007\n,,\n'
    (tmp_path / "a.csv").write_bytes(text.encode() + b"3,\xff\xfe,1e3\n")
    with gzip.open(tmp_path / "a.csv.gz", "wb") as f:
        f.write(text.encode() + b"3,\xff\xfe,1e3\n")
    for name in ("a.csv", "a.csv.gz"):
        df = R.csv_table(spark, f"{tmp_path}/{name}")
        assert df.columns == ["row_id", "address", "label", "n"]
        rows = [tuple(r)[1:] for r in df.orderBy("row_id").collect()]
        assert rows[0] == ("1", 'two\nlines, quoted "x"', "007") and ("", "", "") in rows and rows[-1][2] == "1e3"


def test_the_order_of_rows_holds_over_files(spark, tmp_path):
    """Spark deals out large files first; the last row of an address is still that of the last file."""
    head = "address,ground_truth_label,ground_truth_source\n"
    for sizes in ((1, 5000), (5000, 1)):
        d = tmp_path / f"g{sizes[0]}"
        d.mkdir()
        for name, word, n in zip("ab", ("first", "second"), sizes):
            (d / f"{name}.csv").write_text(head + "".join(f"{name}{i},x,r\n" for i in range(n)) + f"X,{word},r\n")
        got = {r.address: r.label for r in R.ground_truth(spark, str(d)).where("address = 'X'").collect()}
        assert got == {"X": "second"}
        cols = ",".join(R.OBSERVATION)
        for name, n in zip("cd", sizes):
            (d / f"{name}.obs").write_text(cols + "\n" + "".join(f"{name}{i}" + "," * (len(R.OBSERVATION) - 1) + "\n" for i in range(n)))
        rows = R.observations(spark, [f"{d}/c.obs", f"{d}/d.obs"], multi_line=False).orderBy("claim_seq").collect()
        assert [r["claim_seq"] for r in rows] == list(range(sum(sizes)))
        assert [r["address"] for r in rows] == [f"c{i}" for i in range(sizes[0])] + [f"d{i}" for i in range(sizes[1])]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from attestra.session import shared_folder
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master)))


def test_ground_truth_and_revenue_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("address,ground_truth_label,ground_truth_source\na,x,r1\nb,y,r2\na,z,r3\n")
    assert {r.address: (r.label, r.root) for r in R.ground_truth(spark, f"{tmp_path}/g.csv").collect()} == {"a": ("z", "r3"), "b": ("y", "r2")}
    (tmp_path / "r.csv").write_text("address,dataset,usd,family,src_letters\na,d,1.5,f,R\nb,d,,f,\n")
    assert [r.usd for r in R.revenue(spark, f"{tmp_path}/r.csv").orderBy("claim_seq").collect()] == [1.5, 0.0]


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("v"))
    a = R.sampled_column(rows, "v", 50, 1)
    b = R.sampled_column(rows.orderBy(F.desc("row_id")).repartition(7), "v", 50, 1)
    assert a.collect() == b.collect() and a.count() == 50 and a.where("value = ''").count() == 0
    assert max(r.row_id for r in a.collect()) > 500


def test_formula_cells_are_neutralised(spark):
    cells = ["=1+1", "+x", "-x", "@x", "\tx", "\rx", "x=1", "", "1-2"]
    df = wr.safe_cells(spark.createDataFrame([(c,) for c in cells] + [(None,)], "c string"))
    assert [r.c for r in df.collect()] == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", "'\rx", "x=1", "", "1-2", ""]


def test_columns_are_sampled_at_once(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit(" v"), "id")).alias("a"), (F.col("id") * 2).cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    got = {tuple(r) for r in R.sampled_columns(rows, 40, 9).collect()}
    assert got == {tuple(r) for r in R.sampled_columns(rows.orderBy(F.desc("row_id")).repartition(7), 40, 9).collect()}
    draw = lambda c, i: hashlib.md5(f"9:{c}:{i}".encode()).hexdigest()
    want = {("a", i, f"v{i}") for i in sorted((i for i in range(500) if i % 3), key=lambda i: draw("a", i))[:40]} | {("b", i, str(2 * i)) for i in sorted(range(500), key=lambda i: draw("b", i))[:40]}
    assert got == want
    pairs = R.sampled_pairs(rows, "a", "b", 30, 2).collect()
    assert len(pairs) == 30 and all(r["row_id"] % 3 and r["first"] == f"v{r['row_id']}" for r in pairs)
    assert R.sampled_columns(rows.limit(0), 5).count() == 0


def test_samples_order_only_cells_that_can_be_drawn(spark):
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), "id").alias("a"), F.when(F.col("id") < 7, "x").alias("b"))
    df = R.sampled_columns(rows, 40, 9)
    draw = lambda c, i: hashlib.md5(f"9:{c}:{i}".encode()).hexdigest()
    want = {("a", i, f"v{i}") for i in sorted(range(30_000), key=lambda i: draw("a", i))[:40]} | {("b", i, "x") for i in range(7)}
    assert {tuple(r) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[plan.index("row_number"):]           # cells meet their column's bound before they are ordered


def test_packs_are_parsed_once_and_as_pyyaml_reads_them(spark, reg, tmp_path):
    """Rows and warnings come from one parse, written down; marks that libyaml reads otherwise are read by PyYAML's own parser."""
    import yaml

    packs = {"a": "label: one\ntags:\n- {address: a1, label: x y, lastmod: 2024-01-02}\n- address: 12\n  confidence: yes\n", "b": "tags: [{address: http://x.y/z?q}]\n", "c": "tags:\n- address: a3\n  label: a\tb\n",
             "d": "{broken: [", "e": "tags:\n- address: !!str 7\n  label: |\n    two\n    lines\n", "f": "%x", "g": '{"tags": [{"address": "\\u00e9\\/", "label": false}]}'}
    folder = tmp_path / "packs"
    folder.mkdir()
    for name, text in packs.items():
        (folder / f"{name}.yaml").write_text(text, encoding="utf-8")
    found = A.tag_packs(spark, str(tmp_path), reg)
    for f in folder.iterdir():
        f.write_text("tags: []\n")
    want, errors = [], []
    for text in packs.values():
        try:
            pack = yaml.safe_load(text)
        except yaml.YAMLError as e:
            errors.append(f"unreadable pack: {type(e).__name__}")
            continue
        want += [(str(t["address"]), str(t.get("label") or pack.get("label") or "")) for t in pack["tags"]]
    assert sorted((r["address"], r["raw_label"]) for r in found.rows.collect()) == sorted(want)
    assert sorted(r["warning"] for r in found.warnings.collect()) == sorted(errors)
