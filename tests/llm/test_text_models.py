"""Language, quality, toxicity and personal data on small tables: held-out accuracy, brute force and odd rows."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import language, pii, quality, toxicity
from attestra.llm.common import WORD

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, base string, t string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), 0.5, "b", "t") for i, t, x in rows], DOCS)


@pytest.fixture(scope="module")
def speech(spark):
    rng = np.random.default_rng(1)
    words = {"en": "the of and thing erst thou what blear".split(), "de": "der und ich sch heit keit über für".split()}
    rows = [(i, " ".join(rng.choice(words[x], 30)), x) for i, x in enumerate(["en", "de"] * 60)]
    odd = [(200, None, "en"), (201, "", None), (202, "12 !?", "de"), (203, "und der " * 60000, None), (203, "und der " * 60000, None), (None, "the of and", "en")]
    return docs(spark, rows + odd)


def test_language_network(spark, speech):
    net = language.fit(speech.where("doc_id % 5 <> 0"), F.col("lang"), per_language=100)
    got = language.identify(speech, net).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(got) == 126 and all(0 <= s <= 1 for v in by.values() for _, s in v)
    assert sum(by[i][0][0] == ("en", "de")[i % 2] for i in range(0, 120, 5)) == 24
    assert by[200] == by[201] == by[202] == [("und", 0.0)]
    assert by[203][0] == by[203][1] and by[203][0][0] == "de"
    assert language.identify(speech.limit(0), net).count() == 0
    assert {r["lang_pred"] for r in language.identify(speech, language.fit(speech.limit(0), F.col("lang"))).collect()} == {"und"}


def test_network_gradient():
    """Training moves along the numeric gradient of the loss."""
    net = language.Network(["a", "b"], window=16, dim=3, widths=(2, 3), filters=2)
    x, y = np.random.default_rng(0).integers(1, 200, (8, 16)).astype(np.uint8), np.array([0, 1] * 4)
    loss = lambda: -np.log(net.predict(x)[np.arange(8), y]).mean()
    before = loss()
    net.train(x, y, epochs=30, batch=8, rate=0.02)
    assert loss() < 0.5 * before


def test_windows_hold_the_whole_text():
    text = "Ä" * 700
    w = language.as_windows(text, 256)
    assert w.shape == (6, 256) and w.tobytes().rstrip(b"\0") == text.lower().encode()
    assert language.as_windows("", 256).shape == (1, 256)


@pytest.fixture(scope="module")
def insults(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[::6] = ["scum", "idiot"] * 3 + ["moron"]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(i % 4 == 0), 1))
    rows += [(900, None, None), (901, "", None), (902, "w1 " * 100000 + "idiot scum", None), (903, "idiot scum moron", None), (903, "idiot scum moron", None)]
    labels += [(1, None, None), (None, 1, 0)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxicity(insults):
    d, labels = insults
    got = {r["doc_id"]: r for r in toxicity.score(d, labels, F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1).collect()}
    held = [got[i] for i in range(400) if i % 3 == 2]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert got[900]["score"] == got[901]["score"] == pytest.approx(0.25, abs=0.05) and got[902]["predicted"] == 0 and got[903]["predicted"] == 1
    assert toxicity.score(d, labels.limit(0), F.lit(True), F.lit(True)).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(d.limit(0), labels, F.lit(True), F.lit(True)).count() == 0


def test_toxicity_counts_and_evidence(spark):
    """Counts over the partitions equal plain counts, and a document's evidence is the mean of its words' and pairs' ratios."""
    rows = spark.createDataFrame([("a b a c", 1), ("a b b", 0), ("a b a b a b", 1), ("", 0), (None, 0)] * 40, "text string, toxic int").repartition(3)
    m = toxicity.fit(rows, least_share=1e-9)
    assert set(m.words) == {"a", "b", "c"}
    text = "a b z a c".split()
    ids = [m.words.get(w, 0) for w in text]
    pairs = dict(zip(m.pairs.tolist(), m.pair))
    want = m.word[ids[0]] + sum(pairs.get(h * len(m.word) + w, m.rest[h] + m.word[w]) for h, w in zip(ids, ids[1:]))
    got = m.evidence([["a"], text, [], ["b", "b"]])
    assert got[1] == pytest.approx(want / 5) and np.isnan(got[2]) and got[0] == pytest.approx(m.word[m.words["a"]])


@pytest.mark.parametrize("most_sent", [10 ** 6, 3, 0])
def test_toxicity_tables_keep_rare_words(spark, insults, most_sent):
    """Tables give the evidence of the model in memory, also where tasks hold few of their rows; a toxic word of 1.4 millionths counts."""
    d, labels = insults
    rows = d.join(labels.where("toxic IN (0, 1)"), "doc_id").select("text", "toxic")
    many = spark.createDataFrame([("vile " * 4, 1), ("pad " * 700_000, 0), ("pad " * 2_000_000, 1), ("gross thing", 1)] + [("vile gross", 1)] * 4, "text string, toxic int")
    learned = rows.union(many)
    told, other, _ = toxicity.tables(learned)
    got = toxicity.table_evidence(d, told, other, most_sent).collect()
    want = toxicity.evidence(d, toxicity.fit(learned)).collect()
    of = lambda rs: sorted((str(r["doc_id"]), r["n_words"], round(r["evidence"] or 0.0, 9), r["evidence"] is None) for r in rs)
    assert of(got) == of(want)


def test_toxicity_pairs_by_part(spark):
    """A part shuffles and keeps only its own pairs: those kept themselves, and of rare ones how many kept words lead to each word."""
    texts = ["a b c a b", "a b d", "b c x", "c y d", "y", "z c", "", None, "a"] + [f"u{i} c" for i in range(5)]
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, toxic int").repartition(3)
    words = Counter(w for t in texts for w in (t or "").split())
    pairs = Counter(p for t in texts for p in zip((t or "").split(), (t or "").split()[1:]))
    h = {w: int(toxicity._hashed(w)[0]) for w in words}
    kept = spark.createDataFrame([(h[w],) for w, n in words.items() if n >= 2], "key bigint")
    often = F.col("ordinary") + F.col("toxic") >= 2
    got = [r for part in range(3) for r in toxicity._pairs(rows, kept, often, part, 3).collect()]
    assert {(r["b"], r["a"], r["ordinary"] + r["toxic"]) for r in got if r["b"] is not None} == {(h[b], h[a], n) for (b, a), n in pairs.items() if n >= 2}
    rare = Counter()
    for r in got:
        rare.update({r["a"]: r["follows"] or 0})
    want = Counter(h[a] for (b, a), n in pairs.items() if n < 2 and words[b] >= 2)
    assert {k: n for k, n in rare.items() if n} == want
    parts = [toxicity._pair_counts(rows, part, 3) for part in range(3)]
    assert all(r["b"] % 2 ** 64 % 3 == part for part, p in enumerate(parts) for r in p.collect()) and sum(p.count() for p in parts) == len(pairs)


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(40)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, "en"))
        labels.append((i, 0, int(not bad)))
    rows += [(800, None, None), (801, "", "de"), (802, "Good words here. " * 30000, "en"), (803, "Abc def.", "en"), (803, "Abc def.", "en")]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_quality(graded):
    d, labels = graded
    got = {r["doc_id"]: r for r in quality.score(d, labels.where("doc_id % 2 = 0")).collect()}
    odd = [got[i] for i in range(400) if i % 2]
    assert all(r["keep"] == (r["doc_id"] % 5 != 0) for r in odd) and len(got) == 404
    left = [r["doc_id"] for r in quality.accepted(d, labels).collect()]
    assert left.count(803) in (0, 2) and sum(i < 400 for i in left) == 320
    assert quality.score(d, labels.limit(0)).where("keep").count() == 405       # nothing learned, nothing rejected
    assert quality.score(d.limit(0), labels).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TEXTS = ["a@b.c-d@e.f_g@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.01 +1 (487) 555-7209 4111 1111 1111 1111-", "+12\x01 345 é😀 a@b.co \x02", None, "",
         "9" * 30000 + " +" + "1" * 30000, "x@y.z@w.v 4111-1111-1111-1111 0000 0000 0000 0000", "+49 30 123456789012345 1.1.1.1@x.y +4111 1111 1111 1111", "a@b a@b. @c.d a@@b.c",
         'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and no more']


def test_pii_base_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("ab1234.+@-( )é"), int(rng.integers(1, 60)))) for _ in range(300)]
    rows = docs(spark, list(enumerate(texts, 0)) and [(i, t, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii.report(rows).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        listed = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w[3] == k for w in want) for k in PATTERNS]
        assert set(listed.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii.report(rows.limit(0)).count() == 0


def test_pii_learns_and_redacts(spark):
    texts = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f9%02d" said' % i for i in range(30)] + ["the number 26691094489452%02d of it" % i for i in range(60)]
    rows = docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(100, None, None), (101, "mail a@b.co or 1.2.3.4 now", None), (101, "mail a@b.co or 1.2.3.4 now", None)])
    got = {r["doc_id"]: r["spans"] for r in pii.report(rows).collect()}
    assert all(got[i] == "secret:9:49" for i in range(30))
    cards = [i for i in range(30, 90) if luhn(re.search("[0-9]+", texts[i]).group())]
    assert [i for i in range(30, 90) if got[i]] == cards
    clean = pii.redact(rows)
    assert clean.columns == rows.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[0] == 'token = "[SECRET]" said' and text[100] is None and text[101] == "mail [EMAIL] or [IP] now" and clean.count() == 93


def test_pii_plan_has_no_python(spark):
    rows = docs(spark, [(1, "a@b.co", None)])
    plan = pii.scan(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_words():
    assert WORD.findall("Über-Zeit a_b 12") == ["Über", "Zeit", "a_b", "12"]


def test_candidates_need_no_two_digits_in_a_row(spark):
    rows = spark.createDataFrame([(1, "token = aB3xK9qLm2ZpT7vRw4Ys"), (2, "token = aB3xK9qLm2ZpT7vRw4Ys 12"), (3, "no digits at all, token = abcdefghijklmnop")], "doc_id bigint, text string")
    got = {r["doc_id"]: [(c["start"], c["end"], c["kind"]) for c in r["candidates"]] for r in pii.scan(rows).collect()}
    assert got[1] == got[2] == [(8, 28, "secret")] and got[3] == []


def test_pii_estimates_equal_a_plain_loop_over_candidates(spark):
    rng = np.random.default_rng(8)
    ways = [lambda k: f'token = "aB3xK9qLm2ZpT7vRw4Y{k:04d}" said', lambda k: f"page {k:04d}{k * 7919 % 10**7:07d} of it", lambda k: f"call 415-555-{k:04d} now", lambda k: f"ssn {k % 900 + 100}-22-{k:04d}",
            lambda k: f"/x/{'ab' * 9}{k:04d}/ and {k * 104729 % 10**11:011d}, {k * 1299709 % 10**11:011d}, 12345678901"]
    rows = docs(spark, [(k, " . ".join(ways[int(w)](k) for w in rng.integers(0, 5, 3)), None) for k in range(200)])
    found = [c for r in pii.scan(rows).collect() for c in r["candidates"]]
    votes = np.array([[int(v) for v in c["votes"]] for c in found])
    trust, share = np.full(len(pii.LABELERS), 0.8), 0.5

    def belief():
        odds = votes @ np.log(trust / (1 - trust)) + np.log(share / (1 - share))
        return 1 / (1 + np.exp(-odds))

    for _ in range(15):
        p = belief()
        right = ((votes == 1) * p[:, None] + (votes == -1) * (1 - p)[:, None]).sum(0)
        trust, share = np.clip((right + 8) / ((votes != 0).sum(0) + 10), 0.6, 0.99), min(max(p.mean(), 0.02), 0.5)
    p, total = belief(), len(found)
    judge = pii.learn(pii.scan(rows))
    assert judge.share == pytest.approx(share) and [judge.reliability[x] for x in pii.LABELERS] == pytest.approx(trust.tolist())
    told = {f: (sum(p[i] for i, c in enumerate(found) if f in c["features"]), sum(1 - p[i] for i, c in enumerate(found) if f in c["features"])) for c in found for f in c["features"]}
    assert judge.log_odds == pytest.approx({f: np.log((y + 0.5) / (share * total + 1)) - np.log((n + 0.5) / ((1 - share) * total + 1)) for f, (y, n) in told.items()})
    want = [np.log(share / (1 - share)) + sum(judge.log_odds[f] for f in c["features"]) > 0 for c in found]
    got = {r["doc_id"]: r["spans"] for r in pii.report(rows).collect()}
    kept = {(r["doc_id"], f"{c['kind']}:{c['start']}:{c['end']}") for r in pii.scan(rows).collect() for c in r["candidates"] if f"{c['kind']}:{c['start']}:{c['end']}" in got[r["doc_id"]].split(",")}
    assert len(kept) == sum(want) and 0 < sum(want) < total


def test_pii_many_matches_in_one_text(spark):
    """Places, contexts, overlaps and replacement against plain Python, with base spans and candidates mixed at random."""
    rng = np.random.default_rng(9)
    words = ["mail a@b.co", "é😀", "1.2.3.4", "4111 1111 1111 1111", "415-555-1234", "token = aB3xK9qLm2ZpT7vRw4Ys", "+49 30 1234567890", "123-45-6789", "x" * 1500, "12345678"]
    texts = [" ".join(words[int(w)] for w in rng.integers(0, len(words), int(n))) for n in (1, 2, 3, 7, 50, 400, 3000)]
    rows = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    pattern = re.compile(r"(?<![\w])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9](?:[ -]?[0-9]){7,18}|"
                         r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,})(?!\w)")
    for r in pii.scan(rows).collect():
        t = texts[r["doc_id"]]
        base = base_spans(t)
        assert [(b["start"], b["end"], b["kind"]) for b in r["base"]] == [(a, e, k) for a, _, e, k in base]
        free = [m for m in pattern.finditer(t) if not any(a < m.end() and m.start() < e for a, _, e, _ in base)]
        assert [(c["start"], c["end"]) for c in r["candidates"]] == [m.span() for m in free]
        for c, m in zip(r["candidates"], free):
            left = t[max(0, m.start() - 32):m.start()]
            assert c["votes"][2] == bool(re.search(pii.SENSITIVE, left)) and ("sign:y" in c["features"]) == bool(re.search("[=:]\\s*$", left))
    spans = {r["doc_id"]: r["spans"] for r in pii.report(rows).collect()}
    for r in pii.redact(rows).collect():
        t, at, out = texts[r["doc_id"]], 0, ""
        for s in filter(None, spans[r["doc_id"]].split(",")):
            kind, a, e = s.split(":")[0], *map(int, s.split(":")[1:])
            if a >= at:
                out += t[at:a] + f"[{kind.upper()}]"
            at = max(at, e)
        assert r["text"] == out + t[at:]


def test_pii_time_of_one_text_follows_its_matches(spark):
    text = " ".join(f"a{i}@b.co" if i % 2 else f"token = aB3xK9qLm2ZpT7vRw4Ys{i}" for i in range(60000))
    got = pii.report(docs(spark, [(1, text, None), (2, "-" * 200000 + "a-" * 100000, None)])).collect()
    assert {r["doc_id"]: r["n_email"] for r in got} == {1: 30000, 2: 0}
