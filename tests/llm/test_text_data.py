"""Archives, packing, matrices, search, near duplicates, decontamination and the pipeline against brute force on small tables."""
import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import decontaminate, maxscore, near_duplicates as near, packing, pii, quality, queries, token_rows, tokens, warc
from attestra.llm.common import Hashes, hash_words, written
from workbench import run_queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, piece int, length string, part int, t string"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def docs(spark, texts):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 9, "l", 1, "t") for i, t in texts], DOCS)


ODD = [(0, None), (1, ""), (2, "a"), (2, "a"), (None, "some words"), (3, "long " * 9000), (4, "İstanbul <|endoftext|> 中文 \x1c x"), (5, "it's 12 ½ ÄÖ!")] + [
    (10 + i, "word " * (i % 7 + 1)) for i in range(40)]


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_word_by_word_ids_equal_the_tokenizer():
    rng = random.Random(1)
    chars = [chr(i) for i in range(0x20, 0x180)] + ["\n", "\t", "'s", "'LL", "!'s", "ſ", "İ", "\x85", "\x1c", "Σ", "ﬁ", "́", "<|endoftext|>", "²", "½", "中", "ŉ"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    got = tokens.Encoder(queries.tokenizer()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() + [0] for g in got] == whole_ids(texts)


def tiles(spans, capacity):
    """Whether (offset, length) cover a sequence from 0 without a gap."""
    at = 0
    for o, n in sorted(spans):
        assert o == at
        at += n
    assert at <= capacity


def test_packing_round_trip(spark):
    rows = docs(spark, ODD).repartition(3)
    got = packing.pack(rows, queries.tokenizer(), capacity=64).collect()
    want = sorted((str(i), k, k * 64, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for (i, _), ids in zip(ODD, whole_ids([t for _, t in ODD]))
                  for k, c in enumerate(ids[a:a + 64] for a in range(0, len(ids), 64)))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        tiles(spans, 64)
    assert len(by) <= 1.05 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack(rows.limit(0), queries.tokenizer()).count() == 0


def test_plan_is_as_good_as_best_fit_over_items():
    rng = random.Random(4)
    for capacity in (10, 97, 2048):
        sizes = [rng.randint(1, capacity) for _ in range(3000)]
        runs, used = packing.plan({x: sizes.count(x) for x in set(sizes)}, capacity)
        assert sum(r.count for r in runs) == len(sizes)
        tree = token_rows.Capacities(capacity)
        for x in sorted(sizes, reverse=True):
            tree.take(x)
        assert used <= tree.n


def test_segment_tree_finds_the_best_fit():
    rng, tree, room = random.Random(5), token_rows.Capacities(50), []
    for _ in range(2000):
        need = rng.randint(1, 50)
        bin_, offset = tree.take(need)
        fits = [r for r in room if r >= need]
        if bin_ == len(room):
            assert not fits
            room.append(50)
        assert not fits or room[bin_] == min(fits)
        assert offset == 50 - room[bin_]
        room[bin_] -= need


def test_matrices_lose_nothing(spark):
    rows = docs(spark, ODD).repartition(2)
    packed = written(token_rows.matrices(rows, queries.tokenizer(), capacity=64, shard_tokens=500))
    pieces = defaultdict(dict)
    for m in packed.collect():
        ids = np.frombuffer(m["ids"], "<u2").reshape(m["n_rows"], 64)
        for cu, resets in zip(m["cu_lengths"], m["resets"]):
            assert cu[0] == 0 and cu == sorted(cu) and cu[-1] <= 64 and resets == cu[:-1]
        for s in m["segments"]:
            pieces[(m["shard"], str(s["doc_id"]))].setdefault(s["start"], []).append(ids[s["row"], s["offset"]:s["offset"] + s["length"]].tolist())
    got = sorted(sum(map(len, itertools.chain.from_iterable(p.values()))) for p in pieces.values())
    assert sum(got) == sum(map(len, whole_ids([t for _, t in ODD])))
    read = token_rows.segments(packed).collect()
    want = sorted((str(i), k, k * 64, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for (i, _), ids in zip(ODD, whole_ids([t for _, t in ODD]))
                  for k, c in enumerate(ids[a:a + 64] for a in range(0, len(ids), 64)))
    assert sorted((str(r[0]), *r[1:5]) for r in read) == want
    assert token_rows.matrices(rows.limit(0), queries.tokenizer()).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "x" * 99, "x" * 99, "é😀\r\n\r\nWARC/1.1\r\n" * 50, "é😀\r\n\r\nWARC/1.1\r\n" * 50, "<p>" * 40000, "<p>" * 40000, "0\r\n\r\n" * 30]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, t, "o") for i, t in enumerate(html)] + [(4, None, html[4], "o"), (None, None, html[6], "o"), (None, None, "only null" * 20, "o")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(3)
    got = warc.round_trip(pages, segment_bytes=1000, chunk_bytes=300, records_per_file=7).collect()
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        other = len(raw) >= 100 and (t in first) and i != first[t]
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", str(first[t]) if other else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert all((bytes(r["payload"]).decode() == html[r["page_id"]] if html[r["page_id"]] else not r["payload"]) and r["verified"]
               for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunked_framing():
    for n in (0, 1, 5, 10, 4096):
        raw = os.urandom(n)
        assert warc.unchunked(warc.chunked(raw, 5)) == raw
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_lost_segment_is_noticed(spark):
    part = "page_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, origin string, segment int, total bigint, block binary"
    row = lambda n, total, b: ("1", None, "response", None, None, None, "o", n, total, b)
    whole = spark.createDataFrame([row(2, 4, b"cd"), row(1, None, b"ab")], part)
    assert bytes(warc.reassemble(whole).first()["block"]) == b"abcd"
    for bad in ([row(1, None, b"ab")], [row(1, None, b"ab"), row(3, 4, b"cd")], [row(1, None, b"ab"), row(2, 5, b"cd")]):
        with pytest.raises(Exception, match="segments"):
            warc.reassemble(spark.createDataFrame(bad, part)).collect()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], "q") for i in range(0, 700)]
    rows[50] = (50, rows[60][1], "q")
    rows += [(800, None, "q"), (801, [], "q"), (850, [1.0, None], "q"), (851, [float("nan")] * 8, "q"), (852, [float("inf")] * 8, "q"), (60, rows[60][1], "q"), (None, [9.0] * 8, "q"),
             (900, [0.5, 0.5], "q"), (100, rows[100][1], "q"), (100, rows[60][1], "q"), (7, rows[150][1], "q"), (7, rows[150][1], "q")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string").repartition(3)
    good = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for own, (q, v) in enumerate(good):
        if q is not None and q % 50 == 0:           # every other row is a candidate, equal ones and those of the same id too
            best = sorted(((-dot(v, w), 2 ** 63 if i is None else i, str(i)) for row, (i, w) in enumerate(good) if row != own))[:5]
            want += [(q, k, i, -s) for k, (s, _, i) in enumerate(best, 1)]
    got = maxscore.search(table, query_block=4, shard=100).collect()
    assert sorted((r["query_id"], r["rank"], str(r["vec_id"]), r["score"]) for r in got) == sorted(want)
    assert [r["vec_id"] for r in got if r["query_id"] == 150].count(7) == 2
    assert maxscore.search(table.limit(0)).count() == 0
    assert maxscore.search(table.where("vec_id = 200")).count() == 0


def test_maxscore_skips_work_without_losing_ties():
    rng = np.random.default_rng(8)
    m = rng.integers(-3, 4, (3000, 12))                # many equal scores
    ids = rng.permutation(3000)
    got = maxscore.shard_top(ids[:20], m[:20], ids, ids, m, 5, step=64)
    for q in range(20):
        s = m @ m[q]
        want = sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != ids[q])[:5]
        assert [(-s, i) for o, i, s in got if o == ids[q]] == want


@pytest.fixture(scope="module")
def alike():
    rng = random.Random(11)
    base = [[f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 200))] for _ in range(60)]
    texts = []
    for g, w in enumerate(base):
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = [x if rng.random() > 0.02 else f"u{rng.randint(0, 999)}" for x in w]
            texts.append(" ".join(own))
    texts += [base_text for base_text in texts[:10]] * 8 + ["a b", "A  b!", "a", None, None, "", "...", "line of five words here " * 4000]
    texts += ["shared opening of very many documents in this table " + " ".join(f"z{rng.randint(0, 9999)}" for _ in range(9)) for _ in range(80)]
    return list(enumerate(texts))


def test_near_duplicate_classes_equal_brute_force(spark, alike):
    got = {r["doc_id"]: r["class_id"] for r in near.classes_of(docs(spark, alike).repartition(4)).collect()}
    rows = near.documents(docs(spark, alike))
    weigh = near.Weights(*near.frequent_shingles(rows, 5, 0.1), 5, 0.1)
    sets = {i: weigh(w, {}) for i, t in alike if (w := near.WORD.findall((t or "").lower()))}
    parent = {i: i for i, _ in alike}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if near.similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, _ in alike}
    assert near.classes_of(docs(spark, [])).count() == 0
    kept = near.one_of_each(docs(spark, alike + alike[:5]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i, _ in alike}) and kept.columns == docs(spark, []).columns


@pytest.mark.parametrize("chars", [near.CHUNK, 5000])
def test_every_shingle_has_its_own_document_frequency(spark, alike, tmp_path, monkeypatch, chars):
    monkeypatch.setattr(near, "CHUNK", chars)
    rng = random.Random(5)
    groups = []                                        # a group shares what few of all documents hold, and its members differ in what no other one holds
    for g in range(3):
        same = " ".join(f"s{g}w{i}" for i in range(60))
        groups += [same + " " + " ".join(f"o{g}c{c}w{i}" for i in range(rng.choice([1, 6, 9]))) for c in range(9)]
    texts = alike + [(1000 + i, t) for i, t in enumerate(groups)] + [(3, alike[3][1]), (None, groups[0])]
    sets = [(i, *np.unique(near.shingles(w, 5, {}), return_counts=True)) for i, t in texts if (w := near.WORD.findall((t or "").lower()))]
    df = defaultdict(int)
    for _, h, _ in sets:
        for x in h.tolist():
            df[x] += 1
    weighted = [(i, (h, n * np.array([np.log1p(len(texts) / df[x]) for x in h.tolist()]))) for i, h, n in sets]
    part = list(range(len(weighted)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(range(len(weighted)), 2):
        if near.similarity(weighted[a][1], weighted[b][1]) >= 0.8:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for k, (i, _) in enumerate(weighted):
        members[find(k)].append(i)
    want = sorted((i if i is not None else -1, min(x for x in ids if x is not None), len(ids)) for ids in members.values() for i in ids)
    worded = {i for i, _ in weighted}
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_near_duplicates(spark, str(tmp_path)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got if r[0] in worded) == want
    assert len(got) == len(texts)
    flat = {(r[0], r[1]) for r in near.classes_of(docs(spark, texts)).select("doc_id", "class_id").collect()}
    assert flat != {(r[0], r[1]) for r in got}
    kept = corpus_pipeline.keep_one_of_each(spark, docs(spark, texts).withColumns({c: F.lit("") for c in corpus_pipeline.COLUMNS[2:]}), "")
    assert {r["doc_id"] for r in kept.collect()} == {r[1] for r in got}
    assert near.classes_of(docs(spark, []), rare=None).count() == 0


@pytest.mark.parametrize("copies", [45, 20, 90])
def test_large_groups_of_copies_hang_together_by_equal_weights(spark, tmp_path, copies):
    """What 45 of 1,100 documents share weighs as much as what one has of its own; what 20 or 90 share keeps its frequency (too few, and one in twelve of all)."""
    rng = random.Random(31)
    texts = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(104)]
        for c in range(copies):
            own = list(base)
            for i in rng.sample(range(4, 100), 1 + c % 3):
                own[i] = f"g{g}c{c}e{i}"
            texts.append(" ".join(own))
    held = [np.unique(near.shingles(t.split(), 5, {}), return_counts=True) for t in texts]
    df = defaultdict(int)
    for h, _ in held:
        for x in h.tolist():
            df[x] += 1
    texts += [f"f{i}a f{i}b f{i}c" for i in range(1100 - len(texts))]

    def classes(*weighings):
        part = list(range(len(texts)))

        def find(x):
            while part[x] != x:
                x = part[x]
            return x

        for a, b in itertools.combinations(range(len(held)), 2):
            weighted = lambda i, w: (held[i][0], held[i][1] * np.array([w(df[x]) for x in held[i][0].tolist()]))
            if any(near.similarity(weighted(a, w), weighted(b, w)) >= 0.8 for w in weighings):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(texts))]

    idf = lambda n: np.log1p(1100 / n)
    even = lambda n: idf(1 if 25 <= n < 55 else n)
    want, first = classes(idf, even), classes(idf)
    assert (want == first) == (copies != 45)
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in queries.op8_near_duplicates(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))


def test_either_weighing_links_texts_of_a_block():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 2 ** 63, 120).astype(np.uint64))
    weights, even = near.Weights({int(h): 30 for h in keys[:60]}, 1000, 5, 0.001), near.Even.of(1000)
    sets = []
    for _ in range(40):
        h = np.sort(np.concatenate([keys[:60][rng.permutation(60)[:57]], rng.choice(keys[60:], rng.integers(1, 8), replace=False)]))
        sets.append((h, np.where(h % np.uint64(7) == 0, 2, 1).astype(np.uint32)))
    ids = [b"%02d" % i for i in range(40)]
    by = lambda i, w: (sets[i][0], w(weights.weighted(sets[i][0], np.ones(len(sets[i][0])))[1]) * sets[i][1])
    like = lambda i, j, *ws: any(near.similarity(by(i, w), by(j, w)) >= 0.7 for w in ws)
    pairs = lambda *ws: [(ids[i], ids[j]) for i, j in itertools.combinations(range(40), 2) if like(i, j, *ws)]
    want = pairs(lambda w: w, even)
    got = near.spanning(ids, ids, sets, weights, 0.7, columns=16, even=even)
    classes = lambda links: {frozenset(c) for c in _components(ids, links)}
    assert set(got) <= set(want) and classes(got) == classes(want) and set(want) != set(pairs(lambda w: w))


def test_weights_met_often_are_sampled_as_others():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2 ** 63, 50).astype(np.uint64))
    w = rng.choice([1.5, 2.5, 7.0], 50)
    draw = near.Sampler(8)
    first = draw(h, w)
    for _ in range(2 * near.MET):
        assert (draw(h, w) == first).all()
    assert draw.plain
    assert (near.unpacked(near.packed(h)) == h).all() and len(near.unpacked(near.packed(h[:0]))) == 0


@pytest.mark.parametrize("block_texts", [400, 50])
def test_large_group_keeps_links_through_one_member(spark, block_texts):
    """Copies are like their original but not like one another, so a group hangs on one text, wherever that stands under a key."""
    rng = random.Random(21)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(204)]
        texts.append(" ".join(base))
        for c in range(150):
            own = list(base)
            for i in rng.sample(range(4, 200), 3):
                own[i] = f"g{g}c{c}e{i}"
            texts.append(" ".join(own))
    got = {r["doc_id"]: r["class_id"] for r in near.classes_of(docs(spark, list(enumerate(texts))), rare=0.9, block_texts=block_texts).collect()}
    whole = sum(got[i] == i // 151 * 151 for i in range(len(texts)))
    assert whole >= 0.995 * len(texts)


def test_similar_texts_that_agree_in_few_samples_are_linked(spark):
    rng = random.Random(1464)                          # of 0.818 alike, and sharing a key, these agree in 16 of the first 30 samples
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(104)]
    own = list(base)
    for i in (30, 70):
        own[i] = f"x{rng.randint(0, 10 ** 6)}"
    others = [" ".join(f"o{k}w{i}" for i in range(50)) for k in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in near.classes_of(docs(spark, list(enumerate([" ".join(base), " ".join(own), *others]))), rare=0.9).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 12)}


def test_all_pairs_of_a_block_are_compared():
    rng = np.random.default_rng(9)
    weights = near.Weights({int(h): 40 for h in rng.integers(0, 2 ** 63, 5)}, 100, 5, 0.1)
    pool = np.concatenate([weights.keys, rng.integers(0, 2 ** 63, 60).astype(np.uint64)])
    sets = []
    for _ in range(60):
        h = np.sort(pool[rng.permutation(65)[:rng.integers(45, 62)]])
        sets.append((h, rng.integers(1, 4, len(h)).astype(np.uint32) if rng.random() < 0.3 else np.ones(len(h), np.uint32)))
    ids = [b"%02d" % i for i in range(60)]
    like = lambda i, j: near.similarity(weights.weighted(*sets[i]), weights.weighted(*sets[j])) >= 0.8
    classes = lambda links: {frozenset(c) for c in _components(ids, links)}
    want = [(ids[i], ids[j]) for i, j in itertools.combinations(range(60), 2) if like(i, j)]
    got = near.spanning(ids, ids, sets, weights, 0.8, columns=16)
    assert set(got) <= set(want) and classes(got) == classes(want) and len(got) < 60 < len(want)


def _components(nodes, links):
    of = {x: {x} for x in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[a]:
                of[x] = of[a]
    return list(of.values())


def test_words_are_hashed_when_first_asked_for():
    words, seen = ["a", "bé", "a", "\ud800", "c"], Hashes(c=7)
    got = hash_words(words, seen)
    assert got[:4].tolist() == hash_words(words, {})[:4].tolist() and got[4] == 7 and seen.keys() == {"a", "bé", "\ud800", "c"}


def test_frequent_shingles_are_exact(spark, alike):
    rows = near.documents(docs(spark, alike)).repartition(5)
    counts, total = near.frequent_shingles(rows, 5, 0.1)
    want = defaultdict(int)
    for _, t in alike:
        for h in set(near.shingles(w, 5, {}).tolist() if (w := near.WORD.findall((t or "").lower())) else []):
            want[h] += 1
    assert total == len(alike) and counts == {h: n for h, n in want.items() if n >= 0.1 * total} and counts


def test_sampling_agrees_as_often_as_sets_are_similar():
    rng, draw, close = np.random.default_rng(3), near.Sampler(400), []
    for _ in range(12):
        h = np.sort(rng.integers(0, 2 ** 63, 300).astype(np.uint64))
        w = rng.choice([1.0, 2.0, 2.4, 7.0], 300)
        a, b = np.sort(rng.permutation(300)[:240]), np.sort(rng.permutation(300)[:240])
        s = near.similarity((h[a], w[a]), (h[b], w[b]))
        close.append(abs((draw(h[a], w[a]) == draw(h[b], w[b])).mean() - s))
    assert np.mean(close) < 0.03 and max(close) < 0.08


def test_components_over_chains(spark):
    n = 40
    links = spark.createDataFrame([(b"%03d" % i, b"%03d" % (i + 1)) for i in range(n)] + [(b"900", b"901"), (b"901", b"900")], "a binary, b binary")
    got = {bytes(r["t"]): bytes(r["c"]) for r in near.components(links).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(n + 1)} | {b"900": b"900", b"901": b"900"}


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(12)
    word = lambda: f"k{rng.randint(0, 900)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 55))).capitalize() + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(25)]
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [(i, filler(rng.randint(0, 300))) for i in range(120)]
    for i, t in items:
        changed = " ".join(w if rng.random() > 0.1 else word() for w in t.split())
        texts += [(1000 + i, filler(200) + " " + t + " " + filler(90)), (2000 + i, filler(3) + "\n" + changed.upper() + "\n" + filler(2000))]
    texts += [(3000, items[0][1]), (3000, items[0][1]), (3001, None), (3002, ""), (None, items[1][1]), (3003, filler(30000) + " " + items[2][1])]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (None, "some item")], "item_id bigint, text string")
    return items, texts, bench


def test_decontamination_finds_planted_items(spark, leaks):
    items, texts, bench = leaks
    d = docs(spark, texts).repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(d, bench).collect()}
    want = {(1000 + i, i) for i, _ in items} | {(2000 + i, i) for i, _ in items} | {(3000, 0), (None, 1), (3003, 2)}
    brute = set()
    for i, t in texts:
        words = decontaminate.WORD.findall((t or "").lower())
        for k, q in items:
            q = decontaminate.WORD.findall(q.lower())
            index = {w: n for n, w in enumerate(dict.fromkeys(q), 1)}
            item, text = np.array([index[w] for w in q]), np.array([index.get(w, 0) for w in words])
            for at in range(0, max(1, len(words) - 2 * len(q) + 1), 10):
                if decontaminate.common(item, text[at:at + 2 * len(q) + 20]) / len(q) >= 0.85:
                    brute.add((i, k))
                    break
    assert brute <= got and {g for g in got if g[0] is not None and g[0] < 1000} == set()
    assert len(want - got) <= 1 and got <= want
    left = decontaminate.clean(d, bench)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in texts} - {g[0] for g in got}
    assert decontaminate.hits(d.limit(0), bench).count() == 0 and decontaminate.hits(d, bench.limit(0)).count() == 0


def test_decontamination_equals_reading_every_passage(spark):
    """Short items and items that lose three words in ten, among the benchmark's own words."""
    rng = random.Random(31)
    word = lambda: f"k{min(int(rng.paretovariate(0.6)), 2000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 24))) + ". " + " ".join(word() for _ in range(rng.randint(2, 6))) + ".") for i in range(40)]
    texts = []
    for i, t in items:
        for c in range(6):
            words = t.split()
            for j in rng.sample(range(len(words)), int(len(words) * (0, 0.2, 0.25, 0.3, 0.3, 0.34)[c])):
                words[j] = word()
            texts.append((6 * i + c, " ".join([*(word() for _ in range(rng.randint(0, 120))), *words, *(word() for _ in range(rng.randint(0, 120)))])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["lcs_share"], 9), round(r["answer_share"], 9)) for r in decontaminate.hits(docs(spark, texts).repartition(3), bench).collect()}
    want, k = {}, decontaminate.CHUNK
    for i, t in items:
        q, last = decontaminate.WORD.findall(t), decontaminate.answer(t)
        index = {w: n for n, w in enumerate(dict.fromkeys(q), 1)}
        item, own = np.array([index[w] for w in q]), np.array([index[w] for w in last])
        for d, x in texts:
            text = np.array([index.get(w, 0) for w in decontaminate.WORD.findall(x)])
            for at in range(0, len(text), k):
                around = text[max(0, at - len(q)):at + 2 * k + len(q)]
                lcs = decontaminate.common(item, around) / len(q)
                if lcs >= 0.7 and (said := decontaminate.common(own, around) / len(own)) >= 0.5:
                    want[(d, i)] = max(want.get((d, i), (0, 0)), (round(lcs, 9), round(said, 9)))
    assert got == want and sum(d // 6 == i for d, i in want) > 180


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and x else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common(np.array(a), np.array(b)) == t[-1][-1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@has_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert run_queries.compare(df.collect(), df.columns, con, queries.ORACLE_SQL[name]) == "ok"


@has_data
def test_pipeline_stages(spark):
    """Each stage does to its input what its operator decides, and hands on the columns of documents."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    d, seen = start, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = written(stage(spark, d, SF))
        assert new.columns == start.columns and ids(new) <= ids(d), name
        seen.append((d, new))
        d = new
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(seen[0][1]) == ids(quality.score(seen[0][0], labels).where("keep"))
    texts = {r["doc_id"]: r["text"] for r in seen[1][0].collect()}
    assert len({" ".join(near.WORD.findall(texts[i].lower())) for i in ids(seen[1][1])}) == len(ids(seen[1][1])) and seen[1][1].count() == len(ids(seen[1][1]))
    assert ids(seen[2][0]) - ids(seen[2][1]) == {r["doc_id"] for r in decontaminate.hits(seen[2][0], bench).collect()}
    assert pii.report(seen[3][1]).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert seen[3][1].where("n_chars <> char_length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert ids(packed) == ids(d)


def test_an_item_across_the_border_of_two_slices_is_found(spark):
    rng = random.Random(12)
    item = " ".join(f"q{rng.randint(0, 400)}" for _ in range(190)) + ". " + " ".join(f"answer{i}" for i in range(10)) + "."
    rows = []
    for at in (0, 50_000, 99_790, 99_850, 99_900, 99_999, 100_000, 100_050, 119_800):
        words = [f"w{i % 977}" for i in range(120_000)]
        words[at:at + 200] = item.split()
        rows.append((at, " ".join(words)))
    table = spark.createDataFrame(rows + [(1, " ".join(f"w{i % 977}" for i in range(120_000)))], "doc_id bigint, text string").repartition(4)
    benchmark = spark.createDataFrame([(5, item), (6, "another short item of the list with words.")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in decontaminate.hits(table, benchmark).collect()}
    assert set(got) == {(at, 5) for at, _ in rows} and min(got.values()) == 1.0
