"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds are found by fixed patterns and checks, and always stay.  Further candidates (long keys, number runs that are
no card, identity numbers, local phone numbers) are voted on by labelers that may abstain: patterns of the value, gazetteers of
words before it, and the characters around it.  Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern means personal data; with these soft labels a naive Bayes classifier of
spans is trained on features of value and place, and a candidate is kept if the classifier and no base span speaks against it.

What is counted is one row per pattern of votes and features, of which there are a bounded number; the estimates are
aggregates over that table.  Texts are scanned once and only spans are kept.

Null texts count as empty.  A row is judged by itself, so repeated rows have equal results, and an empty table gives none.
Columns besides id and text are left out.  Offsets are code points, ends exclusive.  Spans of one kind never overlap; spans of
different base kinds may, and are ordered by start, then by kind.  Patterns take possessive quantifiers where that changes
nothing, so that a very long run of digits or name characters neither exhausts the stack nor is read over and over.
The time for one text grows about as its length and its number of matches do: no array or text is grown match by match, places
are running sums, and a match is met with the pieces around it instead of the whole text.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents, written

MARK, OTHER = "\u0001", "\u0002"
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = ("account", "identity", "local_phone", "secret")
CANDIDATE = (r"(?<![\p{L}\p{N}_])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9](?:[ -]?+[0-9]){7,18}|"
             r"(?:(?<![A-Za-z0-9_-])|(?<=[^\x00-\x7F]-)|(?<=\G-))(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}_])")
SENSITIVE = r"(?i)\b(?:token|key|secret|password|passwd|pwd|credential|auth|bearer|ssn|social|passport|identity|account|iban|phone|tel|mobile|call|fax|pin)\b"
HARMLESS = r"(?i)\b(?:page|isbn|issn|version|section|chapter|year|copyright|figure|table|volume|edition|checksum|commit|build|revision)\b"
LABELERS = ("shape", "checksum", "sensitive_word", "harmless_word", "assigned", "in_address", "among_numbers")
REACH = 32      # characters around a candidate that labelers look at
BLOCK = 1024    # characters


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """0, and what ``merge`` makes of 0 and all values up to each one.  An array grows by copying it, so values go in parts of about the
    cube root of their number: first what each part makes, then each part from there on.  That copies n^(4/3) numbers, not n^2."""
    def grow(start: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))

    def dealt(v: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))

    def joined(parts: Column) -> Column:
        made = grow(F.lit(0), F.transform(parts, lambda p: F.aggregate(p, F.lit(0), merge)))
        return let(made, lambda m: F.concat(F.array(F.lit(0)), F.flatten(F.transform(parts, lambda p, k: F.slice(grow(F.get(m, k), p), F.lit(2), F.size(p))))))

    width = lambda v: F.greatest(F.ceil(F.cbrt(2.0 * F.size(v))), F.lit(1)).cast("int")
    return let(values, lambda v: let(width(v), lambda w: let(dealt(v, w), joined)))


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after each leftmost non-overlapping match: every second piece is one."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _ends(pieces: Column) -> Column:
    return running(F.transform(pieces, F.char_length), lambda a, b: a + b)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value)."""
    def of(pieces: Column, ends: Column) -> Column:
        placed = F.transform(pieces, lambda p, k: F.struct(F.get(ends, k).alias("start"), F.get(ends, k + 1).alias("end"), p.alias("value")))
        return F.filter(placed, lambda _, k: k % 2 == 1)

    return let(_pieces(text, pattern), lambda p: let(_ends(p), lambda e: of(p, e)))


def matches_in_place(text: Column, pattern: str) -> Column:
    """``matches`` with up to REACH characters before and after each.  They are taken from the pieces around it; as each match of
    CANDIDATE has 8 characters or more, REACH / 8 matches and the pieces between them hold them."""
    near = REACH // 4

    def of(pieces: Column, ends: Column, heads: Column, tails: Column) -> Column:
        placed = F.transform(pieces, lambda p, k: F.struct(
            F.get(ends, k).alias("start"), F.get(ends, k + 1).alias("end"), p.alias("value"),
            F.right(F.array_join(F.slice(tails, F.greatest(k - near + 1, F.lit(1)), F.least(k, F.lit(near))), ""), F.lit(REACH)).alias("before"),
            F.left(F.array_join(F.slice(heads, k + 2, F.lit(near)), ""), F.lit(REACH)).alias("after")))
        return F.filter(placed, lambda _, k: k % 2 == 1)

    return let(_pieces(text, pattern), lambda p: let(_ends(p), lambda e: let(F.transform(p, lambda x: F.left(x, F.lit(REACH))), lambda h: let(
        F.transform(p, lambda x: F.right(x, F.lit(REACH))), lambda t: of(p, e, h, t)))))


def apart(found: Column, base: Column) -> Column:
    """Those of ``found`` that share no character with a base span.  In the order of all starts, a match is met by a span before it that
    ends behind its start, or by the next span, if that starts before its end."""
    far = 2 ** 31 - 1

    def free(all_: Column, before: Column, behind: Column) -> Column:
        kept = F.filter(all_, lambda u, k: (u["place"] >= 0) & (F.get(before, k) <= u["start"]) & (far - F.get(behind, F.size(all_) - 1 - k) >= u["end"]))
        return F.transform(kept, lambda u: F.get(found, u["place"]))

    own = F.transform(found, lambda m, k: F.struct(m["start"].alias("start"), m["end"].alias("end"), k.alias("place")))
    theirs = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("place")))
    larger = lambda a, b: F.greatest(a, b)
    met = let(F.sort_array(F.concat(own, theirs)), lambda u: let(
        running(F.transform(u, lambda x: F.when(x["place"] < 0, x["end"]).otherwise(0)), larger), lambda before: let(
            running(F.reverse(F.transform(u, lambda x: F.when(x["place"] < 0, far - x["start"]).otherwise(0))), larger), lambda behind: free(u, before, behind))))
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(met)


def _holds(kind: str, value: Column) -> Column:
    """The check that a match of a base kind must pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _none(schema: str) -> Column:
    return F.array().cast(f"array<struct<{schema}>>")


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, ordered: array of (start, rank, end, kind)."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -][0-9 -]"), "phone": text.contains("+")}

    def of(i: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(may[kind], spans).otherwise(_none("start:int,rank:int,end:int,kind:string"))

    return F.sort_array(F.concat(*[of(i, kind) for i, kind in enumerate(BASE)]))


def _sign(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0).cast("tinyint")


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates beside the base spans with their votes and features."""
    def judged(m: Column) -> Column:
        value = m["value"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        before, after = m["before"], m["after"]
        kind = (F.when(value.rlike("[A-Za-z_]"), "secret").when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity")
                .when(value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "local_phone").otherwise("account"))
        votes = F.array(
            _sign(((kind == "secret") & value.rlike("^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9][^A-Za-z]*+[A-Za-z]")) | kind.isin("identity", "local_phone"),
                  value.rlike("^(.)\\1+$") | ((kind == "account") & (F.length(digits) < 10))),
            _sign((kind == "account") & F.call_function("luhn_check", digits), (kind == "account") & ~F.call_function("luhn_check", digits)),
            _sign(before.rlike(SENSITIVE), F.lit(False)),
            _sign(F.lit(False), before.rlike(HARMLESS)),
            _sign(before.rlike("[=:]\\s*[\"']?$"), F.lit(False)),
            _sign(F.lit(False), before.rlike(r"[/?&\\#]$") | after.rlike(r"^[/\\]")),
            _sign(F.lit(False), before.rlike("[0-9][,;| ]+$") & after.rlike("^[,;| ]+[0-9]")))
        place = lambda c, edge: F.when(c.rlike(edge.format("[\"']")), "q").when(c.rlike(edge.format(r"\s")), "s").when(c == "", "e").otherwise("o")
        features = F.array(F.concat(F.lit("kind:"), kind), F.concat(F.lit("length:"), F.least(F.floor(F.char_length(value) / 8), F.lit(6)).cast("string")),
                           F.concat(F.lit("left:"), place(before, "{}$")), F.concat(F.lit("right:"), place(after, "^{}")),
                           F.concat(F.lit("case:"), F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "m").when(value.rlike("[a-z]"), "l").when(value.rlike("[A-Z]"), "u").otherwise("n")),
                           F.concat(F.lit("sign:"), F.when(before.rlike("[=:]\\s*[\"']?$"), "y").otherwise("n")))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), kind.alias("kind"), votes.alias("votes"), features.alias("features"))

    free = let(matches_in_place(text, CANDIDATE), lambda found: apart(found, base))
    return F.when(text.rlike("[0-9]"), F.transform(free, judged)).otherwise(_none("start:int,end:int,kind:string,votes:array<tinyint>,features:array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """doc_id, base, candidates; ``carried`` columns stay beside them, and ``text`` if it is among them."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.translate(F.col(text_col).cast("string"), MARK, OTHER), F.lit("")).alias("_t"), *carried)
    rows = rows.withColumn("base", base_spans(F.col("_t")))
    return rows.withColumn("candidates", candidate_spans(F.col("_t"), F.col("base"))).drop("_t")


@dataclass(frozen=True)
class Judge:
    """Reliability of each labeler, the share of personal data, and the log-odds of each feature."""
    reliability: dict[str, float]
    share: float
    log_odds: dict[str, float]

    def keeps(self, features: Column) -> Column:
        if not self.log_odds:
            return F.lit(False)
        weights = F.create_map(*[F.lit(x) for kv in sorted(self.log_odds.items()) for x in kv])
        prior = math.log(self.share / (1 - self.share))
        return F.aggregate(features, F.lit(prior), lambda acc, f: acc + F.coalesce(F.try_element_at(weights, f), F.lit(0.0))) > 0


def learn(scanned: DataFrame, rounds: int = 15) -> Judge:
    """Expectation-maximisation over vote patterns, then the classifier.  A labeler's reliability is the share of its votes that
    agree with the truth; it starts at, and leans to, 0.8 and is held between 0.6 and 0.99, so a labeler cannot turn its meaning
    around.  The share of personal data stays at a half or less: where no labeler speaks for a candidate, it is none."""
    patterns = written(scanned.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").alias("n")))
    trust, share = {x: 0.8 for x in LABELERS}, 0.5
    total = patterns.agg(F.sum("n")).first()[0]
    if not total:
        return Judge(trust, share, {})

    def belief() -> Column:
        odds = F.lit(math.log(share / (1 - share)))
        for i, x in enumerate(LABELERS):
            odds = odds + F.col("votes")[i] * F.lit(math.log(trust[x] / (1 - trust[x])))
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds):
        p, n = belief(), F.col("n")
        sums = patterns.agg(F.sum(n * p).alias("share"), *[
            F.sum(F.when(F.col("votes")[i] == 1, n * p).when(F.col("votes")[i] == -1, n * (1 - p)).otherwise(0.0)).alias(f"right_{x}") for i, x in enumerate(LABELERS)], *[
            F.sum(F.when(F.col("votes")[i] != 0, n).otherwise(0)).alias(f"cast_{x}") for i, x in enumerate(LABELERS)]).first()
        share = min(max(sums["share"] / total, 0.02), 0.5)
        trust = {x: min(max((sums[f"right_{x}"] + 8.0) / (sums[f"cast_{x}"] + 10.0), 0.6), 0.99) for x in LABELERS}
    p = belief()
    told = (patterns.select(F.explode("features").alias("f"), (F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"))
            .groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect())      # one row per value of a feature
    yes, no = share * total, (1 - share) * total
    return Judge(trust, share, {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in told})


def spans(scanned: DataFrame, judge: Judge) -> DataFrame:
    """Adds ``spans``: base spans and kept candidates, array of (start, rank, end, kind), ordered."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(EXTRA) for x in (k, len(BASE) + i)])
    kept = F.transform(F.filter("candidates", lambda c: judge.keeps(c["features"])),
                       lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", kept)))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    scanned = written(scan(docs, id_col, text_col))
    found = spans(scanned, learn(scanned))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _replaced(text: Column, found: Column) -> Column:
    """The text with its ordered spans replaced.  It is cut into blocks once, so that a stretch is taken from the blocks it lies in."""
    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first, last = (F.floor(x / BLOCK).cast("int") for x in (start, end))
        of = lambda i, at, n: F.substring(F.coalesce(F.get(blocks, i), F.lit("")), at + 1, n)
        over = F.concat(of(first, start % BLOCK, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), of(last, F.lit(0), end % BLOCK))
        return F.when(first == last, of(first, start % BLOCK, end - start)).otherwise(over)

    def joined(blocks: Column, reached: Column) -> Column:
        parts = F.transform(found, lambda s, k: F.when(s["start"] >= F.get(reached, k), F.concat(cut(blocks, F.get(reached, k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
                            .otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(reached, -1), F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda b: let(running(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), lambda r: joined(b, r)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each stretch of personal data replaced by its kind in brackets; overlapping spans become one
    stretch, named after the first.  All columns stay as they are but the text; a null text stays null."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col), F.col(text_col))
    scanned = written(scan(packed, id_col, text_col, "row"))
    found = spans(scanned, learn(scanned))
    text = F.col("row")[text_col]
    return found.select(*[F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(_replaced(text, F.col("spans"))).alias(c)
                          if c == text_col else F.col("row")[c].alias(c) for c in names])
