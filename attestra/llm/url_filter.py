"""Filtering of URLs: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules come first and the longest that fits decides.  URLs without a rule are blocked if their canonical form is listed.  The list
may be far larger than memory: its entries are hashed into a blocked Bloom filter (blocks of 256 bits, eight of them set by an entry, all in
one block, so that a test reads one row), which is small and goes to every task.  Only URLs that the filter lets through are
moved, by the hash of their canonical form, to meet the list exactly, which removes the false positives.

Everything is DataFrame functions.  The filter has at most ``most_blocks`` rows of 40 bytes, whatever the size of the list: a longer list makes
it fuller, so that more URLs reach the exact join, and loses none.  A canonical URL that very many pages share meets the list once, and
its pages, dealt over ``salts`` keys, meet only what was confirmed.

A null URL, or one without ``://``, has an empty host and path, no canonical form, no rule and is allowed.  Repeated rows and null
ids are judged row by row; null and repeated list entries count once or not at all; an empty list blocks nothing, empty pages give no rows.  Columns besides
id and URL are left out.
"""
from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: parameters that name a visit and not a page
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: how many pairs of bits an entry sets; two words of 32 bits share a long
LONGS = 4


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question mark or hash; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for all URLs of a page: no scheme, ``www.``, default port, closing slash, fragment or tracking parameters, and
    the other parameters in order.  Null without a host."""
    h = F.regexp_replace(host(url), r"^www\.|:(80|443)$", "")
    query = F.regexp_replace(F.regexp_extract(url, PARTS, 3), r"^\?", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(name, verdict) of the longest rule whose host is this one or a parent of it and whose path begins this one; of rules
    of one length the longer host goes first, then blocking."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of an entry: one in each half of each long, by five bits of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    bit = lambda i: F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    return [one(bit(2 * j)).bitwiseOR(one(bit(2 * j + 1) + 32)) for j in range(LONGS)]


def bloom(keys: DataFrame, key: str, entries: int, bits: int = 12, most_blocks: int = 2 ** 20) -> tuple[DataFrame, int]:
    """The blocked filter of a column, as rows (block, w0 to w3), and its number of blocks: ``bits`` for each of ``entries``."""
    blocks = min(max(1, -(-entries * bits // 256)), most_blocks)
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *(m.alias(f"w{j}") for j, m in enumerate(_masks(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(LONGS))), blocks


def let_through(rows: DataFrame, key: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with a further column ``possible``: true for every key that was entered, and for few others."""
    masks = _masks(F.col(key))
    hit = F.lit(True)
    for j, m in enumerate(masks):
        hit = hit & (m.bitwiseAND(F.col(f"w{j}")) == m)
    # at most ``most_blocks`` rows of five longs
    met = rows.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(filter_rows), "block", "left")
    return met.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *(f"w{j}" for j in range(LONGS)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), listed_col: str = "url", id_col: str = "page_id", url_col: str = "url",
          bits: int = 12, most_blocks: int = 2 ** 20, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, and whether the canonical URL is on the list, for every page."""
    entries = written(listed.select(canonical(F.col(listed_col)).alias("key")).where("key IS NOT NULL").distinct())
    filter_rows, blocks = bloom(entries, "key", entries.count(), bits, most_blocks)
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    r = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("r", r).select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("by_rule"), "key")
    # the salt is written with the rows, so that it is the same whenever they are read
    base = written(let_through(base, "key", filter_rows, blocks).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
    hits = base.where("possible")
    # each key that passes the filter meets the list once; the rows then meet what is left of it
    confirmed = hits.select("key").distinct().join(entries, "key", "left_semi")
    copies = confirmed.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("listed"))
    columns = ["page_id", "host", "path", "rule", "by_rule", "listed"]
    judged = (hits.join(copies, ["key", "salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False))).select(*columns)
              .unionByName(base.where("NOT possible").withColumn("listed", F.lit(False)).select(*columns)))
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
