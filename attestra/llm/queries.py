"""Queries over the driver's tables, one for each operator, with production parameters."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, language, maxscore, near_duplicates, packing, pii, quality, spelling, token_rows, toxicity, url_filter, warc, whitening
from attestra.llm.common import documents, fold, table, written

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every whole text, learned from the folds 1 to 4 of 5."""
    docs = table(spark, d, "documents")
    net = language.fit(docs.where(fold("doc_id", 5) != 0), F.col("lang"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return language.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document by co-trained views of text and metadata."""
    return quality.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as segmented WARC records and read back."""
    return warc.round_trip(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every whole text; of the folds of 4, fold 2 is held out, and a fifth of the others serves the calibration."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    learn, spare = crc % 4 != 2, F.floor(crc / 4) % 5 == 0
    got = toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"), learn & ~spare, learn & spare)
    return got.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.hits(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.report(table(spark, d, "documents"))


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces in as few sequences of 2048 tokens as best fit finds."""
    return packing.pack(table(spark, d, "documents"), tokenizer())


def op8_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The near-duplicate class of every document, named by its smallest doc_id, and its size."""
    return near_duplicates.classes_of(table(spark, d, "documents"), rare=None).select("doc_id", "class_id", "n_docs")


def op9_token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Matrices written and read back: where each segment lies, and the checksum of its ids."""
    return token_rows.segments(written(token_rows.matrices(table(spark, d, "documents"), tokenizer())))


def op10_maxscore(spark: SparkSession, d: str) -> DataFrame:
    """The five best of all other rows for every vector whose id is divisible by 50."""
    return maxscore.search(table(spark, d, "embeddings"))


#: rules of the query op11, (host, path, verdict); fixed values
URL_RULES = (url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"),
             url_filter.Rule("net", "/es/", "block"), url_filter.Rule("net", "/fr/", "block"))
#: words in the names of hosts whose pages make up the list of the query op11; fixed values
LISTED_HOSTS = "pills|adult|bets|spam|casino|loan"


def op11_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every page's URL under the rules, else under the list: the canonical URLs of pages on hosts with a suspicious name."""
    pages = table(spark, d, "pages")
    return url_filter.judge(pages, pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)), URL_RULES)


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents with their near words, the form each is a variant of, and the root of its forms."""
    return spelling.variants(table(spark, d, "documents"))


def op13_whitening(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings whitened along their 32 leading principal directions."""
    return whitening.whiten(table(spark, d, "embeddings"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_language, op2_quality, op3_warc, op4_toxicity, op5_decontaminate, op6_pii, op7_packing, op8_near_duplicates, op9_token_rows, op10_maxscore,
    op11_url_filter, op12_spelling, op13_whitening)}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             k AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN NULL ELSE TRUE END AS verified
        FROM f""",
    "op10_maxscore": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS row_, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS (SELECT q.row_ AS row_, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.row_ <> c.row_ WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_ ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_url_filter": """
        WITH p AS (SELECT page_id, url, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\??[^#]*)', ['h', 'p', 'q']) AS u FROM pages),
             s AS (SELECT page_id, coalesce(translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(u.p, '') AS path, coalesce(u.q, '') AS query FROM p),
             k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_replace(query, '^\\?', ''), '&'),
                                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS kept,
                          regexp_replace(host, '^www\\.|:(80|443)$', '', 'g') AS bare FROM s),
             c AS (SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS key FROM k),
             l AS (SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND regexp_matches(host, 'pills|adult|bets|spam|casino|loan')),
             r(rule, rule_host, rule_path, says) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                                                            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
             m AS (SELECT c.*, (SELECT max_by({'rule': r.rule, 'says': r.says}, length(r.rule)) FROM r
                                WHERE (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)) AS best,
                          c.key IS NOT NULL AND c.key IN (SELECT key FROM l) AS listed FROM c)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m""",
    "op12_spelling": """
        WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
                                     FROM range(256) AS b(i)),
             runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
             counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
             bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                                   lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM counted),
             hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h FROM bytes, crc_table),
             slipped AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
             words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
             cuts AS (SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
             pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                       UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
                       UNION SELECT b.word, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
             best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
             forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
                       FROM words w LEFT JOIN best b ON w.word = b.word),
             chain(word, tail) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.tail = f.word WHERE f.form IS NOT NULL),
             ends AS (SELECT c.word, c.tail AS root FROM chain c JOIN forms f ON c.tail = f.word WHERE f.form IS NULL)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word""",
}
