"""The same results in SQL, written against the definitions rather than against the library:
category sets and roots are counted with COUNT(DISTINCT), ties broken by window functions."""
from __future__ import annotations

from attestra import Registry
from workbench import workload as W

_GEN = "('illicit_unspec', 'licit_unspec')"
_DAY = f"DATE '{W.AS_OF}'"

# ------------------------------------------------------------------ shared statements
CLAIMS = """
obs AS (%(obs)s),
tailed AS (
  SELECT *, CASE WHEN instr(prov_family, ':') > 0 THEN substr(prov_family, instr(prov_family, ':') + 1) END AS tail,
         CASE WHEN source = 'watchyourback' AND address LIKE '#%%' THEN substr(address, 2) ELSE address END AS subject
  FROM obs),
rooted AS (
  SELECT *,
    CASE source
      WHEN 'ellipticpp' THEN 'elliptic_undisclosed'
      WHEN 'ransomwhere' THEN 'ransomwhere_crowd'
      WHEN 'rodwald_mixers' THEN CASE WHEN coalesce(tail, '') LIKE '%%W%%' THEN 'walletexplorer' ELSE 'rodwald_mixers_own' END
      WHEN 'rodwald_ransom' THEN CASE WHEN coalesce(tail, '') LIKE '%%R%%' THEN 'ransomwhere_crowd'
            WHEN lower(subcat) LIKE 'princeton%%' THEN 'princeton_huang_2018' WHEN lower(subcat) LIKE 'padua%%' THEN 'padua_conti_2018'
            WHEN lower(subcat) LIKE 'montreal%%' THEN 'montreal_paquet_clouston_2019'
            ELSE 'rodwald_own_' || CASE WHEN coalesce(tail, '') = '' THEN 'unknown' ELSE tail END END
      WHEN 'schnoering' THEN CASE subcat WHEN 'Montréal' THEN 'montreal_paquet_clouston_2019' WHEN 'Padua' THEN 'padua_conti_2018'
            WHEN 'PaduaSextorsion' THEN 'padua_sextortion_2020' WHEN 'BitcoinTalk' THEN 'bitcointalk_forum' WHEN 'SDN' THEN 'ofac_sdn'
            WHEN 'CoinbaseMessages' THEN 'coinbase_messages' WHEN 'WBTC' THEN 'wbtc_disclosure' WHEN 'Exchange' THEN 'exchange_self_disclosure'
            ELSE 'schnoering_other' END
      WHEN 'tagpack' THEN CASE WHEN lower(coalesce(tail, 'unknown')) LIKE '%%paquet-clouston%%' THEN 'montreal_paquet_clouston_2019'
            ELSE 'tagpack_' || coalesce(tail, 'unknown') END
      WHEN 'watchyourback' THEN CASE WHEN subcat = 'hydra-market' THEN 'ofac_sdn' ELSE 'watchyourback_manual' END
      ELSE source || ':unresolved' END AS root
  FROM tailed),
claims AS (
  SELECT *, NOT (root IN ('elliptic_undisclosed', 'schnoering_other') OR root LIKE 'rodwald_own_%%' OR root LIKE '%%:unresolved') AS resolved,
    CASE source WHEN 'ellipticpp' THEN true WHEN 'ransomwhere' THEN true WHEN 'rodwald_mixers' THEN root = 'rodwald_mixers_own'
         WHEN 'rodwald_ransom' THEN root LIKE 'rodwald_own_%%' WHEN 'tagpack' THEN root LIKE 'tagpack_%%'
         WHEN 'watchyourback' THEN root = 'watchyourback_manual' ELSE false END AS native,
    source IN ('schnoering', 'watchyourback') AND root IN ('ofac_sdn', 'exchange_self_disclosure') AS verified,
    CASE WHEN source IN ('ellipticpp', 'ransomwhere', 'watchyourback') THEN 'DECLARED'
         WHEN source = 'schnoering' THEN CASE WHEN root = 'schnoering_other' THEN 'INFERRED' ELSE 'DECLARED' END
         WHEN root LIKE '%%:unresolved' THEN 'UNKNOWN' ELSE 'INFERRED' END AS kind,
    CASE WHEN root IN ('ofac_sdn', 'exchange_self_disclosure') THEN 'verified'
         WHEN heuristic IN ('manual_verified', 'curated', 'multi_input', 'inherited', 'undisclosed') THEN 'derived'
         WHEN heuristic = 'unknown' THEN 'unknown' ELSE 'unverified-report' END AS tier,
    CASE WHEN TRY_CAST(substr(lastmod, 1, 10) AS DATE) IS NULL THEN 'currency-unknown'
         WHEN date_diff('day', TRY_CAST(substr(lastmod, 1, 10) AS DATE), %(day)s) / 365.25 > 3.0 THEN 'stale' ELSE 'current' END AS currency
  FROM rooted)"""

SUBJECTS = f"""
counted AS (
  SELECT subject, count(*) AS n_claims, count(DISTINCT source) AS n_sources,
         count(DISTINCT CASE WHEN canon <> 'unknown' THEN source END) AS known_sources,
         count(DISTINCT CASE WHEN NOT resolved THEN source END) AS unresolved_sources, count(DISTINCT root) AS n_roots,
         count(DISTINCT CASE WHEN resolved THEN root END) AS confirmed_roots,
         count(DISTINCT CASE WHEN resolved THEN source || '|' || root END) AS pairs,
         count(DISTINCT CASE WHEN canon <> 'unknown' THEN canon END) AS n_categories,
         count(DISTINCT CASE WHEN canon <> 'unknown' AND canon NOT IN {_GEN} THEN canon END) AS n_specific,
         count(DISTINCT CASE WHEN canon <> 'unknown' THEN polarity END) AS n_poles, min(claim_seq) AS first_seq
  FROM claims GROUP BY subject),
subjects AS (
  SELECT *, pairs - confirmed_roots AS shared_roots, pairs > confirmed_roots AS circular, greatest(confirmed_roots, 1) AS independence_min,
         confirmed_roots + unresolved_sources AS independence_max,
         CASE WHEN pairs > confirmed_roots THEN 'shared_root' WHEN unresolved_sources > 0 THEN 'unresolved' ELSE 'distinct_roots' END AS relationship,
         CASE WHEN known_sources < 2 THEN 'incomparable' WHEN n_categories = 1 THEN 'exact' WHEN n_poles > 1 THEN 'licit/illicit conflict'
              WHEN n_specific <= 1 THEN 'hierarchical refinement' ELSE 'entity-type conflict' END AS outcome
  FROM counted)"""

_OUT5 = "(VALUES ('exact'), ('hierarchical refinement'), ('entity-type conflict'), ('licit/illicit conflict'), ('incomparable'))"
_KIND = "CASE outcome WHEN 'licit/illicit conflict' THEN 'polarity' WHEN 'entity-type conflict' THEN 'entity' WHEN 'hierarchical refinement' THEN 'hierarchical' ELSE outcome END"


def _claims(body: str, *more: str, source: str = W.OBSERVATIONS) -> str:
    pre = CLAIMS % {"obs": W.for_duckdb(source), "day": _DAY}
    return "WITH RECURSIVE " + ",\n".join([pre, *more]) + "\n" + body


def _subjects(body: str, *more: str, source: str = W.OBSERVATIONS) -> str:
    return _claims(body, SUBJECTS, *more, source=source)


NAMED = "named AS (SELECT DISTINCT source, subject FROM claims), sizes AS (SELECT source, count(*) AS size FROM named GROUP BY source)"
PAIRS = """inter AS (SELECT a.source AS s, b.source AS o, count(*) AS n FROM named a JOIN named b ON a.subject = b.subject AND a.source <> b.source GROUP BY ALL),
matrix AS (SELECT x.source AS source, y.source AS other, CAST(coalesce(n, 0) AS BIGINT) AS intersection, coalesce(n, 0) / x.size AS share_of_source,
                  coalesce(n, 0) / y.size AS share_of_other, coalesce(n, 0) / (x.size + y.size - coalesce(n, 0)) AS jaccard
           FROM sizes x JOIN sizes y ON x.source <> y.source LEFT JOIN inter ON s = x.source AND o = y.source)"""
MODAL = """per_label AS (SELECT subject, source, canon, count(*) AS n, min(claim_seq) AS fs FROM claims GROUP BY ALL),
modal AS (SELECT subject, source, canon FROM (SELECT *, row_number() OVER (PARTITION BY subject, source ORDER BY n DESC, fs, canon) AS rn FROM per_label) WHERE rn = 1)"""
KAPPA = MODAL + """,
lp AS (SELECT a.source AS source_a, b.source AS source_b, a.canon AS x, b.canon AS y, count(*) AS n
       FROM modal a JOIN modal b ON a.subject = b.subject AND a.source < b.source GROUP BY ALL),
both_sets AS (SELECT 'all' AS w, * FROM lp UNION ALL SELECT 'known', * FROM lp WHERE x <> 'unknown' AND y <> 'unknown'),
tot AS (SELECT w, source_a, source_b, sum(n) AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) AS same,
               sum(CASE WHEN x = 'unknown' AND y = 'unknown' THEN n ELSE 0 END) AS blank FROM both_sets GROUP BY ALL),
m1 AS (SELECT w, source_a, source_b, x AS k, sum(n) AS n FROM both_sets GROUP BY ALL),
m2 AS (SELECT w, source_a, source_b, y AS k, sum(n) AS n FROM both_sets GROUP BY ALL),
pe AS (SELECT m1.w, m1.source_a, m1.source_b, sum(m1.n * m2.n) AS e FROM m1 JOIN m2 USING (w, source_a, source_b, k) GROUP BY ALL),
k AS (SELECT w, source_a, source_b, CAST(n AS BIGINT) AS n, CAST(blank AS BIGINT) AS blank, same / n AS po, coalesce(e, 0) / (CAST(n AS DOUBLE) * n) AS pc
      FROM tot LEFT JOIN pe USING (w, source_a, source_b)),
kk AS (SELECT *, CASE WHEN abs(1 - pc) >= 1e-12 THEN (po - pc) / (1 - pc) END AS kappa FROM k),
kappa AS (SELECT a.source_a, a.source_b, a.n, a.po AS percent_agreement, round(a.kappa, 9) AS cohen_kappa, a.blank AS n_both_unknown,
                 coalesce(b.n, 0) AS n_interpretable, b.po AS percent_agreement_interpretable, round(b.kappa, 9) AS cohen_kappa_interpretable,
                 coalesce(a.kappa > 0.4, false) AS substantial
          FROM (SELECT * FROM kk WHERE w = 'all') a LEFT JOIN (SELECT * FROM kk WHERE w = 'known') b USING (source_a, source_b))"""
DOMINANT = """per_root AS (SELECT subject, root, resolved, count(*) AS n, min(claim_seq) AS fs FROM claims GROUP BY ALL),
dominant AS (SELECT subject, root, resolved FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, fs, root) AS rn FROM per_root) WHERE rn = 1)"""
DECODE = """coded AS (SELECT DISTINCT CASE WHEN instr(prov_family, ':') > 0 THEN substr(prov_family, instr(prov_family, ':') + 1) ELSE prov_family END AS code, subject
  FROM claims WHERE source = 'rodwald_ransom'),
placed AS (SELECT code, subject, subject IN (SELECT subject FROM claims WHERE source = 'ransomwhere') AS inside FROM coded),
raw_groups AS (SELECT code, count(*) AS n, count(*) FILTER (WHERE inside) AS overlap FROM placed GROUP BY code),
groups AS (SELECT *, overlap / n AS share_in_candidate,
    CASE WHEN NOT regexp_full_match(code, '[A-Za-z]+') THEN 'malformed' WHEN n < 5 THEN 'insufficient' WHEN overlap / n > 0.999 THEN 'inherited'
         WHEN overlap / n < 0.001 THEN 'independent' ELSE 'mixed' END AS verdict FROM raw_groups)"""
RESIDUE = """residue AS (SELECT 'rodwald_ransom' AS dataset, 'subcat' AS field, CASE WHEN lower(subcat) LIKE 'princeton%' THEN 'princeton_huang_2018'
    WHEN lower(subcat) LIKE 'padua%' THEN 'padua_conti_2018' WHEN lower(subcat) LIKE 'montreal%' THEN 'montreal_paquet_clouston_2019' ELSE 'unmarked' END AS root,
    count(*) AS n_claims FROM claims WHERE source = 'rodwald_ransom' GROUP BY ALL)"""
PROPAGATION = """seed AS (SELECT DISTINCT subject FROM claims WHERE source = 'schnoering' AND subcat = 'Montréal'),
spread AS (SELECT 'montreal_paquet_clouston_2019' AS root, source, (SELECT count(*) FROM seed) AS seed_size,
    count(*) FILTER (WHERE subject IN (SELECT subject FROM seed)) AS n_found FROM named WHERE source <> 'schnoering' GROUP BY source),
propagation AS (SELECT *, n_found / nullif(seed_size, 0) AS share FROM spread)"""
FRESH = """fresh AS (SELECT source, count(*) AS n_claims, count(*) FILTER (WHERE currency = 'current') AS current, count(*) FILTER (WHERE currency = 'stale') AS stale,
    count(*) FILTER (WHERE currency = 'currency-unknown') AS currency_unknown FROM claims GROUP BY ROLLUP (source)),
freshness AS (SELECT *, current / n_claims AS current_share, stale / n_claims AS stale_share, currency_unknown / n_claims AS currency_unknown_share,
    stale / nullif(current + stale, 0) AS stale_share_of_dated FROM fresh)"""
REVENUE = """revenue AS (SELECT claim_seq, subject AS address, source, value_usd AS usd,
    source = 'ransomwhere' OR NOT (code LIKE '%%R%%' OR lower(subcat) LIKE 'princeton%%' OR lower(subcat) LIKE 'padua%%' OR lower(subcat) LIKE 'montreal%%') AS groundable
  FROM claims WHERE source IN ('rodwald_ransom', 'ransomwhere')),
anchors AS (%s),
per_address AS (SELECT address, count(*) AS n, sum(usd) AS total, max(usd) AS best, bool_or(groundable) AS ground, count(DISTINCT source) AS k,
    address IN (SELECT address FROM anchors) AS anchored FROM revenue GROUP BY address),
conditions AS (
  SELECT 'naive_union' AS policy, 'raw_sum' AS combine, CAST(sum(n) AS BIGINT) AS observations, count(*) AS addresses, sum(total) AS value FROM per_address
  UNION ALL SELECT 'address_dedup', 'dedup_max_per_address', count(*), count(*), sum(best) FROM per_address
  UNION ALL SELECT 'inheritance_collapsed', 'dedup_max_per_address', count(*), count(*), coalesce(sum(best), 0) FROM per_address WHERE ground
  UNION ALL SELECT 'verified_only', 'dedup_max_per_address', count(*), count(*), coalesce(sum(best), 0) FROM per_address WHERE anchored),
drift AS (SELECT c.*, c.value / b.value AS ratio, c.observations / b.observations AS cover, (SELECT count(*) FROM per_address WHERE k > 1) AS shared_addresses
  FROM conditions c, (SELECT * FROM conditions WHERE policy = 'address_dedup') b),
kept AS (SELECT address FROM per_address WHERE anchored)""" % W.for_duckdb(W.ANCHORS)
TRUTH = """truth AS (%s),
anchor AS (SELECT address, CASE label WHEN 'ransom' THEN 'ransomware' WHEN 'cex' THEN 'exchange' END AS canon, root AS anchor_root FROM truth),
met AS (SELECT c.subject AS address, a.canon AS anchor_canon, a.anchor_root, c.source, c.canon, c.root, c.resolved, c.polarity FROM claims c JOIN anchor a ON c.subject = a.address),
indep AS (SELECT * FROM met WHERE root <> anchor_root),
spoken AS (SELECT address, anchor_canon, source, canon, polarity, count(*) AS n, min(root) AS root FROM indep WHERE canon <> 'unknown' GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, source ORDER BY n DESC, canon) AS rn FROM spoken) WHERE rn = 1),
heard AS (SELECT DISTINCT address, anchor_canon, source FROM indep),
decided AS (SELECT h.address, h.anchor_canon, h.source, c.canon AS label, c.root, c.root IS NOT NULL AND NOT (c.root IN ('elliptic_undisclosed', 'schnoering_other') OR c.root LIKE 'rodwald_own_%%') AS known,
    CASE WHEN h.anchor_canon IS NULL THEN NULL WHEN c.canon IS NULL THEN 'incomparable' WHEN c.canon = h.anchor_canon THEN 'exact'
         WHEN c.polarity <> CASE h.anchor_canon WHEN 'exchange' THEN 'licit' ELSE 'illicit' END THEN 'licit/illicit conflict'
         WHEN c.canon LIKE '%%_unspec' THEN 'hierarchical refinement' ELSE 'entity-type conflict' END AS outcome
  FROM heard h LEFT JOIN chosen c USING (address, source))""" % W.for_duckdb(W.GROUND_TRUTH)

# the audited table (its own rule) and the reference claims it meets
TARGET = """target AS (SELECT *, CASE WHEN chain IS NOT NULL THEN chain || ':' || address ELSE address END AS subject,
    CASE subcat WHEN 'press' THEN 'ransomwhere_crowd' WHEN 'own' THEN 'order_desk_ledger' ELSE 'order_desk_other' END AS root, subcat IN ('press', 'own') AS resolved,
    CASE WHEN TRY_CAST(lastmod AS DATE) IS NULL THEN 'currency-unknown' WHEN date_diff('day', TRY_CAST(lastmod AS DATE), %s) / 365.25 > 3.0 THEN 'stale' ELSE 'current' END AS currency
  FROM (%s)),
text AS (SELECT lower(prov_family || ' ' || source_url || ' ' || notes) AS t FROM target),
naming AS (SELECT 'ransomwhere' AS source, count(*) FILTER (WHERE t LIKE '%%ransomwhere%%') AS n FROM text
           UNION ALL SELECT 'tagpack', count(*) FILTER (WHERE t LIKE '%%tagpack%%') FROM text),
mine AS (SELECT DISTINCT address FROM target WHERE chain IS NULL OR chain = 'bitcoin'),
shared AS (SELECT source, count(DISTINCT subject) AS n FROM claims WHERE subject IN (SELECT address FROM mine) GROUP BY source),
candidates AS (SELECT s.source, s.n AS n_shared, s.n / (SELECT count(*) FROM mine) AS share_in_reference, s.n / (SELECT count(*) FROM mine) >= 0.999 AS by_containment,
    coalesce(g.n, 0) AS n_naming FROM shared s LEFT JOIN naming g USING (source) WHERE (SELECT count(*) FROM mine) >= 5
    AND (s.n / (SELECT count(*) FROM mine) >= 0.999 OR coalesce(g.n, 0) > 0)),
asked AS (SELECT DISTINCT subject, address, chain FROM target),
joint AS (SELECT subject, true AS own, source, root, resolved, canon, polarity, false AS flagged FROM target
  UNION ALL SELECT a.subject, false, c.source, c.root, c.resolved, c.canon, c.polarity, c.source IN (SELECT source FROM candidates)
  FROM asked a JOIN claims c ON c.subject = a.address AND (a.chain IS NULL OR a.chain = 'bitcoin')),
tcount AS (SELECT subject, count(DISTINCT source) AS n_sources, count(DISTINCT CASE WHEN NOT own THEN source END) AS refs,
    count(DISTINCT CASE WHEN flagged THEN source END) AS flags, count(DISTINCT CASE WHEN resolved THEN root END) AS confirmed_roots,
    count(DISTINCT CASE WHEN resolved THEN source || '|' || root END) AS pairs, count(DISTINCT CASE WHEN NOT resolved THEN source END) AS unres,
    count(DISTINCT CASE WHEN resolved AND own THEN root END) AS own_roots, count(DISTINCT CASE WHEN resolved AND NOT own THEN root END) AS ref_roots,
    count(DISTINCT CASE WHEN canon <> 'unknown' THEN source END) AS ks, count(DISTINCT CASE WHEN canon <> 'unknown' THEN canon END) AS nc,
    count(DISTINCT CASE WHEN canon NOT IN ('unknown', 'illicit_unspec', 'licit_unspec') THEN canon END) AS nsp,
    count(DISTINCT CASE WHEN canon <> 'unknown' THEN polarity END) AS npol, count(*) FILTER (WHERE own AND canon <> 'unknown') AS own_known FROM joint GROUP BY subject),
on_both AS (SELECT DISTINCT a.subject FROM joint a JOIN joint b ON a.subject = b.subject AND a.root = b.root AND a.own AND NOT b.own AND a.resolved),
tsub AS (SELECT *, pairs > confirmed_roots AS circular,
    CASE WHEN refs = 0 THEN 'NO_REFERENCE_MATCH' WHEN flags = refs OR subject IN (SELECT subject FROM on_both) THEN 'REFERENCE_MATCH_BUT_SAME_PROVENANCE'
         WHEN own_roots > 0 AND ref_roots > 0 AND confirmed_roots >= 2 THEN 'REFERENCE_MATCH_WITH_DISTINCT_PROVENANCE' ELSE 'REFERENCE_RELATIONSHIP_UNRESOLVED' END AS comparability,
    CASE WHEN own_known = 0 THEN 'incomparable' WHEN ks < 2 THEN 'incomparable' WHEN nc = 1 THEN 'exact' WHEN npol > 1 THEN 'licit/illicit conflict'
         WHEN nsp <= 1 THEN 'hierarchical refinement' ELSE 'entity-type conflict' END AS any_outcome FROM tcount),
audit AS (SELECT *, CASE WHEN refs > 0 THEN any_outcome END AS outcome,
    CASE WHEN comparability IN ('REFERENCE_MATCH_BUT_SAME_PROVENANCE', 'REFERENCE_MATCH_WITH_DISTINCT_PROVENANCE') THEN 'resolved'
         WHEN comparability = 'REFERENCE_RELATIONSHIP_UNRESOLVED' AND flags > 0 THEN 'partially_resolved' ELSE 'unresolved' END AS resolution,
    CASE WHEN n_sources < 2 THEN NULL WHEN confirmed_roots >= 2 AND own_roots > 0 THEN 'confirmed' WHEN unres > 0 THEN 'unresolved' ELSE 'shared_only' END AS independence FROM tsub),
profile AS (SELECT count(*) AS n_subjects, count(*) FILTER (WHERE refs > 0) AS comparable, count(*) FILTER (WHERE refs = 0) AS no_match,
    count(*) FILTER (WHERE comparability = 'REFERENCE_MATCH_BUT_SAME_PROVENANCE') AS same_provenance,
    count(*) FILTER (WHERE comparability = 'REFERENCE_MATCH_WITH_DISTINCT_PROVENANCE') AS distinct_provenance,
    count(*) FILTER (WHERE outcome = 'exact') AS exact, count(*) FILTER (WHERE outcome = 'hierarchical refinement') AS refined,
    count(*) FILTER (WHERE outcome = 'entity-type conflict') AS entity_conflict, count(*) FILTER (WHERE outcome = 'licit/illicit conflict') AS polarity_conflict,
    count(*) FILTER (WHERE outcome = 'incomparable') AS incomparable, count(*) FILTER (WHERE resolution = 'resolved') AS resolved,
    count(*) FILTER (WHERE resolution = 'partially_resolved') AS partially_resolved, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved,
    count(*) FILTER (WHERE independence IS NOT NULL) AS apparent_multi_source, count(*) FILTER (WHERE independence = 'confirmed') AS confirmed_independent,
    count(*) FILTER (WHERE independence = 'shared_only') AS shared_or_inherited, count(*) FILTER (WHERE independence = 'unresolved') AS independence_unresolved FROM audit),
facts AS (SELECT count(*) AS n_claims, count(*) FILTER (WHERE currency = 'current') AS current, count(*) FILTER (WHERE currency = 'stale') AS stale,
    count(*) FILTER (WHERE currency = 'currency-unknown') AS currency_unknown, CAST(0 AS BIGINT) AS verified, CAST(0 AS BIGINT) AS derived,
    CAST(0 AS BIGINT) AS unverified_report, count(*) AS tier_unknown, count(*) FILTER (WHERE canon = 'unknown') AS n_uninterpretable,
    count(*) FILTER (WHERE prov_family <> '') AS n_declared, count(DISTINCT nullif(prov_family, '')) AS n_distinct_declared,
    count(*) FILTER (WHERE lastmod = '') AS n_without_date FROM target),
tself AS (SELECT subject, count(*) AS n_claims, count(DISTINCT source || '|' || raw_label) AS nv, count(*) FILTER (WHERE canon = 'unknown') AS blank,
    count(DISTINCT CASE WHEN canon <> 'unknown' THEN canon END) AS nc, count(DISTINCT CASE WHEN canon NOT IN ('unknown', 'illicit_unspec', 'licit_unspec') THEN canon END) AS nsp,
    count(DISTINCT CASE WHEN canon <> 'unknown' THEN polarity END) AS npol FROM target GROUP BY subject HAVING count(*) > 1),
self0 AS (SELECT *, CASE WHEN nc = 0 THEN NULL WHEN nc = 1 THEN 'exact' WHEN npol > 1 THEN 'licit/illicit conflict' WHEN nsp <= 1 THEN 'hierarchical refinement'
    ELSE 'entity-type conflict' END AS outcome FROM tself),
selfc AS (SELECT subject, n_claims, nc AS n_categories, outcome, CASE WHEN blank > 0 THEN CASE WHEN nv = 1 AND nc = 0 THEN 'repeated observation' ELSE 'uninterpretable multi-label' END
    WHEN nc = 1 THEN CASE WHEN nv = 1 THEN 'repeated observation' ELSE 'repeated same label' END
    WHEN outcome = 'hierarchical refinement' THEN 'compatible multi-label claim' ELSE 'internal contradiction' END AS bucket FROM self0),
shares AS (SELECT * FROM (
    SELECT 'rejected_row_share' AS measure, CAST(NULL AS DOUBLE) AS share, 0.01 AS cav, 0.25 AS bad FROM profile
    UNION ALL SELECT 'internal_contradiction_share', (SELECT count(*) FROM selfc WHERE bucket = 'internal contradiction') / n_subjects, 0.001, 0.02 FROM profile
    UNION ALL SELECT 'uninterpretable_label_share', n_uninterpretable / n_claims, 0.25, NULL FROM facts
    UNION ALL SELECT 'no_reference_match_share', CASE WHEN comparable >= 30 THEN no_match / n_subjects END, 0.5, NULL FROM profile
    UNION ALL SELECT 'reference_conflict_share', CASE WHEN comparable >= 30 THEN (entity_conflict + polarity_conflict) / nullif(exact + refined + entity_conflict + polarity_conflict, 0) END, 0.02, 0.10 FROM profile
    UNION ALL SELECT 'same_provenance_share', CASE WHEN comparable >= 30 AND same_provenance > 0 THEN same_provenance / comparable END, 0.5, NULL FROM profile
    UNION ALL SELECT 'unresolved_provenance_share', unresolved / n_subjects, 0.5, NULL FROM profile
    UNION ALL SELECT 'stale_share', CASE WHEN n_claims > n_without_date THEN stale / n_claims END, 0.5, NULL FROM facts)),
found AS (SELECT measure, share, CASE WHEN share IS NULL THEN 'info' WHEN share >= bad THEN 'fail' WHEN share >= cav THEN 'caveat' ELSE 'ok' END AS level FROM shares)""" % (_DAY, W.for_duckdb(W.TARGET))

UPLOAD = """upl AS (%s),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet_address, network, categories, origin, updated_at ORDER BY row_id) AS rn FROM upl)),
read_rows AS (SELECT *, trim(wallet_address) AS addr, CASE network WHEN '' THEN 'ethereum' WHEN 'Ethereum' THEN 'ethereum' WHEN 'eth' THEN 'ethereum' WHEN 'Polygon-Mainnet' THEN 'polygon'
    WHEN 'BSC' THEN 'bnb_smart_chain' WHEN 'btc' THEN 'bitcoin' WHEN 'avalanche c chain' THEN 'avalanche_c' END AS row_chain FROM firsts WHERE rn = 1),
tested AS (SELECT *, CASE WHEN addr = '' THEN 'empty address' WHEN row_chain IS NULL THEN 'unresolved chain'
    WHEN row_chain = 'bitcoin' OR NOT regexp_full_match(addr, '0x[0-9a-fA-F]{40}') THEN 'invalid address' WHEN categories = '' THEN 'missing label' END AS r0 FROM read_rows),
tokens AS (SELECT row_id, row_chain, lower(addr) AS ident, origin, unnest(string_split(categories, ',')) AS token FROM tested WHERE r0 IS NULL),
winners AS (SELECT row_chain, ident, origin, token, min(row_id) AS row_id FROM tokens GROUP BY ALL),
judged AS (SELECT *, CASE WHEN r0 IS NULL AND row_id NOT IN (SELECT row_id FROM winners) THEN 'duplicate claim' ELSE r0 END AS reason FROM tested),
every AS (SELECT row_id, reason, addr, row_chain, wallet_address FROM judged UNION ALL SELECT row_id, 'duplicate row', NULL, NULL, NULL FROM firsts WHERE rn > 1),
built AS (SELECT j.row_id, j.row_chain, j.addr, j.categories, j.origin, j.updated_at, w.token FROM judged j JOIN winners w USING (row_id)),
uclaims AS (SELECT row_id AS record_id, row_chain || ':' || lower(addr) AS subject, row_chain AS chain, lower(addr) AS address, addr AS raw_address, '' AS raw_label,
    token AS subcat, CASE WHEN contains(categories, ',') THEN categories END AS label_cell, token AS canon, CASE token WHEN 'exchange' THEN 'licit' ELSE 'illicit' END AS polarity,
    origin AS prov_family, updated_at AS lastmod, 'upload_desk:unresolved' AS root, 'UNKNOWN' AS prov_kind FROM built)""" % W.for_duckdb(W.UPLOAD)

JOINED = """jrows AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '0x' || substr(md5(CAST(o_custkey AS VARCHAR)) || md5('x' || CAST(o_custkey AS VARCHAR)), 1, 40) END AS hex,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'exchange' WHEN 'AUTOMOBILE' THEN 'mixer' WHEN 'BUILDING' THEN '' WHEN 'HOUSEHOLD' THEN 'casino' ELSE CASE WHEN c_custkey IS NULL THEN '' ELSE 'other thing' END END AS segment,
    coalesce(n_name, '') AS nation, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
jt AS (SELECT *, CASE WHEN hex = '' THEN 'empty address' WHEN segment = '' THEN 'missing label' END AS r0 FROM jrows),
jj AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY r0 IS NULL, hex, segment, nation ORDER BY row_id) > 1 THEN 'duplicate claim' ELSE r0 END AS reason FROM jt),
jc AS (SELECT *, CASE segment WHEN 'casino' THEN 'gambling' WHEN 'other thing' THEN 'unknown' ELSE segment END AS canon FROM jj WHERE reason IS NULL)"""


def _records(rows: list[tuple[str, str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, '{p}' AS population, CAST({v} AS BIGINT) AS value, CAST({n} AS BIGINT) AS numerator, CAST({d} AS BIGINT) AS denominator"
        for m, p, v, n, d in rows)


def _coverage(rules: dict[str, str], chosen: list[str], skipped: set[str], source: str, extra: str = "") -> str:
    """Steps of the coverage report: each rule alone, then the chosen ones in order."""
    steps = [("alone", r, None if r in skipped else [r]) for r in rules]
    combo: list[str] = []
    for r in chosen:
        if r in skipped:
            steps.append(("together", r, None))
        else:
            combo = combo + [r]
            steps.append(("together", r, list(combo)))
    out = []
    for i, (mode, rule, ids) in enumerate(steps):
        if ids is None:
            out.append(f"SELECT {i} AS step, '{mode}' AS mode, '{rule}' AS rule, 'not_applicable' AS state, CAST(NULL AS BIGINT) AS n_claims, "
                       "CAST(NULL AS BIGINT) AS n_subjects, CAST(NULL AS DOUBLE) AS claims_share")
        else:
            where = " AND ".join(f"({rules[r]})" for r in ids)
            out.append(f"SELECT {i} AS step, '{mode}' AS mode, '{rule}' AS rule, 'computed' AS state, count(*) AS n_claims, count(DISTINCT subject) AS n_subjects, count(*) / (SELECT count(*) FROM {source}) AS claims_share FROM {source} WHERE {where}")
    return "\nUNION ALL ".join(out)


RULE_SQL = {"resolved_provenance_only": "resolved", "non_circular": "NOT circular",
            "exclude_licit_illicit_conflict": "NOT (n_sources >= 2 AND outcome = 'licit/illicit conflict')",
            "exclude_conflicts": "NOT (n_sources >= 2 AND outcome IN ('licit/illicit conflict', 'entity-type conflict'))",
            "current_only": "currency <> 'stale'", "known_evidence_tier": "tier <> 'unknown'"}
CHOSEN = ["resolved_provenance_only", "non_circular", "current_only", "exclude_conflicts"]


def survey(tables: dict[str, tuple[str, list[str]]], choices: dict[str, dict[str, str]] | None = None) -> str:
    """The statements ``parts`` (a row per column) and ``kinds`` (a row per table) of a survey.  Columns are spelled as their normal names, and no cell is an identifier
    of a chain other than hexadecimal ones."""
    reg = Registry.load()
    c, q = reg.intake, lambda x: "NULL" if x is None else f"'{x}'"
    words = lambda xs: "CAST([" + ", ".join(q(x) for x in xs) + "] AS VARCHAR[])"
    cells = " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS pos, '{x}' AS col, row_id, trim({x}) AS v FROM ({W.for_duckdb(sql)})" for t, (sql, cols) in tables.items() for i, x in enumerate(cols))
    schema = ", ".join(f"('{t}', {i}, '{x}', {q((choices or {}).get(t, {}).get(x))})" for t, (_, cols) in tables.items() for i, x in enumerate(cols))
    known = ", ".join(f"({i}, '{m}', '{t}', {q(r)}, {str(sh).lower()}, {words(wh)}, {words(wo)}, '{'subject' if m.startswith('subject_') else m}', {q(t.partition(':')[2] or None)})"
                      for i, (m, (t, r, sh, wh, wo)) in enumerate(c["meanings"].items()))
    aliases = ", ".join(f"('{a}', '{ch}')" for ch, spec in reg.chains.items() for a in {ch, *spec["aliases"]})
    isin = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
    return f"""
cells AS (SELECT * FROM ({cells}) WHERE v <> ''),
aliases(alias, chain) AS (VALUES {aliases}),
read AS (SELECT c.*, a.chain, regexp_full_match(v, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AS num, regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?') AND TRY_CAST(substr(v, 1, 10) AS DATE) IS NOT NULL AS day,
           regexp_matches(lower(v), '^https?://') AS url, regexp_full_match(v, '0x[0-9a-fA-F]{{40}}') AS hexa, CASE WHEN regexp_full_match(v, '[+-]?\\d+') THEN TRY_CAST(v AS HUGEINT) END AS whole,
           len(list_intersect(regexp_split_to_array(lower(v), '[^a-z]+'), (SELECT list(alias) FROM aliases))) > 0 AS asset
         FROM cells c LEFT JOIN aliases a ON regexp_replace(regexp_replace(lower(v), '[^a-z0-9]+', '_', 'g'), '_mainnet$', '') = a.alias),
prof AS (SELECT tbl, col, count(*) AS n, avg(num::INT) AS numeric_, avg(day::INT) AS date_, avg(url::INT) AS url_, avg((NOT (num OR day OR url))::INT) AS text_,
           avg((chain IS NOT NULL)::INT) AS chain_named, list(DISTINCT chain) FILTER (chain IS NOT NULL) AS chains, avg(hexa::INT) AS valid, avg((v IN {isin(c["confidence_grades"])})::INT) AS graded,
           count(*) >= 3 AND count(whole) = count(*) AND min(whole - row_id) = max(whole - row_id) AS counter, count(DISTINCT length(v)) AS lengths, min(length(v)) AS shortest, max(length(v)) AS longest,
           bool_and(regexp_full_match(v, '[0-9a-zA-Z]+')) AS opaque, bool_or(asset) AS asset FROM read GROUP BY tbl, col),
facts AS (SELECT s.tbl, s.pos, s.col, s.chosen, coalesce(n, 0) AS n, coalesce(counter, false) AS counter, chains, chain_named, lengths, shortest, longest, opaque, asset,
            coalesce(numeric_, 0) AS numeric_, coalesce(date_, 0) AS date_, coalesce(url_, 0) AS url_, coalesce(text_, 0) AS text_, coalesce(graded, 0) AS graded, coalesce(valid, 0) AS valid,
            coalesce(numeric_ >= 0.9, false) AS is_number, coalesce(date_ >= 0.8, false) AS is_date, coalesce(NOT counter AND numeric_ < 0.9 AND valid >= 0.3, false) AS is_identifier,
            regexp_matches(s.col, 'address|wallet|addr|acct|account') AS address_named, regexp_matches(s.col, 'symbol|ticker|pair|coin|currency|asset|market') AS asset_named,
            count(DISTINCT CASE WHEN numeric_ >= 0.9 AND s.col IN {isin(c["market"]["columns"])} THEN s.col END) OVER (PARTITION BY s.tbl) >= 3 AS market
          FROM (VALUES {schema}) AS s(tbl, pos, col, chosen) LEFT JOIN prof p ON p.tbl = s.tbl AND p.col = s.col),
meanings(place, meaning, test, role, shared, whole, words, slot, kind) AS (VALUES {known}),
named AS (SELECT f.*, m.*, CASE WHEN list_contains(whole, col) THEN 1.0 WHEN list_has_any(words, string_split(col, '_')) THEN 0.7 ELSE 0.0 END AS name FROM facts f CROSS JOIN meanings m),
valued AS (SELECT *, CASE WHEN n = 0 OR (is_identifier AND meaning IN {isin(c["never_identifiers"])}) THEN 0.0
             WHEN test LIKE 'subject:%' THEN CASE WHEN counter THEN 0.0 WHEN kind IN ('entity', 'cluster') THEN 0.5 WHEN is_number OR kind = 'transaction' THEN 0.0 ELSE valid END
             WHEN test = 'date' OR meaning = 'ts_market_candle' THEN date_ WHEN meaning IN ('market_numeric', 'numeric_unclassified') THEN numeric_ WHEN test = 'text' THEN text_ WHEN test = 'chain' THEN coalesce(chain_named, 0)
             WHEN test = 'source' THEN CASE WHEN name > 0 OR chosen = meaning THEN least(1.0, url_ + text_) ELSE url_ END WHEN test = 'grade' THEN (is_number OR graded >= 0.9)::INT ELSE 0.0 END AS value FROM named),
scored AS (SELECT *, round(0.4 * name + 0.6 * value, 4) AS confidence FROM valued),
taken_slots AS (SELECT tbl, list(slot) AS slots FROM scored WHERE chosen = meaning AND NOT shared GROUP BY tbl),
considered AS (SELECT s.* FROM scored s LEFT JOIN taken_slots t USING (tbl) WHERE chosen IS NULL AND NOT (market AND (is_number OR is_date)) AND test <> 'shape'
               AND (shared OR NOT coalesce(list_contains(t.slots, slot), false)) AND (name > 0 OR meaning IN {isin(c["from_values_alone"])})),
refused AS (SELECT DISTINCT tbl, col FROM considered WHERE confidence < 0.5 AND name > 0 AND slot = 'subject'),
picks(tbl, cols, slots, col, meaning, confidence) AS (
  SELECT DISTINCT tbl, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM facts
  UNION ALL
  SELECT p.tbl, list_append(p.cols, o.col), CASE WHEN o.shared THEN p.slots ELSE list_append(p.slots, o.slot) END, o.col, o.meaning, o.confidence
  FROM picks p JOIN considered o ON o.tbl = p.tbl AND o.confidence >= 0.5 AND NOT list_contains(p.cols, o.col) AND (o.shared OR NOT list_contains(p.slots, o.slot))
  QUALIFY row_number() OVER (PARTITION BY p.tbl ORDER BY o.confidence DESC, o.place, o.col) = 1),
given AS (SELECT f.*, coalesce(chosen, CASE WHEN market AND is_number THEN 'market_numeric' WHEN market AND is_date THEN 'ts_market_candle' END, k.meaning,
                               CASE WHEN is_date THEN 'ts_unclassified' WHEN is_number THEN 'numeric_unclassified' ELSE 'unmapped' END) AS meaning,
            CASE WHEN chosen IS NULL THEN CASE WHEN market AND is_number THEN round(numeric_, 4) WHEN market AND is_date THEN round(date_, 4) WHEN k.confidence IS NOT NULL THEN k.confidence WHEN is_date THEN round(date_ * 0.6, 4) END END AS sure,
            CASE WHEN chosen IS NULL THEN 'inferred' ELSE 'user' END AS origin, r.col IS NOT NULL AS rejected_as_subject
          FROM facts f LEFT JOIN picks k ON k.tbl = f.tbl AND k.col = f.col LEFT JOIN refused r ON r.tbl = f.tbl AND r.col = f.col),
objected AS (SELECT g.*, s.kind, s.role, s.name, s.value, list_filter([
               CASE WHEN rejected_as_subject AND g.meaning IN ('unmapped', 'numeric_unclassified') THEN 'identifiers_do_not_fit_the_name' END,
               CASE WHEN s.kind IN ('address', 'transaction') AND s.value < 0.3 THEN 'too_few_valid_identifiers' END,
               CASE WHEN origin = 'user' AND g.meaning <> 'unmapped' AND g.n = 0 THEN 'no_values' END,
               CASE WHEN origin = 'user' AND g.meaning LIKE 'ts\\_%' ESCAPE '\\' AND NOT g.is_date THEN 'not_dates' END,
               CASE WHEN origin = 'user' AND g.is_identifier AND g.meaning IN {isin(c["never_identifiers"])} THEN 'holds_identifiers' END,
               CASE WHEN origin = 'user' AND (g.meaning LIKE 'ts\\_%' ESCAPE '\\' OR g.meaning IN {isin(c["strict_values"])}) AND s.value < 0.5 THEN 'values_do_not_fit' END], lambda x: x IS NOT NULL) AS objections
             FROM given g JOIN scored s ON s.tbl = g.tbl AND s.col = g.col AND s.meaning = g.meaning),
first_parts AS (SELECT *, CASE WHEN origin = 'user' AND meaning <> 'unmapped' THEN round(value, 4) ELSE sure END AS confidence0,
             CASE WHEN len(objections) > 0 THEN 'invalid' WHEN meaning IN ('unmapped', 'numeric_unclassified') THEN 'unused'
                  WHEN origin = 'inferred' AND (meaning = 'ts_unclassified' OR (sure < 0.75 AND meaning NOT IN ('market_numeric', 'ts_market_candle'))) THEN 'review' ELSE 'ok' END AS status0 FROM objected),
subjects_ AS (SELECT tbl, arg_min(col, pos) AS subject, arg_min(kind, pos) AS kind, arg_min(valid, pos) AS valid, arg_min(name, pos) AS name, arg_min(origin, pos) AS origin FROM first_parts WHERE kind IS NOT NULL GROUP BY tbl),
columns_ AS (SELECT tbl, arg_min(col, pos) AS chain_col, arg_min(chains, pos) AS chains, arg_min(chain_named, pos) AS chain_named FROM first_parts WHERE meaning = 'chain' AND status0 <> 'invalid' GROUP BY tbl),
chained AS (SELECT t.tbl, s.subject, s.kind, s.valid, s.name, s.origin, chain_col, CASE WHEN s.kind IS NULL OR s.kind IN ('entity', 'cluster') THEN 'not_required' WHEN len(chains) = 1 AND chain_named = 1 THEN 'determined'
              WHEN len(chains) > 0 AND s.kind = 'address' THEN 'per_row' WHEN s.valid >= 0.3 THEN 'ambiguous' ELSE 'undetermined' END AS chain_status,
              CASE WHEN s.kind IN ('address', 'transaction') AND len(chains) = 1 AND chain_named = 1 THEN chains[1] END AS chain
            FROM (SELECT DISTINCT tbl FROM facts) t LEFT JOIN subjects_ s ON s.tbl = t.tbl LEFT JOIN columns_ k ON k.tbl = t.tbl),
stated AS (SELECT k.tbl, round(avg((a.hexa AND n.chain <> 'bitcoin')::INT), 4) AS rate FROM chained k JOIN read n ON n.tbl = k.tbl AND n.col = k.chain_col AND n.chain IS NOT NULL
           JOIN read a ON a.tbl = k.tbl AND a.col = k.subject AND a.row_id = n.row_id WHERE chain_status = 'per_row' GROUP BY k.tbl),
parts AS (SELECT p.* EXCLUDE (confidence0, status0), CASE WHEN p.col = k.subject AND chain_status = 'per_row' THEN CASE WHEN p.origin = 'user' THEN coalesce(rate, 0) ELSE round(0.4 * p.name + 0.6 * coalesce(rate, 0), 4) END ELSE confidence0 END AS confidence,
            CASE WHEN p.col = k.subject AND chain_status = 'per_row' THEN CASE WHEN coalesce(rate, 0) < 0.3 THEN 'invalid' WHEN p.origin = 'user' OR status0 = 'invalid' THEN status0
                        WHEN round(0.4 * p.name + 0.6 * coalesce(rate, 0), 4) >= 0.75 THEN 'ok' ELSE 'review' END
                 WHEN p.col = k.subject AND k.kind = 'address' AND k.chain IS NOT NULL AND (k.valid < 0.3 OR k.chain = 'bitcoin') THEN 'invalid' ELSE status0 END AS status
          FROM first_parts p JOIN chained k USING (tbl) LEFT JOIN stated s USING (tbl)),
summed AS (SELECT p.tbl, any_value(k.kind) AS kind, any_value(k.chain) AS chain, any_value(k.chain_status) AS chain_status, any_value(k.subject) AS subject,
             bool_or(p.col = k.subject AND status <> 'invalid') AS good, bool_or(p.col = k.subject AND status = 'invalid') AS lost, bool_or(p.col = k.subject AND status = 'review') AS unsure,
             count(*) FILTER (p.origin = 'user' AND status = 'invalid') AS wrong, count(*) FILTER (rejected_as_subject OR (p.kind IS NOT NULL AND status = 'invalid')) AS failed,
             coalesce(arg_min(status, pos) FILTER (meaning = 'attribution_category' AND status <> 'invalid'), arg_min(status, pos) FILTER (meaning = 'attribution_label' AND status <> 'invalid'),
                      arg_min(status, pos) FILTER (meaning = 'attribution_entity' AND status <> 'invalid')) AS label,
             bool_or(meaning = 'chain' AND status <> 'invalid') AS has_chain, bool_or(meaning = 'chain') AS any_chain, bool_or(meaning = 'market_numeric' AND p.origin = 'inferred') AS market,
             coalesce(max_by(p.valid, [p.valid + CASE WHEN address_named THEN 0.05 ELSE 0 END, -pos]) FILTER (n > 0), 0) < 0.05 AS none_valid,
             coalesce(bool_or(address_named AND n >= 3 AND lengths <= 2 AND opaque AND shortest >= 18 AND longest <= 100), false) AS foreign_ids, coalesce(bool_or(asset_named AND asset), false) AS assets,
             coalesce(arg_min(p.col, pos) FILTER (meaning = 'ts_attribution_last_verified' AND status <> 'invalid'), arg_min(p.col, pos) FILTER (meaning = 'ts_attribution_last_updated' AND status <> 'invalid')) AS currency_basis
           FROM parts p JOIN chained k USING (tbl) GROUP BY p.tbl),
typed AS (SELECT *, CASE WHEN good THEN CASE WHEN kind = 'address' THEN 'attribution_claims' ELSE 'unsupported_subject_kind' END WHEN wrong > 0 THEN 'mapping_unresolved'
            WHEN label IS NOT NULL AND failed > 0 AND has_chain THEN 'attribution_like_unresolved' WHEN none_valid AND foreign_ids THEN 'unsupported_chain_attribution' WHEN market THEN 'market_timeseries'
            WHEN label IS NOT NULL AND failed > 0 THEN 'attribution_like_unresolved' WHEN (none_valid AND assets) OR any_chain THEN 'crypto_non_attribution' ELSE 'non_crypto' END AS dataset_type FROM summed),
blocked AS (SELECT *, CASE dataset_type
     WHEN 'attribution_claims' THEN [CASE WHEN chain_status IN ('undetermined', 'ambiguous') THEN 'chain_required' END, CASE WHEN label IS NULL THEN 'missing_label' END, CASE WHEN unsure OR label = 'review' THEN 'needs_confirmation' END]
     WHEN 'mapping_unresolved' THEN list_append(list_transform(range(wrong), lambda i: 'user_mapping_invalid'), CASE WHEN lost THEN 'subject_invalid' END)
     WHEN 'unsupported_subject_kind' THEN ['subject_kind_unsupported'] ELSE [CASE WHEN lost THEN 'subject_invalid' ELSE 'missing_subject' END, CASE WHEN label IS NULL THEN 'missing_label' END] END AS b FROM typed),
kinds AS (SELECT *, list_filter(b, lambda x: x IS NOT NULL) AS blockers, CASE WHEN dataset_type IN ('market_timeseries', 'crypto_non_attribution', 'non_crypto', 'unsupported_chain_attribution') THEN 'unsupported'
            WHEN len(list_filter(b, lambda x: x IS NOT NULL AND x <> 'needs_confirmation')) > 0 THEN 'blocked' WHEN len(list_filter(b, lambda x: x IS NOT NULL)) > 0 THEN 'needs_confirmation' ELSE 'ready' END AS table_status FROM blocked)"""


def resampling(classes: str, values: list[str], seed: int, replicates: int) -> str:
    """The statement ``drawn`` (stream, rep, sums of the values): multinomial draws as chains of binomials down a tree of two hexadecimal digits, each binomial found
    by inversion or by transformed rejection with the logarithms of factorials.  ``classes`` is a query of (stream, values, m)."""
    number = lambda text, at: f"(CAST('0x' || substr(md5({text}), {at}, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
    start = "{'k': 0.0::DOUBLE, 'u': u0, 'f': exp(lft * ln(1 - q)), 'done': false}"
    inverted = (f"list_reduce(list_transform(range(66), lambda i: {start}), lambda s, x: CASE WHEN s.done THEN s WHEN s.u <= s.f THEN {{'k': s.k, 'u': s.u, 'f': s.f, 'done': true}} "
                "ELSE {'k': s.k + 1, 'u': s.u - s.f, 'f': s.f * q / (1 - q) * (lft - s.k) / (s.k + 1), 'done': false} END).k")
    odds = "(lgamma(mode + 1) + lgamma(lft - mode + 1) - lgamma(t.k + 1) - lgamma(lft - t.k + 1) + (t.k - mode) * ln(q / (1 - q)))"
    tried = ("list_transform([{'u': " + number("key || ':' || CAST(CAST(i AS INTEGER) AS VARCHAR)", 1) + " - 0.5, 'v': " + number("key || ':' || CAST(CAST(i AS INTEGER) AS VARCHAR)", 14) + "}], "
             "lambda r: {'us': 0.5 - abs(r.u), 'v': r.v, 'k': floor((2 * a / (0.5 - abs(r.u)) + b) * r.u + lft * q + 0.5)})[1]")
    accepted = (f"list_reduce(list_prepend(CAST(NULL AS DOUBLE), list_transform(range(1, 41), lambda i: CAST(i AS DOUBLE))), lambda got, i: CASE WHEN got IS NOT NULL THEN got ELSE list_transform([{tried}], lambda t: "
                f"CASE WHEN t.k < 0 OR t.k > lft THEN NULL WHEN t.us >= 0.07 AND t.v <= 0.92 - 4.2 / b THEN t.k WHEN ln(t.v * alpha / (a / (t.us * t.us) + b)) <= {odds} THEN t.k END)[1] END)")
    out = [f"classes AS (SELECT *, md5(concat_ws(',', {', '.join(values)})) AS id FROM ({classes}))",
           f"walk0 AS (SELECT stream, CAST('' AS VARCHAR) AS id, rep, CAST(n AS DOUBLE) AS k FROM (SELECT stream, sum(m) AS n FROM classes GROUP BY stream) CROSS JOIN range({replicates}) r(rep))"]
    for level in range(3):
        child = "id" if level == 2 else f"substr(id, 1, {level + 1})"
        out.append(f"""nodes{level + 1} AS (SELECT stream, node, id, CAST(m AS DOUBLE) AS m, row_number() OVER w AS idx, CAST(sum(m) OVER (PARTITION BY stream, node ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest
            FROM (SELECT stream, substr(id, 1, {level}) AS node, {child} AS id, sum(m) AS m FROM classes GROUP BY ALL) WINDOW w AS (PARTITION BY stream, node ORDER BY id))""")
        out.append(f"""steps{level + 1}(stream, node, rep, idx, id, lft, k) AS (
            SELECT stream, id, rep, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), k, CAST(0 AS DOUBLE) FROM walk{level} WHERE k > 0
            UNION ALL
            SELECT stream, node, rep, idx, id, lft - k, k FROM (
              SELECT *, CASE WHEN lft <= 0 OR p <= 0 THEN 0 WHEN p >= 1 THEN lft WHEN p > 0.5 THEN lft - kk ELSE kk END AS k FROM (
                SELECT *, CASE WHEN lft <= 0 OR q <= 0 THEN 0 WHEN lft * q < 10 THEN least(lft, {inverted}) ELSE coalesce({accepted}, mode) END AS kk FROM (
                  SELECT *, {number("key || ':0'", 1)} AS u0, -0.0873 + 0.0248 * b + 0.01 * q AS a, (2.83 + 5.1 / b) * sqrt(lft * q * (1 - q)) AS alpha, floor((lft + 1) * q) AS mode FROM (
                    SELECT *, 1.15 + 2.53 * sqrt(lft * q * (1 - q)) AS b FROM (
                      SELECT w.stream, w.node, w.rep, x.idx, x.id, w.lft, x.m / x.rest AS p, least(x.m / x.rest, 1 - x.m / x.rest) AS q, '{seed}:' || w.stream || ':' || w.rep || ':' || x.id AS key
                      FROM steps{level + 1} w JOIN nodes{level + 1} x ON x.stream = w.stream AND x.node = w.node AND x.idx = w.idx + 1)))))),
          walk{level + 1} AS (SELECT stream, id, rep, k FROM steps{level + 1} WHERE k > 0)""")
    sums = ", ".join(f"sum(w.k * c.{v}) AS {v}" for v in values)
    out.append(f"drawn AS (SELECT w.stream, w.rep, {sums} FROM walk3 w JOIN classes c ON c.stream = w.stream AND c.id = w.id GROUP BY w.stream, w.rep)")
    return ",\n".join(out)


def intervals(rate: str) -> str:
    """(stream, lo, hi) of a rate over the draws."""
    return (f"SELECT stream, v[1 + CAST(floor(0.025 * (len(v) - 1)) AS INTEGER)] AS lo, v[1 + CAST(floor(0.975 * (len(v) - 1)) AS INTEGER)] AS hi "
            f"FROM (SELECT stream, list({rate} ORDER BY {rate}) FILTER ({rate} IS NOT NULL) AS v FROM drawn GROUP BY stream)")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["claims_normalised"] = _claims("""SELECT claim_seq, subject, address AS raw_address, source, canon, root, resolved AS prov_resolved, native AS prov_native, verified AS prov_verified,
        kind AS prov_kind, resolved AS root_known, tier, CASE WHEN NOT resolved THEN 'unresolved' WHEN native THEN 'resolved' ELSE 'inherited' END AS provenance, currency,
        substr(lastmod, 1, 10) AS day FROM claims""")
    q["label_categories"] = _claims("""SELECT raw_label, CASE raw_label WHEN 'casino' THEN 'gambling' WHEN 'class_3' THEN NULL WHEN 'tormarket:hydra' THEN 'darknet_market'
        ELSE lower(raw_label) END AS category, CASE raw_label WHEN 'tormarket:hydra' THEN 'hydra' END AS entity, count(*) AS n_claims FROM claims GROUP BY ALL""")
    q["rederived_unknown"] = _claims("""SELECT source, CASE raw_label WHEN 'casino' THEN 'gambling' ELSE 'darknet_market' END AS canon, count(*) AS n_claims
        FROM claims WHERE canon = 'unknown' AND raw_label IN ('casino', 'tormarket:hydra') GROUP BY ALL""")
    q["chain_names"] = f"""WITH u AS ({W.for_duckdb(W.UPLOAD)}), c AS (SELECT *, CASE network WHEN 'Ethereum' THEN 'ethereum' WHEN 'eth' THEN 'ethereum' WHEN 'Polygon-Mainnet' THEN 'polygon'
        WHEN 'BSC' THEN 'bnb_smart_chain' WHEN 'btc' THEN 'bitcoin' WHEN 'avalanche c chain' THEN 'avalanche_c' END AS chain FROM u)
        SELECT network, chain, count(*) AS n_rows, count(*) FILTER (WHERE CASE WHEN chain IS NOT NULL AND chain <> 'bitcoin' THEN lower(trim(wallet_address)) ELSE trim(wallet_address) END <> wallet_address) AS n_respelled,
        count(*) FILTER (WHERE trim(wallet_address) <> wallet_address) AS n_trimmed FROM c GROUP BY ALL"""
    q["subject_profile"] = _subjects("""SELECT subject, n_claims, n_sources, known_sources, unresolved_sources, n_roots, confirmed_roots, shared_roots, circular,
        independence_min, independence_max, relationship, n_categories, outcome FROM subjects""")
    q["agreement_outcomes"] = _subjects(f"""SELECT o.col0 AS outcome, count(s.subject) AS n, count(s.subject) / (SELECT count(*) FROM subjects WHERE n_sources >= 2) AS share
        FROM {_OUT5} o LEFT JOIN subjects s ON s.outcome = o.col0 AND s.n_sources >= 2 GROUP BY ALL""")
    q["corroboration"] = _subjects("""SELECT count(*) AS n_subjects, count(*) FILTER (WHERE n_sources >= 2) AS n_multi_source,
        count(*) FILTER (WHERE n_sources < 2) AS n_single_source, count(*) FILTER (WHERE n_sources >= 2) / count(*) AS multi_source_rate FROM subjects""")
    q["source_depth"] = _subjects("""SELECT d.col0 AS depth, count(s.subject) AS n_subjects, count(s.subject) / (SELECT count(*) FROM subjects) AS share
        FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4', 4, 4), ('5+', 5, 1000)) d LEFT JOIN subjects s ON s.n_sources BETWEEN d.col1 AND d.col2 GROUP BY ALL""")
    q["corpus_table"] = _claims("SELECT source, count(DISTINCT subject) AS n_subjects, count(*) AS n_claims, bool_or(lastmod <> '') AS has_revision_date FROM claims GROUP BY ROLLUP (source)")
    q["overlap_matrix"] = _claims("SELECT * FROM matrix", NAMED, PAIRS)
    q["source_coverage"] = _claims("""SELECT s.source, s.size AS n_subjects, CAST(c.n AS BIGINT) AS n_covered, c.n / s.size AS covered_share, 1 - c.n / s.size AS uncovered_share, m.best AS max_pairwise_share
        FROM sizes s JOIN (SELECT a.source, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM named b WHERE b.subject = a.subject AND b.source <> a.source)) AS n FROM named a GROUP BY 1) c USING (source)
        LEFT JOIN (SELECT source, max(share_of_source) AS best FROM matrix GROUP BY 1) m USING (source)""", NAMED, PAIRS)
    q["containment_top"] = _claims("SELECT source, other AS inside, intersection AS n, share_of_source AS share_of_a FROM matrix WHERE intersection > 0 ORDER BY share_of_source DESC, source, other LIMIT 12", NAMED, PAIRS)
    q["kappa_pairs"] = _claims("SELECT * FROM kappa", KAPPA)
    q["kappa_summary"] = _claims("""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE cohen_kappa IS NULL) AS n_undefined, count(*) FILTER (WHERE abs(cohen_kappa) < 1e-9) AS n_zero,
        count(*) FILTER (WHERE substantial) AS n_substantial FROM kappa""", KAPPA)
    q["polarity_conflicts_top"] = _claims("""SELECT source_a, label_a, source_b, label_b, n FROM (
        SELECT a.source AS source_a, a.canon AS label_a, b.source AS source_b, b.canon AS label_b, count(*) AS n, min(fs) AS fs
        FROM last a JOIN last b ON a.subject = b.subject AND a.source < b.source JOIN seen ON seen.subject = a.subject WHERE a.polarity <> b.polarity GROUP BY ALL)
        ORDER BY n DESC, fs, source_a, label_a, source_b, label_b LIMIT 10""",
        "last AS (SELECT subject, source, canon, polarity FROM (SELECT *, row_number() OVER (PARTITION BY subject, source ORDER BY claim_seq DESC, canon DESC) AS rn FROM claims WHERE canon <> 'unknown') WHERE rn = 1)",
        "seen AS (SELECT subject, min(claim_seq) AS fs FROM claims WHERE canon <> 'unknown' GROUP BY subject)")
    q["modal_labels"] = _claims("SELECT * FROM modal", MODAL)
    q["dominant_roots"] = _claims("SELECT subject, root, resolved AS root_known FROM dominant", DOMINANT)
    q["root_totals"] = _claims("""SELECT count(DISTINCT root) AS n_roots, count(DISTINCT CASE WHEN resolved THEN root END) AS n_identified,
        count(DISTINCT CASE WHEN NOT resolved THEN root END) AS n_unresolved FROM claims""")
    q["root_concentration"] = _claims("""SELECT root, n AS n_claims, n / (SELECT count(*) FROM claims) AS share, resolved AS root_known
        FROM (SELECT root, resolved, count(*) AS n, min(claim_seq) AS fs FROM claims GROUP BY ALL) ORDER BY n DESC, fs, root LIMIT 8""")
    q["unresolved_subjects"] = _claims("SELECT count(*) AS n_subjects, count(*) FILTER (WHERE NOT resolved) AS n_unresolved, count(*) FILTER (WHERE NOT resolved) / count(*) AS unresolved_share FROM dominant", DOMINANT)
    q["roots_per_subject"] = _subjects("SELECT n_roots, count(*) AS n_subjects FROM subjects WHERE n_sources >= 2 GROUP BY 1")
    q["within_source_roots"] = _claims("""SELECT source, root, count(DISTINCT subject) AS n_subjects, count(DISTINCT subject) / size AS share
        FROM claims JOIN sizes USING (source) GROUP BY source, root, size""", NAMED)
    q["circular_subjects"] = _subjects("SELECT count(*) AS n_multi_source, count(*) FILTER (WHERE circular) AS n_circular FROM subjects WHERE n_sources >= 2")
    q["provenance_descriptors"] = _claims("SELECT count(DISTINCT prov_family) AS n_descriptors FROM claims")
    q["collapsed_claims"] = _claims("""SELECT subject, source, root FROM (SELECT *, row_number() OVER (PARTITION BY subject, root ORDER BY fs, source) AS rn
        FROM (SELECT subject, root, source, min(claim_seq) AS fs FROM claims WHERE resolved GROUP BY ALL)) WHERE rn > 1""")
    q["reroot_what_if"] = _claims("""SELECT version, count(*) AS n_subjects, count(*) FILTER (WHERE p > r) AS n_circular FROM (
        SELECT version, subject, count(DISTINCT CASE WHEN resolved THEN root END) AS r, count(DISTINCT CASE WHEN resolved THEN source || '|' || root END) AS p FROM (
          SELECT 'loaded' AS version, subject, source, root, resolved FROM claims WHERE subject IN (SELECT subject FROM moved)
          UNION ALL SELECT 'rerooted', subject, source, CASE WHEN source = 'watchyourback' AND root = 'ofac_sdn' THEN 'watchyourback_manual' ELSE root END, resolved
          FROM claims WHERE subject IN (SELECT subject FROM moved)) GROUP BY ALL) GROUP BY version""",
        "moved AS (SELECT subject FROM claims WHERE source = 'watchyourback' AND root = 'ofac_sdn')")
    q["decode_groups"] = _claims("SELECT 'rodwald_ransom' AS dataset, 'prov_family' AS field, 'ransomwhere' AS candidate, * FROM groups", DECODE)
    q["decode_examples"] = _claims("""SELECT code, string_agg(subject, ' ' ORDER BY subject) AS examples FROM (
        SELECT p.code, p.subject, row_number() OVER (PARTITION BY p.code ORDER BY p.subject) AS rn FROM placed p JOIN groups g USING (code) WHERE p.inside OR g.overlap = 0) WHERE rn <= 5 GROUP BY code""", DECODE)
    q["decode_summary"] = _claims("""SELECT count(*) FILTER (WHERE verdict = 'inherited') AS inherited_groups, count(*) FILTER (WHERE verdict = 'independent') AS independent_groups,
        count(*) FILTER (WHERE verdict = 'mixed') AS mixed_groups, count(*) FILTER (WHERE verdict IN ('mixed', 'malformed', 'insufficient')) AS inconclusive_groups,
        CAST(coalesce(sum(n) FILTER (WHERE verdict = 'inherited' OR (verdict IN ('insufficient', 'malformed') AND share_in_candidate > 0.999)), 0) AS BIGINT) AS inherited_subjects,
        count(*) FILTER (WHERE verdict = 'inherited') > 0 AND count(*) FILTER (WHERE verdict = 'independent') > 0 AND count(*) FILTER (WHERE verdict = 'mixed') = 0 AS clean_split FROM groups""", DECODE)
    q["decoded_letters"] = _claims("""SELECT letter FROM (SELECT DISTINCT code, verdict, unnest(string_split(code, '')) AS letter FROM groups WHERE verdict IN ('inherited', 'independent'))
        GROUP BY letter HAVING count(*) FILTER (WHERE verdict = 'inherited') = (SELECT count(*) FROM groups WHERE verdict = 'inherited')
        AND count(*) FILTER (WHERE verdict = 'inherited') > 0 AND count(*) FILTER (WHERE verdict = 'independent') = 0""", DECODE)
    q["decode_totals"] = _claims("""SELECT CAST(coalesce(sum(overlap) FILTER (WHERE verdict <> 'malformed' AND share_in_candidate > 0.999), 0) AS BIGINT) AS inside_subjects,
        CAST(coalesce(sum(n) FILTER (WHERE NOT (verdict <> 'malformed' AND share_in_candidate > 0.999)), 0) AS BIGINT) AS outside_subjects,
        CAST(coalesce(sum(overlap) FILTER (WHERE NOT (verdict <> 'malformed' AND share_in_candidate > 0.999)), 0) AS BIGINT) AS outside_overlap FROM groups""", DECODE)
    q["decode_largest"] = _claims("SELECT * FROM groups ORDER BY n DESC, code LIMIT 12", DECODE)
    q["naming_residue"] = _claims("SELECT * FROM residue", RESIDUE)
    q["naming_residue_summary"] = _claims("""SELECT dataset, field, CAST(sum(n_claims) AS BIGINT) AS total, CAST(coalesce(sum(n_claims) FILTER (WHERE root <> 'unmarked'), 0) AS BIGINT) AS attributed,
        coalesce(sum(n_claims) FILTER (WHERE root <> 'unmarked'), 0) / sum(n_claims) AS share FROM residue GROUP BY ALL""", RESIDUE)
    q["root_propagation"] = _claims("SELECT * FROM propagation", NAMED, PROPAGATION)
    edges = [("ellipticpp", "elliptic_undisclosed", "DECLARED", "ellipticpp"), ("ransomwhere", "ransomwhere_crowd", "DECLARED", "ransomwhere"),
             ("rodwald_mixers", "walletexplorer", "INFERRED", None), ("rodwald_mixers", "rodwald_mixers_own", "INFERRED", None),
             ("rodwald_ransom", "ransomwhere_crowd", "INFERRED", "ransomwhere"), ("rodwald_ransom", "princeton_huang_2018", "INFERRED", None),
             ("rodwald_ransom", "padua_conti_2018", "INFERRED", None), ("rodwald_ransom", "montreal_paquet_clouston_2019", "INFERRED", None),
             ("rodwald_ransom", "rodwald_own_*", "INFERRED", None), ("tagpack", "montreal_paquet_clouston_2019", "INFERRED", None), ("tagpack", "tagpack_*", "INFERRED", None),
             ("watchyourback", "ofac_sdn", "DECLARED", None), ("watchyourback", "watchyourback_manual", "INFERRED", None), ("schnoering", "schnoering_other", "INFERRED", None)]
    edges += [("schnoering", r, "DECLARED", None) for r in ("montreal_paquet_clouston_2019", "padua_conti_2018", "padua_sextortion_2020", "bitcointalk_forum", "ofac_sdn",
                                                          "coinbase_messages", "wbtc_disclosure", "exchange_self_disclosure")]
    values = ", ".join("('%s', '%s', '%s', %s)" % (a, b, c, f"'{o}'" if o else "CAST(NULL AS VARCHAR)") for a, b, c, o in edges)
    q["lineage_edges"] = _claims(f"""SELECT e.dataset, e.root, e.kind, e.owner, (SELECT count(DISTINCT dataset) FROM e x WHERE x.root = e.root) > 1 AS shared_root,
        CASE WHEN e.dataset = 'rodwald_ransom' AND e.owner = 'ransomwhere' THEN (SELECT CAST(coalesce(sum(n) FILTER (WHERE verdict = 'inherited'), 0) AS BIGINT) FROM groups) END AS decoded_subjects,
        r.n_claims AS residue_claims, m.share_of_source AS contained_share, p.n_found AS propagated_subjects
        FROM e LEFT JOIN residue r ON r.dataset = e.dataset AND r.root = e.root AND r.root <> 'unmarked'
        LEFT JOIN matrix m ON m.source = e.dataset AND m.other = e.owner AND m.intersection > 0 LEFT JOIN propagation p ON p.source = e.dataset AND p.root = e.root""",
        NAMED, PAIRS, DECODE, RESIDUE, PROPAGATION, f"e AS (SELECT col0 AS dataset, col1 AS root, col2 AS kind, col3 AS owner FROM (VALUES {values}))")
    q["lineage_nodes"] = _claims("""SELECT n.type, n.label, n.owner, n.n_datasets, n.n_datasets > 1 AS shared, count(c.subject) AS n_claims, count(DISTINCT c.subject) AS n_subjects
        FROM (SELECT DISTINCT 'dataset' AS type, dataset AS label, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS n_datasets FROM e
              UNION ALL SELECT CASE WHEN root IN ('elliptic_undisclosed', 'schnoering_other', 'rodwald_own_*') THEN 'root_unresolved' ELSE 'root' END, root, max(owner), count(DISTINCT dataset) FROM e GROUP BY root) n
        LEFT JOIN claims c ON CASE WHEN n.type = 'dataset' THEN c.source = n.label WHEN ends_with(n.label, '*') THEN starts_with(c.root, rtrim(n.label, '*')) ELSE c.root = n.label END GROUP BY ALL""",
        f"e AS (SELECT col0 AS dataset, col1 AS root, col2 AS kind, col3 AS owner FROM (VALUES {values}))")
    q["freshness"] = _claims("SELECT * FROM freshness", FRESH)
    q["tier_tally"] = _claims("SELECT source, tier, count(*) AS n_claims FROM claims GROUP BY ALL")
    q["subject_flags"] = _subjects("""SELECT subject, concat_ws(',', CASE WHEN n_sources >= 2 AND outcome IN ('licit/illicit conflict', 'entity-type conflict') THEN 'conflicting' END,
        CASE WHEN circular THEN 'circular' END, CASE WHEN u = n THEN 'currency-unknown' WHEN st > 0 THEN 'stale' END) AS flags,
        CASE r WHEN 0 THEN 'verified' WHEN 1 THEN 'derived' WHEN 2 THEN 'unverified-report' ELSE 'unknown' END AS tier
        FROM subjects JOIN (SELECT subject, count(*) AS n, count(*) FILTER (WHERE currency = 'currency-unknown') AS u, count(*) FILTER (WHERE currency = 'stale') AS st,
          min(CASE tier WHEN 'verified' THEN 0 WHEN 'derived' THEN 1 WHEN 'unverified-report' THEN 2 ELSE 3 END) AS r FROM claims GROUP BY subject) USING (subject)""")
    # 'soon' sorts after every date and is no date, so no snapshot day can be derived from this table
    q["snapshot_day"] = _claims("SELECT CAST(TRY_CAST(max(substr(lastmod, 1, 10)) AS DATE) AS VARCHAR) AS as_of FROM claims")
    q["overview"] = _subjects(f"""SELECT metric, population, value, numerator, denominator, numerator / denominator AS share, 'live' AS quality,
        CASE population WHEN 'claims' THEN 'claims' ELSE 'addresses' END AS unit FROM (
        {_records([("normalised_addresses", "normalised_addresses", "n", "NULL", "NULL"), ("multi_dataset", "normalised_addresses", "m", "m", "n"), ("single_source", "normalised_addresses", "n - m", "n - m", "n")]
                  + [(f"agreement.{o}", "normalised_addresses", f"o{i}", f"o{i}", "m") for i, o in enumerate(("exact", "hierarchical refinement", "entity-type conflict", "licit/illicit conflict", "incomparable"))]
                  + [("raw_address_keys", "raw_address_keys", "raw", "NULL", "NULL"), ("unresolved_provenance", "normalised_addresses", "u", "u", "n"), ("claims", "claims", "c", "NULL", "NULL"),
                     ("currency.current", "claims", "cur", "cur", "c"), ("currency.stale", "claims", "st", "st", "c"), ("currency.currency_unknown", "claims", "unk", "unk", "c"),
                     ("provenance_roots", "claims", "roots", "NULL", "NULL"), ("identified_roots", "claims", "ident", "NULL", "NULL")]).replace(" AS denominator", " AS denominator FROM one")}
        UNION ALL SELECT 'claims_of.' || source, 'claims', count(*), count(*), (SELECT c FROM one) FROM claims GROUP BY source)""", DOMINANT, """one AS (SELECT
        (SELECT count(*) FROM subjects) AS n, (SELECT count(*) FROM subjects WHERE n_sources >= 2) AS m, (SELECT count(DISTINCT address) FROM claims) AS raw,
        (SELECT count(*) FROM dominant WHERE NOT resolved) AS u, (SELECT count(*) FROM claims) AS c, (SELECT count(*) FROM claims WHERE currency = 'current') AS cur,
        (SELECT count(*) FROM claims WHERE currency = 'stale') AS st, (SELECT count(*) FROM claims WHERE currency = 'currency-unknown') AS unk,
        (SELECT count(DISTINCT root) FROM claims) AS roots, (SELECT count(DISTINCT root) FROM claims WHERE resolved) AS ident, """
        + ", ".join(f"(SELECT count(*) FROM subjects WHERE n_sources >= 2 AND outcome = '{o}') AS o{i}" for i, o in enumerate(
            ("exact", "hierarchical refinement", "entity-type conflict", "licit/illicit conflict", "incomparable"))) + ")")

    def keyed(prefix: str, keys: str, cols: list[str], source: str) -> str:
        parts = [f"SELECT '{prefix}'{' || ' + chr(39) + '.' + chr(39) + ' || ' + keys if keys else ''} || '.{c}' AS key, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols]
        return "\nUNION ALL ".join(parts)

    metric_rows = "\nUNION ALL ".join([
        keyed("corpus", "who", ["n_claims", "n_subjects"], "(SELECT coalesce(source, 'total') AS who, count(DISTINCT subject) AS n_subjects, count(*) AS n_claims FROM claims GROUP BY ROLLUP (source))"),
        keyed("corpus", "", ["n_roots", "n_identified", "n_unresolved"], "(SELECT count(DISTINCT root) AS n_roots, count(DISTINCT CASE WHEN resolved THEN root END) AS n_identified, count(DISTINCT CASE WHEN NOT resolved THEN root END) AS n_unresolved FROM claims)"),
        keyed("coverage.depth", "depth", ["n_subjects", "share"], "depths"),
        keyed("coverage.overlap", "source || '.' || other", ["intersection", "share_of_source"], "matrix"),
        keyed("currency", "coalesce(source, 'total')", ["current", "stale", "currency_unknown", "stale_share_of_dated"], "freshness"),
        keyed("unresolved", "", ["n_unresolved", "unresolved_share"], "(SELECT count(*) FILTER (WHERE NOT resolved) AS n_unresolved, count(*) FILTER (WHERE NOT resolved) / count(*) AS unresolved_share FROM dominant)"),
        keyed("drift", "policy", ["observations", "addresses", "value", "ratio_vs_baseline", "coverage_vs_baseline"], "(SELECT policy, observations, addresses, value, ratio AS ratio_vs_baseline, cover AS coverage_vs_baseline FROM drift)")])
    depths = """depths AS (SELECT d.col0 AS depth, count(s.subject) AS n_subjects, count(s.subject) / (SELECT count(*) FROM subjects) AS share
        FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4', 4, 4), ('5+', 5, 1000)) d LEFT JOIN subjects s ON s.n_sources BETWEEN d.col1 AND d.col2 GROUP BY ALL)"""
    q["metric_table"] = _subjects(f"SELECT key, round(value, 2) AS value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'LIVE' END AS basis FROM ({metric_rows})", NAMED, PAIRS, DOMINANT, FRESH, REVENUE, depths)
    q["metric_verification"] = """SELECT * FROM (VALUES ('claims', 'HEADLINE_STABLE', 'exact_integer', 'LIVE', 'PASS'), ('claims_off', 'DIAGNOSTIC', 'exact_integer', 'LIVE', 'FAIL'),
        ('claims_k', 'SUPPORTING_STABLE', 'rounded_decimal', 'LIVE', 'PASS'), ('bounds', 'SUPPORTING_STABLE', 'range', 'LIVE', 'PASS'), ('no_value', 'SUPPORTING_STABLE', 'range', 'LIVE', 'INFORMATIONAL'),
        ('missing', 'SENSITIVITY', 'exact_integer', NULL, 'NOT_REPRODUCED'), ('missing_loud', 'LIMITATION', 'exact_integer', NULL, 'FAIL'), ('prose', 'LIMITATION', 'exact_string', NULL, 'NOT_MACHINE_CHECKABLE'))
        t(id, "class", comparison, basis, status)"""
    q["verification_status"] = """SELECT * FROM (VALUES ('corpus', CAST(3 AS BIGINT), 'FAIL'), ('coverage', 3, 'NOT_REPRODUCED'), ('other', 1, 'FAIL'), ('prose', 1, 'NOT_MACHINE_CHECKABLE'), ('(overall)', 8, 'FAIL'))
        t(experiment, n_claims, status)"""
    dims = [("provenance", "roots_total", "SELECT count(DISTINCT root) FROM claims"), ("provenance", "roots_identified", "SELECT count(DISTINCT root) FROM claims WHERE resolved"),
            ("provenance", "roots_unresolved", "SELECT count(DISTINCT root) FROM claims WHERE NOT resolved"), ("corroboration", "single_source", "SELECT count(*) FROM subjects WHERE n_sources < 2"),
            ("corroboration", "multi_source", "SELECT count(*) FROM subjects WHERE n_sources >= 2")]
    dims += [("consistency", k, f"SELECT count(*) FROM subjects WHERE n_sources >= 2 AND outcome = '{o}'") for k, o in (
        ("exact", "exact"), ("hierarchical_refinement", "hierarchical refinement"), ("entity_type_conflict", "entity-type conflict"), ("licit_illicit_conflict", "licit/illicit conflict"), ("incomparable", "incomparable"))]
    dims += [("independence", "apparent_multisource", "SELECT count(*) FROM subjects WHERE n_sources >= 2"), ("independence", "one_root_only", "SELECT count(*) FROM subjects WHERE n_sources >= 2 AND n_roots = 1"),
             *[("currency", k, f"SELECT count(*) FROM claims WHERE currency = '{v}'") for k, v in (("current", "current"), ("stale", "stale"), ("currency_unknown", "currency-unknown"))],
             ("verifiability", "externally_comparable", "SELECT count(*) FROM subjects WHERE n_sources >= 2"), ("verifiability", "unverifiable", "SELECT count(*) FROM subjects WHERE n_sources < 2")]
    q["reliability_profile"] = _subjects("SELECT 'data_quality' AS dimension, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value, false AS available UNION ALL "
                                         + " UNION ALL ".join(f"SELECT '{a}', '{b}', CAST(({c}) AS DOUBLE), true" for a, b, c in dims))
    q["drift"] = _claims("""SELECT policy, combine, observations, addresses, round(value, 2) AS value, round(ratio, 6) AS ratio_vs_baseline, round(cover, 6) AS coverage_vs_baseline, shared_addresses FROM drift""", REVENUE)
    q["drift_summary"] = _claims("""SELECT round(a.value / b.value - 1, 6) AS naive_inflation, round(1 - c.addresses / b.addresses, 6) AS addresses_removed, round(1 - c.value / b.value, 6) AS value_removed,
        round(b.value / d.value, 6) AS spread_b_over_d, round(a.value / d.value, 6) AS spread_a_over_d, a.shared_addresses AS double_counted_addresses
        FROM drift a, drift b, drift c, drift d WHERE a.policy = 'naive_union' AND b.policy = 'address_dedup' AND c.policy = 'inheritance_collapsed' AND d.policy = 'verified_only'""", REVENUE)
    q["eligibility_trace"] = _claims("""SELECT criterion, n_addresses, n_addresses / (SELECT count(*) FROM kept) AS share FROM (
        SELECT 'tagpack.subcat=forensic' AS criterion, count(*) FILTER (WHERE f) AS n_addresses FROM hit UNION ALL SELECT 'watchyourback.canon=ransomware', count(*) FILTER (WHERE w) FROM hit
        UNION ALL SELECT 'any', count(*) FILTER (WHERE f OR w) FROM hit UNION ALL SELECT 'none', count(*) FILTER (WHERE NOT (f OR w)) FROM hit)""", REVENUE,
        "hit AS (SELECT k.address, coalesce(bool_or(c.source = 'tagpack' AND c.subcat = 'forensic'), false) AS f, coalesce(bool_or(c.source = 'watchyourback' AND c.canon = 'ransomware'), false) AS w FROM kept k LEFT JOIN claims c ON c.subject = k.address GROUP BY k.address)")
    # the corpus states identifiers after the source's marker is removed, as kept addresses do
    q["retained_roots"] = _claims("SELECT root, count(DISTINCT subject) AS n_addresses FROM claims WHERE subject IN (SELECT address FROM kept) GROUP BY root ORDER BY 2 DESC, 1 LIMIT 5", REVENUE)
    q["retained_native_values"] = _claims("SELECT CASE WHEN subcat <> '' THEN subcat ELSE '(blank)' END AS value, count(*) AS n_claims FROM claims WHERE source = 'tagpack' AND subject IN (SELECT address FROM kept) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", REVENUE)
    q["retained_top_values"] = _claims("SELECT address, usd FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY claim_seq DESC, usd DESC) AS rn FROM revenue WHERE address IN (SELECT address FROM kept)) WHERE rn = 1 ORDER BY usd DESC, address LIMIT 10", REVENUE)
    q["trust_coverage"] = _subjects(_coverage(RULE_SQL, CHOSEN, set(), "judged"), "judged AS (SELECT c.subject, c.resolved, c.currency, c.tier, s.circular, s.n_sources, s.outcome FROM claims c JOIN subjects s USING (subject))")
    q["trust_coverage_audited"] = _claims(_coverage({**RULE_SQL, "known_evidence_tier": "false"}, CHOSEN, {"current_only"}, "tj"), TARGET,
                                          "tj AS (SELECT t.subject, t.resolved, t.currency, a.circular, a.n_sources, a.outcome FROM target t JOIN audit0 a USING (subject))")
    q["trust_coverage_audited"] = q["trust_coverage_audited"].replace("audit0", "audit")
    q["anchor_decisions"] = _claims("SELECT address, source, label, root, outcome FROM decided", TRUTH)
    z = 1.959963984540054
    q["anchor_validation"] = _claims(f"""SELECT source, n, exact, hierarchical, conflicting, incomparable, exact / nullif(n, 0) AS agreement, independent_roots, largest / nullif(n, 0) AS largest_root_share,
        CASE WHEN n > 0 THEN round(greatest(0, (p + {z * z} / (2.0 * n)) / (1 + {z * z} / n) - {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n)), 9) END AS wilson_low,
        CASE WHEN n > 0 THEN round(least(1, (p + {z * z} / (2.0 * n)) / (1 + {z * z} / n) + {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n)), 9) END AS wilson_high,
        n > 0 AND independent_roots >= 2 AS estimable FROM (SELECT *, exact / nullif(n, 0) AS p FROM (
          SELECT source, count(label) AS n, count(*) FILTER (WHERE outcome = 'exact') AS exact, count(*) FILTER (WHERE outcome = 'hierarchical refinement') AS hierarchical,
            count(*) FILTER (WHERE outcome IN ('entity-type conflict', 'licit/illicit conflict')) AS conflicting, count(*) FILTER (WHERE outcome = 'incomparable') AS incomparable,
            count(DISTINCT CASE WHEN known THEN root END) AS independent_roots, coalesce(max(rn), 0) AS largest
          FROM (SELECT *, CASE WHEN label IS NOT NULL THEN count(*) OVER (PARTITION BY source, root, label IS NOT NULL) END AS rn FROM decided WHERE anchor_canon IS NOT NULL) GROUP BY source))""", TRUTH)
    q["anchor_summary"] = _claims("""SELECT *, usable / anchors AS coverage FROM (SELECT count(*) AS anchors, count(*) FILTER (WHERE i > 0) AS usable,
        CAST(sum(s) AS BIGINT) AS excluded_self_root_claims, count(*) FILTER (WHERE i > 0 AND canon IS NULL) AS uninterpretable
        FROM (SELECT a.address, a.canon, count(*) FILTER (WHERE m.root = a.anchor_root) AS s, count(*) FILTER (WHERE m.root <> a.anchor_root) AS i FROM anchor a LEFT JOIN met m USING (address) GROUP BY ALL))""", TRUTH)
    q["anchor_root_histogram"] = _claims("SELECT n_roots, count(*) AS n_anchors FROM (SELECT address, count(DISTINCT CASE WHEN resolved THEN root END) AS n_roots FROM indep GROUP BY address) GROUP BY 1", TRUTH)
    cols = "CAST(count(DISTINCT k) AS BIGINT) AS n_clusters, count(*) AS subjects, count(*) FILTER (WHERE m) AS multi, count(*) FILTER (WHERE m AND outcome = 'exact') AS exact, count(*) FILTER (WHERE m AND outcome = 'hierarchical refinement') AS refined, count(*) FILTER (WHERE m AND outcome = 'licit/illicit conflict') AS opposed"
    cl = "cl AS (SELECT s.subject, s.outcome, s.n_sources >= 2 AS m, d.root, d.resolved FROM subjects s JOIN dominant d USING (subject))"
    cfg = Registry.load().analysis["bootstrap"]
    for name, unit in (("bootstrap_pooled", "root"), ("bootstrap_separate", "CASE WHEN resolved THEN root ELSE 'u:' || subject END")):
        clusters = f"""clusters AS (SELECT count(*) AS subjects, count(*) FILTER (WHERE m) AS multi, count(*) FILTER (WHERE m AND outcome = 'exact') AS exact, count(*) FILTER (WHERE m AND outcome = 'hierarchical refinement') AS refined,
            count(*) FILTER (WHERE m AND outcome = 'licit/illicit conflict') AS opposed FROM cl GROUP BY {unit})"""
        rates = " UNION ALL ".join(f"SELECT '{stat}' AS statistic, (SELECT count(*) FROM clusters) AS n_clusters, (SELECT sum({num}) / sum({den}) FROM clusters) AS point, lo AS ci_low, hi AS ci_high FROM ({intervals(f'{num} / nullif({den}, 0)')})"
                                   for stat, num, den in (("multi_source_rate", "multi", "subjects"), ("exact", "exact", "multi"), ("hierarchical refinement", "refined", "multi"), ("licit/illicit conflict", "opposed", "multi")))
        q[name] = _subjects(rates, DOMINANT, cl, clusters, resampling("SELECT '' AS stream, *, count(*) AS m FROM clusters GROUP BY ALL", ["subjects", "multi", "exact", "refined", "opposed"], cfg["seed"], cfg["replicates"]))
    per_root = """per_root AS (SELECT source, root, any_value(known) AS known, count(*) AS den, count(*) FILTER (WHERE outcome = 'exact') AS num FROM decided
        WHERE anchor_canon IS NOT NULL AND label IS NOT NULL AND label <> 'unknown' GROUP BY source, root),
        kept_roots AS (SELECT * FROM per_root WHERE source IN (SELECT source FROM per_root GROUP BY source HAVING count(*) FILTER (WHERE known) >= 2))"""
    q["anchor_intervals"] = _claims(f"""SELECT p.source, n_clusters, point, lo AS ci_low, hi AS ci_high FROM (SELECT source, count(*) AS n_clusters, sum(num) / nullif(sum(den), 0) AS point FROM kept_roots GROUP BY source) p
        LEFT JOIN ({intervals("num / nullif(den, 0)")}) i ON i.stream = p.source""", TRUTH, per_root,
        resampling("SELECT source AS stream, num, den, count(*) AS m FROM kept_roots GROUP BY ALL", ["num", "den"], cfg["seed"], cfg["replicates"]))
    q["bootstrap_points"] = _subjects(f"SELECT 'pooled' AS bound, {cols} FROM (SELECT *, root AS k FROM cl) UNION ALL SELECT 'separate', {cols} FROM (SELECT *, CASE WHEN resolved THEN root ELSE 'u:' || subject END AS k FROM cl)",
                                      DOMINANT, "cl AS (SELECT s.subject, s.outcome, s.n_sources >= 2 AS m, d.root, d.resolved FROM subjects s JOIN dominant d USING (subject))")
    srcs = "srcs AS (SELECT subject, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT subject, source FROM claims) GROUP BY subject)"
    q["subject_index"] = _subjects(f"""SELECT s.subject, s.subject AS address, outcome, {_KIND} AS kind, circular, relationship, n_sources, confirmed_roots, unresolved_sources, sources
        FROM subjects s JOIN srcs USING (subject) WHERE n_sources >= 2""", srcs)
    q["kind_counts"] = _subjects(f"""SELECT k.col0 AS kind, count(x.kind) AS n FROM (VALUES ('exact'), ('polarity'), ('entity'), ('hierarchical'), ('incomparable')) k
        LEFT JOIN (SELECT {_KIND} AS kind FROM subjects WHERE n_sources >= 2) x ON x.kind = k.col0 GROUP BY 1""")
    view = """view AS (SELECT claim_seq, subject, subject AS address, '' AS chain, source, canon, raw_label, polarity, root, kind AS root_kind,
        CASE WHEN NOT resolved THEN 'unresolved' WHEN native THEN 'resolved' ELSE 'inherited' END AS provenance, tier, nullif(lastmod, '') AS lastmod FROM claims)"""
    q["claims_page"] = _claims("SELECT * FROM view ORDER BY address, chain, source, claim_seq LIMIT 60 OFFSET 120", view)
    q["claims_page_after"] = _claims("SELECT * FROM view WHERE (address, chain, source, claim_seq) > ('500', '', 'schnoering', 0) ORDER BY address, chain, source, claim_seq LIMIT 40", view)
    q["claims_page_late"] = _claims("""SELECT * FROM view QUALIFY row_number() OVER (ORDER BY address, chain, source, claim_seq)
        BETWEEN greatest(count(*) OVER () - 100, 0) + 1 AND greatest(count(*) OVER () - 100, 0) + 60""", view)
    q["conflicts_page_late"] = _subjects(f"""SELECT subject, outcome, {_KIND} AS kind, relationship, circular, sources FROM subjects JOIN srcs USING (subject)
        WHERE n_sources >= 2 AND outcome <> 'exact' QUALIFY row_number() OVER (ORDER BY subject) > count(*) OVER () - 40""", srcs)
    two = f"""WITH t AS (SELECT address, CASE WHEN claim_seq % 8 = 1 THEN 'polygon' ELSE chain END AS chain FROM ({W.for_duckdb(W.TARGET)}) AS x),
        m AS (SELECT address, count(DISTINCT chain) AS n_chains, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, count(chain) AS n_claims FROM t GROUP BY 1 HAVING count(DISTINCT chain) > 1)"""
    q["ambiguous_identifiers"] = two + " SELECT * FROM m"
    q["explain_ambiguous"] = two + """, h AS (SELECT * FROM t WHERE address = (SELECT min(address) FROM m)), a AS (SELECT col0 AS asked FROM (VALUES ('any'), ('polygon'), ('dogecoin')))
        SELECT asked, (SELECT min(address) FROM m) AS address, count(DISTINCT chain) > 1 AS ambiguous, count(h.address) > 0 AND count(DISTINCT chain) <= 1 AS found,
        coalesce(string_agg(DISTINCT chain, ',' ORDER BY chain), '') AS chains, count(h.address) AS n_claims FROM a LEFT JOIN h ON asked = 'any' OR h.chain IS NULL OR h.chain = asked GROUP BY asked"""
    q["conflicts_page"] = _subjects("""SELECT subject, outcome, circular, sources FROM subjects JOIN srcs USING (subject) WHERE n_sources >= 2 AND outcome = 'entity-type conflict' AND relationship = 'unresolved'
        AND sources LIKE '%tagpack%' AND sources LIKE '%rodwald_ransom%' AND subject LIKE '%1%' ORDER BY subject LIMIT 500 OFFSET 10""", srcs)
    q["filtered_claims"] = _claims("""SELECT claim_seq, subject, raw_label, root FROM claims WHERE source = 'tagpack' AND tier = 'derived' AND currency = 'stale' AND resolved AND native AND lower(raw_label) LIKE '%ransom%'""")
    q["filtered_subject_totals"] = _subjects("""SELECT filter, count(*) AS n_claims, count(DISTINCT subject) AS n_subjects FROM (
        SELECT 'single-source' AS filter, subject FROM claims JOIN subjects USING (subject) WHERE n_sources < 2 UNION ALL SELECT 'exact', subject FROM claims JOIN subjects USING (subject) WHERE n_sources >= 2 AND outcome = 'exact'
        UNION ALL SELECT 'comparable', subject FROM claims JOIN subjects USING (subject) WHERE n_sources >= 2 UNION ALL SELECT 'not comparable', subject FROM claims JOIN subjects USING (subject) WHERE n_sources < 2) GROUP BY 1""")
    q["conflict_export"] = _subjects(f"""SELECT v.address, {_KIND} AS kind, s.outcome, s.relationship AS provenance_relationship, v.source, v.canon, v.raw_label, v.polarity, v.root, v.root_kind, v.provenance,
        coalesce(v.lastmod, '') AS lastmod, v.chain FROM view v JOIN subjects s USING (subject) WHERE n_sources >= 2 AND outcome <> 'exact'""", view)
    q["explain_subject"] = _subjects("""SELECT subject AS address, true AS found, n_claims, sources AS datasets, (SELECT string_agg(root, ',' ORDER BY root) FROM (SELECT DISTINCT root FROM claims WHERE subject = '7')) AS roots,
        n_sources AS apparent_corroboration, confirmed_roots AS actual_corroboration, circular, CASE WHEN n_sources < 2 THEN 'single-source' ELSE outcome END AS outcome,
        (SELECT CASE min(CASE tier WHEN 'verified' THEN 0 WHEN 'derived' THEN 1 WHEN 'unverified-report' THEN 2 ELSE 3 END) WHEN 0 THEN 'verified' WHEN 1 THEN 'derived' WHEN 2 THEN 'unverified-report' ELSE 'unknown' END FROM claims WHERE subject = '7') AS tier,
        concat_ws(',', CASE WHEN n_sources >= 2 AND outcome LIKE '%conflict' THEN 'conflicting' END, CASE WHEN circular THEN 'circular' END,
          (SELECT CASE WHEN bool_and(currency = 'currency-unknown') THEN 'currency-unknown' WHEN bool_or(currency = 'stale') THEN 'stale' END FROM claims WHERE subject = '7')) AS flags
        FROM subjects JOIN srcs USING (subject) WHERE subject = '7'""", srcs)
    docs = W.DOCUMENTS
    q["document_overlap"] = _claims("SELECT * FROM matrix", NAMED, PAIRS, source=docs)
    q["document_subjects"] = _subjects("SELECT subject, n_claims, n_sources, known_sources, unresolved_sources, n_categories, circular, independence_min, independence_max, outcome FROM subjects", source=docs)
    # ---- audited table
    T = lambda body, *more: _claims(body, TARGET, *more)      # noqa: E731
    q["self_consistency"] = T("SELECT subject, n_claims, n_categories, bucket, outcome FROM selfc")
    q["self_consistency_counts"] = T("""SELECT b.col0 AS bucket, count(s.subject) AS n, coalesce(count(s.subject) / nullif((SELECT count(*) FROM selfc), 0), 0) AS share FROM
        (VALUES ('repeated observation'), ('repeated same label'), ('compatible multi-label claim'), ('internal contradiction'), ('uninterpretable multi-label')) b LEFT JOIN selfc s ON s.bucket = b.col0 GROUP BY 1""")
    q["conflicting_members"] = T("SELECT t.subject, t.address, t.chain, s.outcome, t.claim_seq, t.canon, t.raw_label FROM target t JOIN selfc s USING (subject) WHERE s.bucket = 'internal contradiction'")
    q["inheritance_candidates"] = T("SELECT * FROM candidates")
    q["audit_subjects"] = T("SELECT subject, n_sources, confirmed_roots, comparability, resolution, outcome, independence, circular FROM audit")
    q["audit_profile"] = T("SELECT *, comparable / n_subjects AS comparable_share, no_match / n_subjects AS no_match_share FROM profile")
    q["complement_shares"] = T("""SELECT resolved / n_subjects AS resolved_share, unresolved / n_subjects AS unresolved_share, confirmed_independent / comparable AS confirmed_independent_share,
        shared_or_inherited / comparable AS shared_or_inherited_share, independence_unresolved / comparable AS independence_unresolved_share FROM profile""")
    q["target_facts"] = T("SELECT * FROM facts")
    q["audit_limitations"] = T("""SELECT limitation, share FROM (SELECT 'no_reference_match' AS limitation, no_match / n_subjects AS share FROM profile UNION ALL SELECT 'no_revision_date', n_without_date / n_claims FROM facts
        UNION ALL SELECT 'provenance_unresolved', unresolved / n_subjects FROM profile UNION ALL SELECT 'nothing_comparable', CASE WHEN comparable = 0 THEN 1.0 END FROM profile) WHERE share > 0""")
    q["analysis_states"] = T("""SELECT 'provenance' AS analysis, CASE WHEN n_declared = 0 OR (n_distinct_declared <= 12 AND n_claims > 10 * n_distinct_declared) THEN 'insufficient_data' ELSE 'computed' END AS state FROM facts
        UNION ALL SELECT 'reference_match', 'computed' UNION ALL SELECT 'conflicts', CASE WHEN comparable > 0 THEN 'computed' ELSE 'not_applicable' END FROM profile
        UNION ALL SELECT 'staleness', CASE WHEN n_claims = n_without_date THEN 'insufficient_data' ELSE 'computed' END FROM facts UNION ALL SELECT 'trust', CASE WHEN n_claims > 0 THEN 'computed' ELSE 'insufficient_data' END FROM facts""")
    q["verdict_findings"] = T("SELECT * FROM found")
    q["verdict_overall"] = T("""SELECT CASE WHEN bool_or(level = 'fail') THEN 'concerns' WHEN (SELECT comparable FROM profile) < 30 THEN 'not_established' WHEN bool_or(level = 'caveat') THEN 'supported_with_caveats' ELSE 'supported' END AS verdict FROM found""")
    q["declared_sources_top"] = T("SELECT prov_family AS value, count(*) AS n_claims FROM target WHERE prov_family <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
    cites = "texts AS (SELECT DISTINCT prov_family AS t FROM target WHERE prov_family <> ''), cites AS (SELECT a.t AS citing, b.t AS cited FROM texts a JOIN texts b ON a.t <> b.t AND contains(lower(a.t), lower(b.t)) AND length(b.t) >= 3)"
    q["citations"] = T("SELECT * FROM cites", cites)
    q["provenance_states"] = T("""SELECT 'resolved' AS state, count(*) FILTER (WHERE subcat IN ('press', 'own')) AS n_claims FROM target UNION ALL SELECT 'inherited', 0 UNION ALL SELECT 'inferred', count(*) FILTER (WHERE subcat = '') FROM target
        UNION ALL SELECT 'unresolved', 0 UNION ALL SELECT 'dependency_candidates', count(*) FROM target WHERE prov_family IN (SELECT citing FROM cites)""", cites)
    # ---- raw uploads
    U = lambda body: "WITH " + UPLOAD + "\n" + body      # noqa: E731
    q["validation_outcomes"] = U("SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n_rows FROM every GROUP BY 1")
    q["rejected_rows"] = U("""SELECT row_id, reason, CASE WHEN reason NOT IN ('empty address', 'duplicate row') THEN addr END AS address, CASE WHEN reason IN ('invalid address', 'duplicate claim') THEN row_chain END AS chain
        FROM every WHERE reason IS NOT NULL""")
    q["validation_counts"] = U("""SELECT *, n_input - n_valid AS n_rejected, (n_checked - n_invalid) / n_checked AS valid_identifier_share FROM (SELECT (SELECT count(*) FROM upl) AS n_input, count(*) FILTER (WHERE reason IS NULL) AS n_valid,
        (SELECT count(*) FROM winners) AS n_claims, count(*) FILTER (WHERE addr <> '' AND row_chain IS NOT NULL) AS n_checked, count(*) FILTER (WHERE reason = 'invalid address') AS n_invalid,
        count(*) FILTER (WHERE reason = 'empty address') AS n_empty_address, count(*) FILTER (WHERE addr <> '' AND row_chain IS NOT NULL AND coalesce(reason, '') <> 'invalid address' AND addr <> wallet_address) AS n_trimmed FROM judged)""")
    chk = "SELECT row_chain AS chain, count(*) AS checked, count(*) FILTER (WHERE reason = 'invalid address') AS invalid, count(*) FILTER (WHERE reason IS NULL) AS valid_rows FROM judged WHERE addr <> '' AND row_chain IS NOT NULL GROUP BY 1"
    q["validation_per_chain"] = U(f"SELECT *, (checked - invalid) / checked AS valid_share FROM ({chk})")
    st = "SELECT row_chain AS chain, CASE WHEN regexp_full_match(addr, '0x[0-9a-fA-F]{40}') THEN 'not_encoded' ELSE 'not_an_address' END AS state, count(*) AS n_rows FROM judged WHERE addr <> '' AND row_chain IS NOT NULL AND row_chain <> 'bitcoin' GROUP BY ALL"
    q["checksum_states"] = U(st)
    sql = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper()      # noqa: E731
    known = ", ".join(f"({k}, '{c}', {str(v).lower()}, {'NULL' if st is None else repr(st)})" for k, (c, v, st) in enumerate(W.IDENTIFIER_KINDS))
    q["identifier_checks"] = f"""SELECT i.kind, chain, valid, state, count(*) AS n, count(DISTINCT hex40) AS n_values, count(*) FILTER (WHERE i.kind IN (3, 7)) AS n_decoded, sum(l_quantity) AS quantity
        FROM ({W.for_duckdb(W.IDENTIFIERS)}) i JOIN (VALUES {known}) k(kind, chain, valid, state) ON i.kind = k.kind GROUP BY ALL"""
    q["registered_family"] = """SELECT 'orders' AS chain, count(*) AS checked, count(*) FILTER (WHERE bad) AS invalid, count(*) FILTER (WHERE NOT bad) AS valid_rows, count(*) FILTER (WHERE NOT bad) / count(*) AS valid_share,
        count(*) FILTER (WHERE NOT bad) AS n_subjects, count(*) FILTER (WHERE NOT bad AND o_orderkey % 7 = 0) AS n_respelled, round(count(*) FILTER (WHERE NOT bad) / count(*), 6) AS share,
        'account' AS subject, 'determined' AS chain_status, 'attribution_claims' AS dataset_type, 'orders' AS found_chain FROM (SELECT *, o_orderkey % 10 = 0 AS bad FROM orders)"""
    q["validation_limitations"] = U(f"""SELECT chain, 'identifiers_failed' AS limitation, invalid AS n_rows FROM ({chk}) WHERE invalid / checked > 0.7
        UNION ALL SELECT chain, 'no_checksum_encoded', n_rows FROM ({st}) WHERE state = 'not_encoded'""")
    q["validation_floor"] = U("""SELECT *, (n_checked - n_invalid) / n_checked AS valid_identifier_share, (n_checked - n_invalid) / n_checked >= 0.3 AS passes FROM (SELECT count(*) FILTER (WHERE addr <> '' AND row_chain IS NOT NULL) AS n_checked,
        count(*) FILTER (WHERE reason = 'invalid address') AS n_invalid FROM judged)""")
    q["uploaded_claim_rows"] = U("SELECT * FROM uclaims")
    q["claims_export"] = U("""SELECT address, 'upload_desk' AS source, raw_label, canon, polarity, root, 'unknown' AS heuristic, '' AS confidence_raw, lastmod, chain, '' AS entity, coalesce(label_cell, '') AS label_cell FROM uclaims""")
    q["multi_label_column"] = """WITH c AS (SELECT categories AS v, count(*) AS n FROM (%s) WHERE categories <> '' GROUP BY 1), a AS (SELECT v, n FROM c WHERE NOT contains(v, ',')),
        l AS (SELECT v, n, (SELECT bool_and(t IN (SELECT v FROM a WHERE n >= 2)) FROM (SELECT unnest(string_split(c.v, ',')) AS t)) AS known FROM c WHERE contains(v, ','))
        SELECT *, n_multi / n_cells AS multi_share, n_known / nullif(n_multi, 0) AS known_share, n_multi / n_cells >= 0.001 AND n_known / nullif(n_multi, 0) >= 0.9 AS is_multi_label FROM (
        SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS n_cells, CAST((SELECT sum(n) FROM l) AS BIGINT) AS n_multi, CAST((SELECT sum(n) FROM l WHERE known) AS BIGINT) AS n_known,
        (SELECT count(*) FROM a WHERE n >= 2) AS n_established_tokens, ',' AS separator)""" % W.for_duckdb(W.UPLOAD)
    up = W.for_duckdb(W.UPLOAD)
    whole = f"upl AS ({up})"
    long_upload = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", row_id, trim({c}) AS value FROM upl WHERE trim({c}) <> ''" for c in W.UPLOAD_COLUMNS)
    q["column_sample"] = f"""WITH upl AS ({up}), s AS ({long_upload}) SELECT "column", row_id, value FROM s QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY md5('3:' || "column" || ':' || row_id), row_id) <= 200"""
    q["paired_sample"] = f"""WITH upl AS ({up}) SELECT row_id, trim(wallet_address) AS first, trim(network) AS second FROM upl WHERE trim(wallet_address) <> '' AND trim(network) <> '' ORDER BY md5('5:' || row_id), row_id LIMIT 200"""
    words = Registry.load().adapters["tag_categories"]
    by_word = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"
    by_label = "CASE " + " ".join(f"WHEN contains(lower(label), '{k.replace('_', ' ')}') THEN '{v}'" for k, v in words.items()) + " END"
    q["tag_pack_observations"] = f"""WITH t AS (SELECT pack, address, currency, category, CASE WHEN label = '' THEN 'scam list' ELSE label END AS label, CASE WHEN confidence = '' THEN 'web_crawl' ELSE confidence END AS confidence FROM ({W.for_duckdb(W.PACK_TAGS)}))
        SELECT coalesce({by_word}, {by_label}, 'unknown') AS canon, 'tagpack:' || CASE WHEN pack % 2 = 0 THEN 'crew ' || CAST(CAST(pack % 3 AS BIGINT) AS VARCHAR) ELSE 'unknown' END AS prov_family, '2024-01-0' || CAST(CAST(pack % 9 + 1 AS BIGINT) AS VARCHAR) AS lastmod,
          confidence AS subcat, label AS raw_label, count(*) AS n_rows, count(DISTINCT address) AS n_addresses FROM t WHERE pack % 7 <> 3 AND currency <> 'ETH' GROUP BY ALL
        UNION ALL SELECT '(warning)', 'unreadable pack: ParserError', NULL, NULL, NULL, count(DISTINCT pack), NULL FROM t WHERE pack % 7 = 3 HAVING count(*) > 0"""
    q["spread_sample"] = f"WITH upl AS ({up}) SELECT * FROM upl ORDER BY md5('0:' || CAST(row_id AS VARCHAR)), row_id LIMIT 200"
    named = """CASE network WHEN 'Ethereum' THEN 'ethereum' WHEN 'eth' THEN 'ethereum' WHEN 'Polygon-Mainnet' THEN 'polygon' WHEN 'BSC' THEN 'bnb_smart_chain'
        WHEN 'btc' THEN 'bitcoin' WHEN 'avalanche c chain' THEN 'avalanche_c' END"""
    q["chain_pair_sample"] = f"""WITH {whole}, p AS (SELECT {named} AS chain, trim(wallet_address) AS a FROM upl WHERE trim(wallet_address) <> '' AND network <> '')
        SELECT chain, count(*) AS n, count(*) FILTER (WHERE chain IS NOT NULL AND chain <> 'bitcoin' AND regexp_full_match(a, '0x[0-9a-fA-F]{{40}}')) AS n_valid FROM p GROUP BY chain"""
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", row_id, trim({c}) AS v FROM upl WHERE trim({c}) <> ''" for c in W.UPLOAD_COLUMNS)
    share = lambda cond: f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"      # noqa: E731
    chain_of = named.replace("CASE network", "CASE v").replace("WHEN 'Ethereum'", "WHEN 'Ethereum'")
    day = "regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}([T ].*)?') AND TRY_CAST(substr(v, 1, 10) AS DATE) IS NOT NULL"
    hexa = "regexp_full_match(v, '0x[0-9a-fA-F]{40}')"
    q["column_profiles"] = f"""WITH {whole}, s AS ({long})
        SELECT "column", count(*) AS n, 0.0::DOUBLE AS "numeric", {share(day)} AS date, 0.0::DOUBLE AS url, 1 - {share(day)} AS text, count(DISTINCT v) AS "distinct", false AS counter, 0.0::DOUBLE AS graded,
        {share("(" + chain_of + ") IS NOT NULL")} AS chain_named, coalesce(string_agg(DISTINCT {chain_of}, ',' ORDER BY {chain_of}), '') AS chains, count(DISTINCT length(v)) AS lengths, min(length(v)) AS shortest, max(length(v)) AS longest,
        bool_and(regexp_full_match(v, '[0-9a-zA-Z]+')) AS opaque, bool_or(EXISTS (SELECT 1 FROM (SELECT unnest(regexp_split_to_array(lower(v), '[^a-z]+')) AS t)
          WHERE t IN ('btc', 'xbt', 'bitcoin', 'ethereum', 'eth', 'ether', 'bnb', 'bsc', 'polygon', 'matic', 'avalanche', 'avax'))) AS names_asset,
        {share(hexa)} AS address_evm, 0.0::DOUBLE AS address_bitcoin, 0.0::DOUBLE AS transaction_evm, 0.0::DOUBLE AS transaction_bitcoin FROM s GROUP BY "column\""""
    report = "\nUNION ALL ".join([
        keyed("agreement", "outcome", ["n", "share"], f"(SELECT o.col0 AS outcome, count(s.subject) AS n, count(s.subject) / (SELECT count(*) FROM subjects WHERE n_sources >= 2) AS share FROM {_OUT5} o LEFT JOIN subjects s ON s.outcome = o.col0 AND s.n_sources >= 2 GROUP BY 1)"),
        keyed("coverage", "", ["n_subjects", "n_multi_source", "multi_source_rate"], "(SELECT count(*) AS n_subjects, count(*) FILTER (WHERE n_sources >= 2) AS n_multi_source, count(*) FILTER (WHERE n_sources >= 2) / count(*) AS multi_source_rate FROM subjects)"),
        keyed("independence", "", ["n_circular"], "(SELECT count(*) FILTER (WHERE circular) AS n_circular FROM subjects WHERE n_sources >= 2)"),
        keyed("sources", "source", ["n_subjects", "n_covered"], "(SELECT a.source, count(*) AS n_subjects, count(*) FILTER (WHERE s.n_sources > 1) AS n_covered FROM named a JOIN subjects s USING (subject) GROUP BY 1)"),
        keyed("containment", "source || '.' || other", ["share_of_a"], "(SELECT source, other, share_of_source AS share_of_a FROM matrix WHERE intersection > 0)"),
        keyed("kappa", "", ["n_pairs", "n_undefined", "n_substantial"], "(SELECT count(*) AS n_pairs, count(*) FILTER (WHERE cohen_kappa IS NULL) AS n_undefined, count(*) FILTER (WHERE substantial) AS n_substantial FROM kappa)"),
        keyed("roots", "", ["total", "identified"], "(SELECT count(DISTINCT root) AS total, count(DISTINCT CASE WHEN resolved THEN root END) AS identified FROM claims)"),
        keyed("currency", "coalesce(source, 'total')", ["current", "stale", "currency_unknown"], "freshness")])
    q["corpus_report"] = _subjects(f"SELECT key, value, 'LIVE' AS basis FROM ({report})", NAMED, PAIRS, FRESH, KAPPA)
    q["preflight_columns"] = "WITH RECURSIVE " + survey({"claims": (W.UPLOAD, W.UPLOAD_COLUMNS), "rivals": (W.RIVALS, W.RIVAL_COLUMNS)}) + """
        SELECT tbl AS "table", col AS "column", meaning, confidence, status, origin, rejected_as_subject, dataset_type, table_status, k.chain, chain_status, array_to_string(blockers, ',') AS blockers, currency_basis
        FROM parts JOIN (SELECT tbl, dataset_type, table_status, chain, chain_status, blockers, currency_basis FROM kinds) k USING (tbl)"""
    holders = {x: m for x, m in W.UPLOAD_CHOICES["holders"].items() if x not in ("phone", "street")}
    q["preflight_choices"] = "WITH RECURSIVE " + survey({"holders": W.UPLOADS["holders"]}, {"holders": holders}) + """
        SELECT 'holders' AS "table", col AS "column", meaning, unnest(CASE WHEN len(objections) > 0 THEN objections ELSE [NULL] END) AS objection, confidence FROM parts WHERE origin = 'user'
        UNION ALL SELECT 'holders', 'phone', 'owner', 'no_such_meaning', NULL UNION ALL SELECT 'holders', 'street', 'chain', 'no_such_column', NULL"""
    firsts = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_rows, {len(cols)} AS n_columns, count(*) = count(DISTINCT {cols[0]}) AS keyed FROM ({W.for_duckdb(sql)})" for t, (sql, cols) in W.UPLOADS.items())
    q["table_roles"] = "WITH RECURSIVE " + survey(W.UPLOADS, {"holders": holders}) + f""",
        best AS (SELECT tbl, max(coalesce(confidence, 0)) FILTER (kind IS NOT NULL AND status <> 'invalid') AS subject, max(coalesce(confidence, 0)) FILTER (meaning IN ('attribution_label', 'attribution_category') AND status <> 'invalid') AS label FROM parts GROUP BY tbl)
        SELECT tbl AS "table", CASE WHEN b.subject IS NOT NULL THEN 'claim_subject' WHEN b.label IS NOT NULL THEN 'attribution' WHEN keyed THEN 'lookup_or_provenance' ELSE 'unknown' END AS role,
          round(coalesce(b.subject, b.label, CASE WHEN keyed THEN 0.5 END, 0), 4) AS confidence, n_rows, n_columns, dataset_type FROM ({firsts}) f JOIN best b USING (tbl) JOIN (SELECT tbl, dataset_type FROM kinds) k USING (tbl)"""
    q["source_class"] = "SELECT count(*) AS n_rows, count(DISTINCT origin) AS n_distinct, count(DISTINCT origin) <= 12 AND count(*) > 10 * count(DISTINCT origin) AS is_class FROM (%s)" % W.for_duckdb(W.UPLOAD)
    q["build_manifest"] = _claims("SELECT source, count(*) AS claims, count(DISTINCT address) AS addresses, CAST(0 AS BIGINT) AS dropped FROM claims GROUP BY ROLLUP (source)")
    cf, uf, ff, nf = (f"({W.for_duckdb(x)})" for x in (W.CLASS_FILE, W.CURATED_FILE, W.FAMILY_FILE, W.NOTES_FILE))
    rf = "(SELECT 'ord' || lpad(cast(o_orderkey AS string), 20, '0') AS address, o_orderstatus AS family, cast(cast(o_orderdate AS date) AS string) AS day, cast(o_orderkey + 2 AS double) AS usd FROM orders WHERE o_orderpriority <> '5-LOW')"
    q["adapters_build"] = f"""WITH r AS (
        SELECT 'ellipticpp' AS source, CASE class WHEN '1' THEN 'illicit_unspec' WHEN '2' THEN 'licit_unspec' ELSE 'unknown' END AS canon, 'undisclosed' AS heuristic, address, 'elliptic_undisclosed' AS fam, '' AS day FROM {cf} WHERE class <> '0'
        UNION ALL SELECT 'schnoering', CASE upper(trim(category)) WHEN 'MIXER' THEN 'mixer' WHEN 'BET' THEN 'gambling' WHEN 'MARKETPLACE' THEN 'darknet_market' ELSE 'unknown' END, 'multi_input', address, 'schnoering:seg', '' FROM {uf}
        UNION ALL SELECT 'rodwald_ransom', 'ransomware', 'inherited', address, 'rodwald:' || source, '' FROM {ff}
        UNION ALL SELECT 'ransomwhere', 'ransomware', 'none', address, 'ransomwhere:crowd', day FROM {rf}
        UNION ALL SELECT 'watchyourback', CASE lower(c) WHEN 'ransomware' THEN 'ransomware' ELSE 'darknet_market' END, 'manual_verified', a, 'wyb:manual', '' FROM {nf} WHERE b = 'BTC')
        SELECT source, canon, CASE WHEN canon IN ('illicit_unspec', 'mixer', 'darknet_market', 'ransomware') THEN 'illicit' WHEN canon = 'unknown' THEN 'unknown' ELSE 'licit' END AS polarity, heuristic,
          count(*) AS n_rows, count(DISTINCT address) AS n_addresses, min(fam) AS first_family, max(day) AS last_day FROM r WHERE length(address) >= 20 GROUP BY ALL
        UNION ALL SELECT source, '(dropped)', '', '', count(*), NULL, NULL, NULL FROM r WHERE length(address) < 20 GROUP BY source
        UNION ALL SELECT 'ellipticpp', 'unrecognised class code 0', '', '', count(*), NULL, NULL, NULL FROM {cf} WHERE class = '0'"""
    q["values_and_anchors"] = f"""WITH v AS (SELECT address, 'rodwald_ransom' AS dataset, coalesce(TRY_CAST(SUM_REC_USD AS DOUBLE), 0) AS usd FROM {ff} UNION ALL SELECT address, 'ransomwhere', usd FROM {rf})
        SELECT dataset, address IN (SELECT a FROM {nf} WHERE b = 'BTC' AND c = 'ransomware') AS anchored, count(*) AS n_rows, sum(usd) AS usd FROM v GROUP BY ALL"""
    q["observation_files"] = _claims("SELECT source, root, count(*) AS n_claims, count(DISTINCT subject) AS n_subjects, count(*) FILTER (WHERE subject <> address) AS n_marked FROM claims GROUP BY ALL")
    q["file_round_trips"] = """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'second:' || o_orderpriority ELSE 'first:' || o_orderstatus END AS name, count(*) AS n, 0.0::DOUBLE AS value FROM orders GROUP BY 1
        UNION ALL SELECT o_orderstatus, count(*), round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END), 2) FROM orders GROUP BY 1
        UNION ALL SELECT 'anchors', count(DISTINCT o_custkey), 0.0 FROM orders
        UNION ALL SELECT chr(39) || '=' || o_orderstatus, count(*), 0.0 FROM orders GROUP BY 1
        UNION ALL SELECT CAST(n_regionkey AS VARCHAR), count(*), CAST(sum(length(n_name)) AS DOUBLE) FROM nation GROUP BY 1"""
    # ---- several tables
    q["joined_tables"] = """SELECT o_orderkey AS orders__o_orderkey, o_custkey AS orders__o_custkey, c_name AS customer__c_name, n_name AS nation__n_name, r_name AS region__r_name
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    q["orphan_keys"] = """SELECT 'lineitem' AS local_table, 'l_orderkey' AS local_key, 'orders' AS "table", count(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'lineitem', 'l_partkey', 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'documents', 'doc_id', 'labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    cols = {"documents": ["doc_id", "text"], "labels": ["doc_id"], "conversations": ["text"], "benchmark": ["text"]}
    uniq = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) / count({c}) AS share FROM {t}" for t, cs in cols.items() for c in cs)
    q["table_relationships"] = f"""WITH u AS ({uniq}) SELECT a.t AS from_table, a.c AS from_column, b.t AS to_table, b.c AS to_column, 'inferred' AS kind, CAST(0.6 AS DOUBLE) AS confidence
        FROM u a JOIN u b ON a.c = b.c AND a.t <> b.t WHERE b.share >= 0.95"""
    q["joined_validation"] = "WITH " + JOINED + " SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n_rows FROM jj GROUP BY 1"
    q["joined_profile"] = "WITH " + JOINED + """, s AS (SELECT count(*) AS claims, count(DISTINCT hex) AS addresses, count(DISTINCT canon) AS labels, count(DISTINCT nullif(nation, '')) AS sources,
        count(*) FILTER (WHERE nation <> '') AS with_source, count(*) FILTER (WHERE day <> '') AS with_date FROM jc)
        SELECT 'scale' AS section, 'claims' AS name, claims AS n FROM s UNION ALL SELECT 'scale', 'addresses', addresses FROM s UNION ALL SELECT 'scale', 'labels', labels FROM s UNION ALL SELECT 'scale', 'sources', sources FROM s
        UNION ALL SELECT 'scale', 'with_source', with_source FROM s UNION ALL SELECT 'scale', 'with_source_url', 0 UNION ALL SELECT 'scale', 'with_evidence', 0 UNION ALL SELECT 'scale', 'with_confidence', 0
        UNION ALL SELECT 'scale', 'with_date', with_date FROM s UNION ALL SELECT 'chain', 'ethereum', claims FROM s UNION ALL SELECT 'label', canon, count(*) FROM jc GROUP BY canon
        UNION ALL SELECT 'quality', 'duplicate_addresses', count(*) FROM (SELECT hex FROM jc GROUP BY hex HAVING count(*) > 1)"""
    return q
