"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from .mixing import EPOCHS, LEVELS, OTHER, PER_MILLE, SEED, WEIGHTS

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

OP2 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), original AS (
  SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original = page_id THEN NULL ELSE original END AS refers_to
FROM d LEFT JOIN original ON d.payload_digest = original.payload_digest AND payload_bytes >= 1000
"""


def _weight(level: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {whens} ELSE {OTHER} END" if whens else str(OTHER)


def _fill(made: str, rows: str, parents: str, level: str) -> str:
    """The CTEs that share `above` among the children of each parent, as fill() does."""
    window = f"PARTITION BY {parents}"
    return f"""
{made}_1 AS (
  SELECT *, sum(room) OVER upto AS c, sum(weight) OVER (PARTITION BY {parents}) - sum(weight) OVER upto AS w FROM ({rows})
  WINDOW upto AS ({window} ORDER BY room / weight, {level} ROWS UNBOUNDED PRECEDING)
), {made}_2 AS (
  SELECT *, c * weight + room * w <= above * weight AS is_full FROM {made}_1
), {made}_3 AS (
  SELECT *, above - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ({window}) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({window}) AS open FROM {made}_2
), {made}_4 AS (
  SELECT *, CASE WHEN is_full THEN room ELSE least(room, (rest * weight) // open) END AS base FROM {made}_3
), {made}_5 AS (
  SELECT *, above - sum(base) OVER ({window}) AS spare,
    sum(CASE WHEN base < room THEN 1 ELSE 0 END) OVER ({window} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS turn FROM {made}_4
), {made} AS (
  SELECT * EXCLUDE (c, w, is_full, rest, open, base, spare, turn, above),
    base + CASE WHEN base < room AND turn <= spare THEN 1 ELSE 0 END AS budget FROM {made}_5
)"""


OP3 = f"""
WITH docs AS (
  SELECT doc_id, 'd' || translate(substr(md5(coalesce(source, '')), 1, 1), '0123456789abcdef', '0123012301230123') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
), rows_ AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens FROM rows_ GROUP BY ALL),
whole AS (SELECT least((sum(leaf_tokens) * {PER_MILLE}) // 1000, sum(leaf_tokens) * {EPOCHS}) AS above FROM leaves),
{_fill("n1", f"SELECT 0 AS root, domain, sum(leaf_tokens) * {EPOCHS} AS room, {_weight('domain')} AS weight, any_value(above) AS above FROM leaves, whole GROUP BY domain", "root", "domain")},
{_fill("n2", f"SELECT domain, lang, sum(leaf_tokens) * {EPOCHS} AS room, {_weight('lang')} AS weight, any_value(budget) AS above FROM leaves JOIN n1 USING (domain) GROUP BY domain, lang", "domain", "lang")},
{_fill("n3", f"SELECT domain, lang, source, leaf_tokens * {EPOCHS} AS room, {_weight('source')} AS weight, budget AS above FROM leaves JOIN n2 USING (domain, lang)", "domain, lang", "source")},
placed AS (
  SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, budget::BIGINT AS leaf_budget, (budget // leaf_tokens)::BIGINT AS whole
  FROM rows_ JOIN leaves USING ({", ".join(LEVELS)}) JOIN n3 USING ({", ".join(LEVELS)})
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {", ".join(LEVELS)} ORDER BY md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed
)
SELECT * FROM (
  SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN upto <= leaf_budget - whole * leaf_tokens THEN 1 ELSE 0 END AS copies, leaf_tokens, leaf_budget FROM summed
) WHERE copies > 0
"""


OP11 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), site(verdict, site_host, site_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged AS (
  SELECT *, (SELECT max_by({'rule': site_host || site_path, 'verdict': verdict}, length(site_host || site_path)) FROM site
    WHERE (host = site_host OR ends_with(host, '.' || site_host)) AND starts_with(path, site_path)) AS best FROM p
)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict
  WHEN regexp_matches(coalesce(url, ''), '(?i)^[^:/?#]*://([^/?#]*\.)?ads-track\..*/privacy([^a-z0-9_.%-]|$)') THEN 'allow'
  WHEN regexp_matches(coalesce(url, ''), '(?i)^[^:/?#]*://([^/?#]*\.)?(casino-win|free-bets|cheap-pills|spam-farm|ads-track|adult-x)\.')
    OR regexp_matches(coalesce(url, ''), '(?i)[^a-z0-9_.%-](casino|xxx)([^a-z0-9_.%-]|$)|/porn/|&affid=|clickbait|/ad/.*\.gif$') THEN 'block'
  ELSE 'allow' END AS verdict FROM judged
"""

_MEANS = """{new} AS (
  SELECT p, k, list(m ORDER BY i) AS e FROM (
    SELECT p, k, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM {given}) GROUP BY p, k, i
  ) GROUP BY p, k
  UNION ALL SELECT p, k, e FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM {given} a WHERE a.p = o.p AND a.k = o.k)
)"""
_NEAREST = """{given} AS (
  SELECT vec_id, label, p, any_value(x) AS x, min(d) AS d, arg_min(k, (d, k)) AS k FROM (
    SELECT v.vec_id, v.label, v.p, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part v JOIN {old} c USING (p)
  ) GROUP BY vec_id, label, p
)"""
OP12 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT vec_id, label, p, e[p * len(e) // 16 + 1 : (p + 1) * len(e) // 16] AS x FROM v, (SELECT unnest(range(16)) AS p)
), c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS e FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
), {_NEAREST.format(given="a0", old="c0")}, {_MEANS.format(new="c1", given="a0", old="c0")},
{_NEAREST.format(given="a1", old="c1")}, {_MEANS.format(new="c2", given="a1", old="c1")},
{_NEAREST.format(given="a2", old="c2")},
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256 FROM coded
"""

OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), s AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(h1, h2)], '') AS prefix, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS middle, array_to_string(u[greatest(h1, h2) + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_itq_near_dup": OP1, "op2_warc_bundles": OP2, "op3_mix_budgets": OP3, "op11_url_rules": OP11, "op12_elkan_codes": OP12, "op13_fill_in_middle": OP13}
