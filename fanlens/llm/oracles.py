"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from fanlens.llm.line_dedup import MIN_PAGES, RATIO
from fanlens.llm.queries import URL_RULES
from fanlens.llm.sharding import SEED
from fanlens.llm.url_filter import LOWER, UPPER

OP6 = f"""
WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT DISTINCT doc_id, source, trim(unnest(ls), ' ') AS l FROM cut),
site AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
    SELECT line.source, l FROM line JOIN site ON line.source IS NOT DISTINCT FROM site.source
    WHERE l <> '' GROUP BY line.source, l, total HAVING count(*) >= {MIN_PAGES} AND count(*) / total > {RATIO}
),
lists AS (SELECT source, list(l) AS gone FROM bad GROUP BY source),
kept AS (
    SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' '))) AS left_ls
    FROM cut LEFT JOIN lists ON cut.source IS NOT DISTINCT FROM lists.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(left_ls, chr(10)) END AS text,
       coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(ls) - len(left_ls), 0)::INT AS n_dropped
FROM kept
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP8 = f"""
WITH rules(rh, rp, verdict) AS (VALUES {_RULES}),
tail AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM tail),
parts AS (
    SELECT page_id, coalesce(translate(raw, '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM cut
),
fits AS (
    SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS v
    FROM parts JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
    GROUP BY page_id, host, path
)
SELECT parts.page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

# CRC-32 (reflected polynomial 0xEDB88320), one table lookup a byte
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
OP9 = f"""
WITH RECURSIVE bits(k, i, c) AS (
    SELECT 0, i, i FROM range(256) t(i)
    UNION ALL SELECT k + 1, i, {_STEP} FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
rows_of AS (SELECT doc_id, source, coalesce(text, '') AS text, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sums AS (
    SELECT doc_id, source, h, strlen(text) + 1 AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               CASE WHEN text = '' THEN [] ELSE regexp_extract_all(hex(text), '..') END, lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
    FROM rows_of, crc
),
ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM sums
),
placed AS (SELECT *, row_number() OVER (ORDER BY f, h) - 1 AS pos, count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (pos * 8) // n AS s FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, s::INT AS shard,
       (pos - (s * n + 7) // 8)::BIGINT AS slot, NULL::DOUBLE AS grown_shard
FROM cut
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_UP = "sha256(string_agg(h, '' ORDER BY i))"
_SIBLINGS = """
    SELECT a.lv, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
    FROM {0} a LEFT JOIN {0} b ON a.lv = b.lv AND a.g = b.g AND a.i // 3 = b.i // 3 AND a.i <> b.i
    WHERE a.n > 1 GROUP BY a.lv, a.g, a.i
"""
_CLIMB = """
    SELECT doc, c.lv + 1, c.g, c.i // 3, (c.n + 2) // 3, sha256(before || acc || after), proof || before || after
    FROM {0} c JOIN {1} s ON c.lv = s.lv AND c.g = s.g AND c.i = s.i WHERE c.n > 1
"""
OP11 = f"""
WITH RECURSIVE bits(k, i, c) AS (
    SELECT 0, i, i FROM range(256) t(i)
    UNION ALL SELECT k + 1, i, {_STEP} FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
docs AS (
    SELECT doc_id, source, lang, n_chars, text,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(doc_id::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 AS chosen
    FROM documents, crc
),
leaves AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, sha256({_LEAF.format(text='text')}) AS leaf,
           CASE WHEN chosen THEN sha256({_LEAF.format(text="replace(text, chr(10), '')")}) END AS tampered
    FROM docs
),
base AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
           row_number() OVER () AS doc FROM leaves
),
tree(lv, g, i, h, n) AS (
    SELECT 0, g, i, leaf, n FROM base
    UNION ALL (SELECT lv + 1, g, i // 3, {_UP}, any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY lv, g, i // 3)
),
subroots AS (SELECT g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
above(lv, g, i, h, n) AS (
    SELECT 0, '', i, h, n FROM subroots
    UNION ALL (SELECT lv + 1, g, i // 3, {_UP}, any_value((n + 2) // 3) FROM above WHERE n > 1 GROUP BY lv, g, i // 3)
),
near AS ({_SIBLINGS.format('tree')}),
far AS ({_SIBLINGS.format('above')}),
climb(doc, lv, g, i, n, acc, proof) AS (
    SELECT doc, 0, g, i, n, coalesce(tampered, leaf), '' FROM base UNION ALL {_CLIMB.format('climb', 'near')}
),
higher(doc, lv, g, i, n, acc, proof) AS (
    SELECT doc, 0, '', s.i, s.n, acc, proof FROM climb JOIN subroots s ON climb.g = s.source WHERE climb.n = 1
    UNION ALL {_CLIMB.format('higher', 'far')}
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified
FROM base JOIN higher ON base.doc = higher.doc AND higher.n = 1 JOIN subroots s ON base.g = s.source, (SELECT h FROM above WHERE n = 1) r
"""

OP12 = """
WITH fit AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
score AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
    FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
positive AS (SELECT * FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER best)::INT AS rank, x.vec_id AS negative_id,
       p.s AS positive_score, x.s AS negative_score
FROM positive p JOIN score x ON p.anchor_id = x.anchor_id AND NOT x.same AND 50 * p.s <= 100 * x.s AND 100 * x.s <= 95 * p.s
WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY x.s DESC, x.vec_id)
QUALIFY row_number() OVER best <= 3
"""

ORACLES = {"op6_line_dedup": OP6, "op8_url_filter": OP8, "op9_sharding": OP9, "op11_merkle_manifest": OP11, "op12_hard_negatives": OP12}
