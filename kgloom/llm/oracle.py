"""DuckDB SQL for the rows of the queries that SQL can express, by plain brute force."""

from __future__ import annotations

from . import common, funnels, license_scan

_LOW = f"translate(coalesce({{0}}, ''), '{common.UPPER}', '{common.LOWER}')"
_WORDS = f"regexp_extract_all({_LOW}, '{common.WORD}')"

OP1 = f"""WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), lens AS (SELECT DISTINCT n FROM win),
spread AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens)),
hits AS (SELECT doc_id, i, n, item FROM spread JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op5(templates=license_scan.TEMPLATES, phrases=license_scan.PHRASES, containment: float = 0.8) -> str:
    rows = ", ".join(f"('{label}', list_distinct({_WORDS.format(chr(39) + text + chr(39))}))" for label, text in templates)
    base = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM spread WHERE array_to_string(w[i : i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in phrases.items()
    )
    return f"""WITH docs AS (SELECT doc_id, {_LOW.format('text')} AS t, {_WORDS.format('text')} AS w FROM documents), spread AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
places AS ({base}), templates(label, ws) AS (VALUES {rows}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{common.WORD}')) AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)),
found AS (SELECT doc_id, label, len(list_intersect(blocks.ws, templates.ws)) / len(templates.ws)::DOUBLE AS share FROM blocks, templates WHERE len(list_intersect(blocks.ws, templates.ws)) >= ceil({containment} * len(templates.ws) - 1e-9)),
p AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY 1),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY 1),
top AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN p USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN top USING (doc_id)"""


OP6 = f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, two_way.b FROM reach JOIN two_way ON reach.b = two_way.a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM docs LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

OP8 = f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, i, line, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
h AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


def op12(plans=funnels.FUNNELS, minutes: int = 5, per_cent: int = 25) -> str:
    rows = ", ".join(f"('{name}', {', '.join(repr(k) for k in (*steps, *excluded))})" for name, (steps, excluded) in plans.items())
    steps = "".join(f"""
a{i} AS (SELECT a.*, n.t AS t{i} FROM a{i - 1} a ASOF JOIN e n ON a.client_id = n.client_id AND a.k{i} = n.kind AND a.t{i - 1} < n.t),
b{i} AS (SELECT a.*, x.t AS x{i} FROM a{i} a ASOF LEFT JOIN e x ON a.client_id = x.client_id AND a.x = x.kind AND a.t{i - 1} < x.t),
r{i} AS (SELECT * EXCLUDE x{i} FROM b{i} WHERE t{i} <= t1 + INTERVAL {minutes} MINUTE AND (x{i} IS NULL OR x{i} > t{i})),""" for i in (2, 3, 4))
    for i in (2, 3, 4):
        steps = steps.replace(f"FROM a{i - 1} a ASOF JOIN", f"FROM {'a1' if i == 2 else f'r{i - 1}'} a ASOF JOIN")
    gap = "list_sort(list(epoch_us(r{0}.t{0}) - epoch_us(r{0}.t{1})))"
    counts = ", ".join(f"""
c{i} AS (SELECT funnel, client_id, count(*) AS n, {gap.format(i, i - 1)} AS g FROM r{i} GROUP BY 1, 2)""" for i in (2, 3, 4))
    times = ", ".join(f"c{i}.g[({per_cent} * c{i}.n + 99) // 100] AS t{i}" for i in (2, 3, 4))
    return f"""WITH f(funnel, k1, k2, k3, k4, x) AS (VALUES {rows}),
e AS (SELECT DISTINCT client_id, kind, arrived_at AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
a1 AS (SELECT f.*, client_id, t AS t1 FROM e JOIN f ON kind = k1),{steps}
c1 AS (SELECT funnel, client_id, count(*) AS n FROM a1 GROUP BY 1, 2),{counts}
SELECT funnel, client_id, c1.n AS n1, coalesce(c2.n, 0) AS n2, coalesce(c3.n, 0) AS n3, coalesce(c4.n, 0) AS n4,
(1 + (n2 > 0)::INT + (n3 > 0)::INT + (n4 > 0)::INT)::INT AS deepest, {times}, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
FROM c1 LEFT JOIN c2 USING (funnel, client_id) LEFT JOIN c3 USING (funnel, client_id) LEFT JOIN c4 USING (funnel, client_id)"""


OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all({_LOW.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d), kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM n JOIN v USING (lang)),
w AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM w JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

#: Bytes as two hexadecimal digits each.
OP11 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), 
b AS (SELECT doc_id, o, x[2 * o + 1 : 2 * o + 598] AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 250)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS i, y[2 * i + 1 : 2 * i + 100] AS s FROM (SELECT doc_id, o, y, unnest(range(0, least(250, len(y) // 2 - 49))) AS i FROM b)), m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM w JOIN m USING (s) WHERE low < doc_id),
r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY 1, 2),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
h AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) || x[2 * max(b) + 1 :] AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id, x)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN h USING (doc_id)"""
