"""SQL for DuckDB with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALPHANUMERIC}) AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALPHANUMERIC}) AS words
    FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, words[i:i + 9] AS w FROM starts),
sizes AS (SELECT DISTINCT len(w) AS n FROM windows),
places AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows ON words[i:i + n - 1] = w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit,
    CAST(coalesce(n_items, 0) AS bigint) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
    FROM documents),
runs AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i, w FROM docs WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, w[i:i + 3] AS s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON r = a),
named AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS bigint) AS n_shingles, component_id
FROM named LEFT JOIN sizes USING (doc_id)
"""

_USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP2 = f"""
WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings WHERE {_USABLE}),
units AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM good
    WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y
    ON x.vec_id <> y.vec_id AND len(x.u) = len(y.u) AND list_dot_product(x.u, y.u) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON r = a),
named AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS bigint) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN degrees USING (vec_id)
"""

OP9 = f"""
WITH counts AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS b,
    len(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALPHANUMERIC})) AS a FROM documents),
kept AS (SELECT * FROM counts WHERE b >= 20),
rows AS (SELECT source, lang, 'blank-1' AS tokenizer, CASE WHEN lang = 'fr' THEN a ELSE b END AS n FROM kept
    UNION ALL SELECT source, lang, 'alnum-1', a FROM kept)
SELECT source, lang, tokenizer, CAST(count(*) AS bigint) AS n_docs, CAST(sum(n) AS bigint) AS n_tokens
FROM rows GROUP BY source, lang, tokenizer
"""



def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    """All rounds written out, each with full scans."""
    steps = [
        f"""components AS MATERIALIZED (SELECT vec_id, label, i // (dims // {parts}) AS p, i % (dims // {parts}) AS j,
            CAST(floor(4096 * CAST(v AS double)) AS bigint) AS x
        FROM (SELECT vec_id, label, len(embedding) AS dims, unnest(embedding) AS v, unnest(range(len(embedding))) AS i
            FROM embeddings WHERE {_USABLE}))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM components JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
            FROM (SELECT DISTINCT vec_id FROM components) ORDER BY vec_id LIMIT {entries}) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, label, p, min(gap * {entries} + e) AS m
            FROM (SELECT vec_id, label, p, e, CAST(sum((x - c) * (x - c)) AS bigint) AS gap
                FROM components JOIN book{r} USING (p, j) GROUP BY vec_id, label, p, e) GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT p, e, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
            FROM book{r} LEFT JOIN (SELECT p, m % {entries} AS e, j, CAST(sum(x) AS bigint) AS s, count(*) AS n
                FROM components JOIN near{r} USING (vec_id, p) GROUP BY p, m % {entries}, j) USING (p, e, j))""")
    return f"""WITH {", ".join(steps)},
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code,
        CAST(sum(m // {entries}) AS bigint) AS error FROM near{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS varchar), ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
    FROM coded"""


OP11 = _vector_codes(8, 16, 6)

OP12 = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
    FROM words, (VALUES (1), (2), (3)) lengths(k) WHERE len(w) >= k),
found AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM places GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, k, g, f AS a FROM found WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM candidates),
scored AS (SELECT c.lang, c.k, c.g, a, cut, x.f AS l, y.f AS r,
        CAST((CAST(1000000 AS hugeint) * a * a) // (CAST(x.f AS hugeint) * y.f) AS bigint) AS score
    FROM cuts c JOIN found x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN found y ON y.lang = c.lang AND y.g = c.g[cut + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM candidates WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, g)
    WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS bigint) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM texts),
keyed AS (SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""

ORACLES = {
    "op11_vector_codes": OP11,
    "op12_collocations": OP12,
    "op13_line_dedup": OP13,
    "op9_token_rollup": OP9,
    "op2_near_vectors": OP2,
    "op10_ngram_jaccard": OP10,
    "op1_decontamination": OP1,
}
