"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = UP.lower()

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def url_filter(rules) -> str:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {values}),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UP}', '{LOW}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
hits AS (
  SELECT p.page_id, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.rverdict, 'allow') AS verdict
FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1
"""


def mixing(weights, share, limit, curriculum, fills) -> str:
    """Targets, epochs and fill rounds as window functions; one-segment schedules only."""
    pick = lambda values, number: f"[{', '.join(repr(float(v)) for v in values)}][({number} - 1) % {len(values)} + 1]"
    low = pick([knots[0][1] for knots in curriculum], "source_no")
    high = pick([knots[-1][1] for knots in curriculum], "source_no")
    order = "ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    rounds, last = "", "r0"
    for k in range(1, fills + 1):
        rounds += f"""
c{k} AS (
  SELECT *, rest_start IS NULL AND size > 0 AND size <= rest AS open,
    coalesce(sum(CASE WHEN rest_start IS NULL AND size > 0 AND size <= rest THEN size ELSE 0 END)
      OVER (PARTITION BY source_no {order}), 0) AS start
  FROM {last}
),
d{k} AS (SELECT * EXCLUDE (rest_start), CASE WHEN open AND start + size <= rest THEN filled + start ELSE rest_start END AS rest_start FROM c{k}),
r{k} AS (
  SELECT * EXCLUDE (rest, filled, open, start, taken_now), rest + filled - taken_now AS rest, taken_now AS filled
  FROM (SELECT *, coalesce(sum(CASE WHEN rest_start IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source_no), 0) AS taken_now FROM d{k})
),"""
        last = f"r{k}"
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents
),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s0),
s2 AS (SELECT *, {pick(weights, "source_no")} AS weight, source_size * {float(limit)!r}::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (
  SELECT *,
    ((SELECT sum(source_size) FROM s1) * {float(share)!r}::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((SELECT sum(weight) FROM s2) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s3 WINDOW w AS (ORDER BY ratio, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
water AS (SELECT arg_min(level, (ratio, source_no)) AS level FROM s4 WHERE ratio > level),
sources AS (SELECT source, source_no, source_size, least(cap, coalesce((SELECT level FROM water) * weight, cap)) AS target FROM s4),
plan AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM sources),
r0 AS (
  SELECT t.doc_id, t.size, t.hash, p.source_no, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest, 0 AS filled,
    coalesce(sum(t.size) OVER (PARTITION BY p.source_no {order}), 0) AS epoch_start, NULL::BIGINT AS rest_start
  FROM sized t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source
),{rounds}
done AS (
  SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN rest_start IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END AS copies,
    ((CASE WHEN epochs > 0 THEN epoch_start ELSE rest_start END) + size / 2.0::DOUBLE) / (epochs * source_size + filled) AS x,
    {low} AS low, {high} AS high
  FROM {last}
)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(2.0 * x * (low + high) / 2 / (low + sqrt(low * low + 2.0 * (high - low) * x * (low + high) / 2)), 9) END AS position
FROM done
"""


NGRAM_JOIN = f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(c.least_id, t.doc_id)) AS component_id, coalesce(d.n_links, 0) AS n_links
FROM t LEFT JOIN n ON n.doc_id = t.doc_id
LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) c ON c.a = t.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) d ON d.a = t.doc_id
"""


TOPK_SEARCH = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: crc32 of a decimal number's text, bit by bit: every digit is followed by eight shifts, marked by -1.
_CRC32 = """(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for d in string_split(conv_id::VARCHAR, '')])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END))"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
own AS MATERIALIZED (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS ts FROM t GROUP BY conv_id
),
h AS (SELECT conv_id, ts, xor({_CRC32}, 4294967295::BIGINT) % 6 AS h, conv_id - conv_id % 100 AS base FROM own),
r AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.base
),
steps AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM r),
nodes AS MATERIALIZED (
  SELECT ts[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL
),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
n AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(nodes.path[-1].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN child ON child.path = nodes.path
),
up AS (SELECT path[1:d] AS path, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN sums s ON s.path = n.path LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


COLLOCATIONS = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UP}', '{LOW}') AS text FROM documents),
p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) ks(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100
),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2),
kept AS (
  SELECT * FROM c x WHERE NOT EXISTS (
    SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND y.a >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
),
cuts AS (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""
