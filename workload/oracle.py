"""SQL counterparts of the registered queries, in DuckDB's dialect.

One prelude per corpus states every step from documents to reports; a query is that prelude
plus a final SELECT. RE2 has neither look-around nor Unicode ``\\b``, so word borders are
spelled out.
"""

from __future__ import annotations

from topicgauge import guidance
from topicgauge import settings as S
from workload.corpora import HTML_REWRITES, MARKDOWN_REWRITES, TOPICS

_WIDE = r"\x{1680}\x{2000}-\x{200a}"
WS = rf"\t-\r\x1c-\x20\x{{85}}\x{{a0}}{_WIDE}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"
WS_NO_LF = rf"\t\x0b-\r\x1c-\x20\x{{85}}\x{{a0}}{_WIDE}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"
INL = rf"\t\x1f\x20\x{{a0}}{_WIDE}\x{{202f}}\x{{205f}}\x{{3000}}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
MD_HEAD = rf"^#{{2,3}}[{WS_NO_LF}][^\n]"
HTML_HEAD = r"(?is)<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>"
DIM = 16


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, '[{WS}]+$', '')"


def collapse(c: str) -> str:
    return f"regexp_replace({strip(c)}, '[{WS}]+', ' ', 'g')"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


def tokens(c: str) -> str:
    return f"greatest(1, length({c}) // {S.CHARS_PER_TOKEN})"


def preview(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN {rstrip(f'substr({c}, 1, {n})')} || '...' ELSE {c} END"


def pieces(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"


def border(alternatives: str, flags: str = "(?i)") -> str:
    return rf"{flags}(^|[^\p{{L}}\p{{N}}_])(?:{alternatives})($|[^\p{{L}}\p{{N}}_])"


def rewritten(c: str, rewrites: list[tuple[str, str]]) -> str:
    for pattern, replacement in rewrites:
        new = replacement.replace("$", "\\")
        c = f"regexp_replace({c}, {lit("(?m)" + pattern)}, {lit(new)}, 'g')"
    return c


def label(score: str, floors, below: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {f} THEN {lit(t)}" for f, t in floors) + f" ELSE {lit(below)} END"


def filled(text) -> str:
    """A text of the guidance with its values."""
    template, names = text
    edge = lambda b: f"printf('%.2f', {b})"
    known = {
        "total": "total_chunks", "off": "chunks_off_topic", "weak": "chunks_weak", "strong": "chunks_strong", "low_sections": "low_sections",
        "words": "word_count", "links": "link_count", "strong_from": edge("strong"), "moderate_from": edge("moderate"), "weak_from": edge("weak"),
        "intro_share": "round_even(intro_query_term_coverage * 100, 0)::INT", "best_share": "round_even(best_position * 100, 0)::INT",
        "sources": "CASE WHEN has_sources_section THEN 'yes' ELSE 'no' END", "low_heading": "coalesce(low_heading, '')",
        "low_score": "round_even(low_score, 0)::INT",
    }
    if not names:
        return lit(template)
    return f"printf({lit(template)}, {', '.join(f'({known[n]})::VARCHAR' for n in names)})"


TOPICS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS query_id, {lit(q)} AS query, {lit(s)} AS scope, {lit(o)}::VARCHAR AS intent_override" for i, q, s, o in TOPICS
)


# --- documents -------------------------------------------------------------------

_PLAIN = "SELECT doc_id, text, lang AS scope FROM documents"
_MARKDOWN = f"SELECT doc_id, {rewritten('text', MARKDOWN_REWRITES)} AS text, lang AS scope FROM documents"
_HTML = (
    f"SELECT page_id AS doc_id, {rewritten('html', HTML_REWRITES)} AS text, "
    "regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS scope FROM pages"
)
_MIXED = " UNION ALL ".join(
    f"SELECT doc_id * 3 + {i} AS doc_id, text, scope FROM ({q})" for i, q in enumerate((_PLAIN, _MARKDOWN, _HTML))
)
CORPORA = {"plain": _PLAIN, "markdown": _MARKDOWN, "html": _HTML, "mixed": _MIXED}
_FORMAT = (
    rf"CASE WHEN regexp_matches(text, '(?m)^#{{2,3}}[{WS}]+[^\n]') THEN 'markdown' "
    r"WHEN regexp_matches(text, '(?is)<h[23][^>]*>.*?</h[23]>') THEN 'html' ELSE 'flat' END"
)
STRATEGY = {"plain": "'flat'", "markdown": "'markdown'", "html": "'html'", "mixed": _FORMAT}


def _recursive_pack(name: str, source: str, keys: str, size: str, limit: int) -> str:
    on = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    new = f"p.filled + s.{size} > {limit}"
    cols = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{name} AS (
  SELECT {keys}, 1 AS i, {size} AS filled, 0 AS piece FROM {source} WHERE i = 1
  UNION ALL
  SELECT {cols}, s.i, CASE WHEN {new} THEN s.{size} ELSE p.filled + s.{size} END,
         CASE WHEN {new} THEN p.piece + 1 ELSE p.piece END
  FROM {name} p JOIN {source} s ON {on} AND s.i = p.i + 1)"""


def _chunks(corpus: str) -> list[str]:
    clean = collapse("regexp_replace(c, '<[^>]+>', ' ', 'g')")
    return [
        f"docs AS MATERIALIZED ({CORPORA[corpus]})",
        f"tagged AS MATERIALIZED (SELECT *, {STRATEGY[corpus]} AS strategy FROM docs WHERE {strip('text')} <> '')",
        # Markdown sections
        f"""md_lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM tagged WHERE strategy = 'markdown'))""",
        f"""md_marked AS (SELECT *, regexp_matches(line, '{MD_HEAD}') AS head,
  (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln))::BIGINT - length(line) - 1 AS pos FROM md_lines)""",
        """md_numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS sec FROM md_marked)""",
        f"""md_all AS (SELECT doc_id, sec,
  coalesce(max(CASE WHEN head THEN CASE WHEN starts_with(line, '###') THEN 3 ELSE 2 END END), 4) AS level,
  max(CASE WHEN head THEN {strip("regexp_replace(line, '^#{2,3}', '')")} END) AS heading,
  {strip("string_agg(line, chr(10) ORDER BY ln) FILTER (NOT head)")} AS content,
  min(pos) AS char_start, max(pos + length(line) + 1) AS stop FROM md_numbered GROUP BY doc_id, sec)""",
        """md AS (SELECT doc_id, sec, level, heading, content, char_start,
  CASE WHEN sec = max(sec) OVER (PARTITION BY doc_id) THEN stop ELSE stop - 1 END AS char_end FROM md_all)""",
        # HTML sections
        f"""html_cut AS (SELECT doc_id, regexp_extract_all(text, '{HTML_HEAD}') AS heads,
  string_split_regex(text, '{HTML_HEAD}') AS gaps FROM tagged WHERE strategy = 'html')""",
        """html_at AS (SELECT doc_id, heads, gaps, unnest(range(0, len(heads) + 1)) AS sec FROM html_cut)""",
        """html_pos AS (SELECT *, gaps[sec + 1] AS c, coalesce(heads[sec], '') AS h,
  (coalesce(list_sum(list_transform(gaps[1:sec], lambda x: length(x))), 0)
  + coalesce(list_sum(list_transform(heads[1:sec - 1], lambda x: length(x))), 0))::BIGINT AS begin FROM html_at)""",
        f"""html AS (SELECT doc_id, sec, CASE WHEN sec = 0 THEN 4 ELSE substr(h, 3, 1)::INT END AS level,
  CASE WHEN sec > 0 THEN {strip("regexp_replace(regexp_extract(h, '(?is)^<h[23][^>]*>(.*)</h[23]>$', 1), '<[^>]+>', '', 'g')")} END AS heading,
  {clean} AS content, CASE WHEN sec = 0 THEN 0 ELSE begin END AS char_start,
  CASE WHEN sec = 0 THEN length(c) ELSE begin + length(h) + length(c) END AS char_end,
  len(heads) AS n_heads FROM html_pos)""",
        """sections AS MATERIALIZED (
  SELECT doc_id, sec, level, heading, content, char_start, char_end FROM md WHERE content <> ''
  UNION ALL SELECT doc_id, sec, level, heading, content, char_start, char_end FROM html WHERE content <> '')""",
        # Flat chunks: plain documents and those without any section
        """flat_docs AS (SELECT doc_id, text FROM tagged t WHERE strategy = 'flat'
  OR (strategy = 'markdown' AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = t.doc_id))
  OR (strategy = 'html' AND NOT EXISTS (SELECT 1 FROM html s WHERE s.doc_id = t.doc_id AND (n_heads > 0 OR content <> ''))))""",
        f"bodies AS MATERIALIZED (SELECT doc_id, {strip('text')} AS body FROM flat_docs)",
        f"""sent AS MATERIALIZED (SELECT doc_id, i, s, {tokens('s')} AS tok FROM (
  SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (SELECT doc_id, {pieces('body')} AS ss FROM bodies)))""",
        _recursive_pack("packed", "sent", "doc_id", "tok", S.TARGET_TOKENS),
        """flat AS MATERIALIZED (SELECT doc_id, piece AS chunk_index, string_agg(s, ' ' ORDER BY i) AS text, sum(tok)::INT AS token_count
  FROM packed JOIN sent USING (doc_id, i) GROUP BY doc_id, piece)""",
        *_offsets(),
        # Section chunks
        f"""long_lead AS (SELECT doc_id, sec, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (
  SELECT doc_id, sec, {pieces('content')} AS ss FROM sections WHERE level = 4 AND {words('content')} > {S.ATOMIC_MAX_WORDS}))""",
        f"lead_sent AS MATERIALIZED (SELECT *, {words('s')} AS w FROM long_lead)",
        _recursive_pack("lead_packed", "lead_sent", "doc_id, sec", "w", S.ATOMIC_MAX_WORDS),
        """lead AS (SELECT doc_id, sec, piece, string_agg(s, ' ' ORDER BY i) AS text FROM lead_packed JOIN lead_sent USING (doc_id, sec, i) GROUP BY ALL)""",
        """cut AS (SELECT doc_id, sec, 0 AS piece, content AS text FROM sections s
  WHERE NOT EXISTS (SELECT 1 FROM lead l WHERE l.doc_id = s.doc_id AND l.sec = s.sec) UNION ALL SELECT * FROM lead)""",
        """tree AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.sec, c.piece) - 1 AS chunk_index,
  c.text, s.char_start, s.char_end, s.level AS lv, s.heading FROM cut c JOIN sections s USING (doc_id, sec))""",
        f"""chunk_rows AS MATERIALIZED (
  SELECT doc_id, chunk_index::INT AS chunk_index, text, token_count, 'flat' AS level, NULL::VARCHAR AS heading,
         NULL::INT AS parent_index, 0 AS depth, char_start::INT AS char_start, char_end::INT AS char_end FROM flat JOIN flat_placed USING (doc_id, chunk_index)
  UNION ALL
  SELECT doc_id, chunk_index::INT, text, {tokens('text')}::INT, CASE lv WHEN 2 THEN 'macro' WHEN 3 THEN 'micro' ELSE 'atomic' END,
         heading, CASE WHEN lv = 3 THEN max(CASE WHEN lv = 2 THEN chunk_index END) OVER (
           PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END::INT,
         lv - 2, char_start::INT, char_end::INT FROM tree)""",
        f"""chunks AS MATERIALIZED (SELECT r.*, scope, length(d.text) AS document_char_count,
  (count(*) OVER (PARTITION BY r.doc_id))::INT AS chunk_count,
  {preview('r.text', S.PREVIEW_CHARS)} AS text_preview, {preview('r.text', S.TARGET_PREVIEW_CHARS)} AS target_preview,
  {preview('r.text', S.EXAMPLE_CHARS)} AS example_text, length(r.text) AS char_count, {words('r.text')} AS word_count
  FROM chunk_rows r JOIN docs d USING (doc_id))""",
    ]


def _offsets() -> list[str]:
    gap = r"length(regexp_extract(substr(body, {e} + 1), '^[ \n\t]*'))"
    end = "(p.start + p.len)"
    return [
        f"""placed AS (
  SELECT doc_id, chunk_index, 0 AS start, length(text) AS len FROM flat WHERE chunk_index = 0
  UNION ALL
  SELECT p.doc_id, f.chunk_index, {end} + {gap.format(e=end)}, length(f.text)
  FROM placed p JOIN bodies b ON b.doc_id = p.doc_id JOIN flat f ON f.doc_id = p.doc_id AND f.chunk_index = p.chunk_index + 1)""",
        """flat_placed AS (SELECT doc_id, chunk_index, start AS char_start, least(start + len, length(body)) AS char_end
  FROM placed JOIN bodies USING (doc_id))""",
    ]


def _topics(below: int | None = None) -> str:
    rows = ", ".join(f"({i}::BIGINT, {lit(q)}, {lit(s)}, {lit(o)})" for i, q, s, o in TOPICS if below is None or i < below)
    return f"topics(query_id, query, scope, intent_override) AS (VALUES {rows})"


def topic_rows(below: int) -> list[str]:
    return [_topics(below)]


def _bucket(w: str) -> str:
    return f"(('0x' || substr(md5({w}), 1, 8))::BIGINT % {DIM})::INT"


def _terms(source: str, keys: str, text: str) -> str:
    return (
        f"SELECT {keys}, {_bucket('w')} AS b, count(*) AS n FROM (SELECT {keys}, "
        f"unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}) GROUP BY ALL"
    )


def _band_columns(words_of: str) -> str:
    short, std = S.SHORT_QUERY_BANDS, S.STANDARD_BANDS
    test = f"{words_of} <= {S.SHORT_QUERY_MAX_WORDS}"
    return ", ".join(f"CASE WHEN {test} THEN {short[k]}::DOUBLE ELSE {std[k]}::DOUBLE END AS {k}" for k in std)


INTERPRET = (
    "CASE WHEN similarity >= strong THEN 'Strong' WHEN similarity >= moderate THEN 'Moderate' "
    "WHEN similarity >= weak THEN 'Weak' ELSE 'Off-topic' END"
)


def _scored() -> list[str]:
    return [
        _topics(),
        f"query_bands AS (SELECT *, {words('query')} AS query_words, {_band_columns(words('query'))} FROM topics)",
        f"qtf AS MATERIALIZED ({_terms('topics', 'query_id, scope', 'query')})",
        "qnorm AS (SELECT query_id, sum(n * n) AS sq FROM qtf GROUP BY 1)",
        f"tf AS MATERIALIZED ({_terms('chunks', 'doc_id, scope, chunk_index', 'text')})",
        "cnorm AS (SELECT doc_id, chunk_index, sum(n * n) AS sq FROM tf GROUP BY ALL)",
        """dots AS (SELECT q.query_id, t.doc_id, t.chunk_index, sum(q.n * t.n) AS d FROM tf t
  JOIN qtf q ON q.scope = t.scope AND q.b = t.b GROUP BY ALL)""",
        f"""scored AS MATERIALIZED (SELECT *, {INTERPRET} AS interpretation FROM (
  SELECT q.query_id, c.*, q.strong, q.moderate, q.weak,
    CASE WHEN n.sq IS NULL THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
      coalesce(d.d, 0)::DOUBLE / (sqrt(qn.sq::DOUBLE) * sqrt(n.sq::DOUBLE)))) END AS similarity
  FROM chunks c JOIN query_bands q USING (scope) JOIN qnorm qn USING (query_id)
  LEFT JOIN cnorm n USING (doc_id, chunk_index)
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.doc_id = c.doc_id AND d.chunk_index = c.chunk_index))""",
    ]


def coverage_of(strong: str, moderate: str, weak: str, off: str, total: str) -> str:
    return f"({strong} * 1.0::DOUBLE + {moderate} * 0.6::DOUBLE + {weak} * 0.2::DOUBLE + {off} * 0.0::DOUBLE) / {total} * 100.0::DOUBLE"


COVERAGE_LABEL = label("coverage_score", S.COVERAGE_LABELS, S.COVERAGE_FLOOR_LABEL)
_COUNTS = """count(*) FILTER (similarity >= strong) AS chunks_strong,
  count(*) FILTER (similarity >= moderate AND similarity < strong) AS chunks_moderate,
  count(*) FILTER (similarity >= weak AND similarity < moderate) AS chunks_weak,
  count(*) FILTER (similarity < weak) AS chunks_off_topic"""


def _reports() -> list[str]:
    section_score = coverage_of("chunks_strong", "chunks_moderate", "chunks_weak", "chunks_off_topic", "chunk_count")
    score = coverage_of("chunks_strong", "chunks_moderate", "chunks_weak", "chunks_off_topic", "total_chunks")
    potential = coverage_of("chunks_strong", "(chunks_moderate + chunks_weak)", "chunks_off_topic", "0", "total_chunks")
    return [
        """diag AS MATERIALIZED (SELECT *,
  row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, chunk_index) AS similarity_rank,
  CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (similarity - lo) / (hi - lo) END AS normalized_score,
  CASE WHEN chunk_count > 1 THEN chunk_index::DOUBLE / (chunk_count - 1) ELSE 0.0::DOUBLE END AS position_percent,
  similarity = hi AS is_max, similarity = lo AS is_min, similarity >= strong AS above_strong_threshold,
  similarity >= moderate AS above_moderate_threshold, similarity < weak AS below_weak_threshold
  FROM (SELECT *, max(similarity) OVER w AS hi, min(similarity) OVER w AS lo FROM scored WINDOW w AS (PARTITION BY query_id, doc_id)))""",
        f"""sec_members AS (SELECT s.*, s.chunk_index AS section_index FROM scored s WHERE level IN ('macro', 'micro')
  UNION ALL SELECT s.*, s.parent_index FROM scored s WHERE parent_index IS NOT NULL)""",
        f"""sec_all AS (SELECT query_id, doc_id, section_index,
  max(CASE WHEN chunk_index = section_index THEN heading END) AS heading,
  max(CASE WHEN chunk_index = section_index AND level IN ('macro', 'micro') THEN level END) AS level,
  count(*) AS chunk_count, avg(similarity) AS avg_similarity, max(similarity) AS max_similarity,
  min(similarity) AS min_similarity, sum(word_count)::BIGINT AS total_words, {_COUNTS} FROM sec_members GROUP BY ALL)""",
        f"secs AS MATERIALIZED (SELECT *, {section_score} AS coverage_score FROM sec_all WHERE level IS NOT NULL)",
        f"""low_secs AS (SELECT query_id, doc_id, count(*) AS low_sections FROM secs
  WHERE coverage_score < {S.LOW_SECTION_COVERAGE} GROUP BY ALL)""",
        f"""agg AS (SELECT query_id, doc_id, count(*) AS total_chunks, max(similarity) AS max_similarity, min(similarity) AS min_similarity,
  avg(similarity) AS avg_similarity, coalesce(stddev_samp(similarity), 0.0) AS std_similarity, median(similarity) AS median_similarity,
  {_COUNTS}, sum(token_count)::INT AS document_token_count, max(document_char_count) AS document_char_count,
  min(chunk_index) FILTER (is_max) AS best_chunk_index, max(strong) AS strong, max(moderate) AS moderate, max(weak) AS weak,
  bool_or(level <> 'flat') AS is_hierarchical,
  count(*) FILTER (position_percent <= 0.2) AS band_n, avg(similarity) FILTER (position_percent <= 0.2) AS band_avg,
  count(*) FILTER (chunk_index < 3) AS head_n, avg(similarity) FILTER (chunk_index < 3) AS head_avg FROM diag GROUP BY ALL)""",
        f"""scores AS (SELECT *, {score} AS coverage_score, {potential} AS potential_ccs,
  chunks_strong * 1.0::DOUBLE + chunks_moderate * 0.6::DOUBLE + chunks_weak * 0.2::DOUBLE + chunks_off_topic * 0.0::DOUBLE AS weighted_sum
  FROM agg)""",
        f"""facts AS MATERIALIZED (SELECT s.*, {COVERAGE_LABEL} AS coverage_label, round_even(coverage_score, 0)::INT AS coverage_rounded,
  total_chunks = 1 AS is_single_chunk, chunks_strong / total_chunks * 100.0 AS percent_strong,
  (total_chunks - chunks_off_topic) / total_chunks * 100.0 AS percent_on_topic,
  CASE WHEN total_chunks > 1 THEN best_chunk_index::DOUBLE / (total_chunks - 1) ELSE 0.0 END AS best_position,
  CASE WHEN band_n >= 2 THEN band_n ELSE head_n END AS intro_chunks,
  CASE WHEN band_n >= 2 THEN band_avg ELSE head_avg END AS intro_similarity,
  CASE WHEN chunks_strong > 0 THEN (SELECT example_text FROM diag d WHERE d.query_id = s.query_id AND d.doc_id = s.doc_id
     AND d.chunk_index = s.best_chunk_index) END AS best_example,
  coalesce(low_sections, 0) AS low_sections,
  chunks_off_topic::DOUBLE / total_chunks AS off_share, chunks_strong::DOUBLE / total_chunks AS strong_share,
  chunks_strong > 0 AND chunks_off_topic > 0 AND chunks_strong::DOUBLE / total_chunks >= {S.DILUTION_SHARE}
    AND chunks_off_topic::DOUBLE / total_chunks >= {S.DILUTION_SHARE} AS diluted
  FROM scores s LEFT JOIN low_secs USING (query_id, doc_id))""",
        f"""rec_rows AS (
  SELECT *, 0 AS rule, 'rewrite_off_topic' AS rec_type, CASE WHEN off_share > {S.OFF_TOPIC_HIGH_SHARE} THEN 1 ELSE 2 END AS ord,
    chunks_off_topic AS target_count, best_example AS example FROM facts WHERE chunks_off_topic > 0
  UNION ALL SELECT *, 1, 'strengthen_weak', 2, chunks_weak, best_example FROM facts WHERE chunks_weak > 0
  UNION ALL SELECT *, 2, 'expand_strong', 3, least(5, chunks_weak + chunks_off_topic), best_example FROM facts
    WHERE chunks_strong > 0 AND chunks_weak + chunks_off_topic > 0
  UNION ALL SELECT *, 3, 'restructure_section', 2, low_sections, NULL FROM facts WHERE low_sections > 0
  UNION ALL SELECT *, 4, 'remove_dilution', 3, least(5, chunks_off_topic), NULL FROM facts WHERE diluted)""",
        """recs AS MATERIALIZED (SELECT query_id, doc_id, position, rec_type, target_count, example AS example_text,
  ['high', 'medium', 'low'][ord] AS priority, ['High', 'Medium', 'Low'][ord] AS estimated_impact FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ord, target_count DESC, rule) AS position FROM rec_rows)
  WHERE position <= 5)""",
        f"""rec_targets AS (
  SELECT query_id, doc_id, 'rewrite_off_topic' AS rec_type, chunk_index, target_preview AS text_preview, similarity, interpretation
    FROM diag WHERE similarity < weak
  UNION ALL SELECT query_id, doc_id, 'strengthen_weak', chunk_index, target_preview, similarity, interpretation
    FROM diag WHERE similarity >= weak AND similarity < moderate
  UNION ALL SELECT query_id, doc_id, 'expand_strong', chunk_index, target_preview, similarity, interpretation FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS k FROM diag WHERE similarity < moderate) d
    WHERE k <= 5 AND EXISTS (SELECT 1 FROM facts f WHERE f.query_id = d.query_id AND f.doc_id = d.doc_id AND chunks_strong > 0)
  UNION ALL SELECT query_id, doc_id, 'remove_dilution', chunk_index, target_preview, similarity, interpretation FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS k FROM diag WHERE similarity < weak) d
    WHERE k <= 5 AND EXISTS (SELECT 1 FROM facts f WHERE f.query_id = d.query_id AND f.doc_id = d.doc_id AND diluted)
  UNION ALL SELECT query_id, doc_id, 'restructure_section', chunk_index, target_preview, similarity, interpretation FROM diag d
    WHERE EXISTS (SELECT 1 FROM secs s WHERE s.query_id = d.query_id AND s.doc_id = d.doc_id
      AND s.section_index = d.chunk_index AND s.coverage_score < {S.LOW_SECTION_COVERAGE}))""",
    ]


def intent(c: str) -> str:
    low = f"lower({strip(c)})"
    return (
        f"CASE WHEN regexp_matches({low}, '{border(S.HOW_TO_WORDS, '')}') THEN 'how_to' "
        f"WHEN regexp_matches({low}, '{border(S.COMMERCIAL_WORDS, '')}') THEN 'commercial' ELSE 'informational' END"
    )


def terms(source: str) -> list[str]:
    """CTEs ``term_rows`` (query_id, k, term): up to eight terms per query in their order."""
    stop = ", ".join(lit(w) for w in S.TERM_STOP_WORDS)
    return [
        f"""raw_terms AS (SELECT query_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS term FROM (
  SELECT query_id, string_split_regex(lower(query), '[^a-zA-Z0-9]+') AS ws FROM {source}))""",
        f"""first_terms AS (SELECT query_id, term, min(i) AS i FROM raw_terms
  WHERE length(term) >= {S.TERM_MIN_CHARS} AND term NOT IN ({stop}) GROUP BY ALL)""",
        f"""term_rows AS MATERIALIZED (SELECT * FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) AS k
  FROM first_terms) WHERE k <= {S.MAX_TERMS})""",
    ]


def _signals() -> list[str]:
    def any_line(pattern: str) -> str:
        return f"coalesce(bool_or(regexp_matches(line, '{pattern}')), false)"

    def opening(n: int) -> str:
        return f"array_to_string(string_split_regex({strip('text')}, '[{WS}]+')[1:{n}], ' ')"

    heading = rf"^(?:[{INL}]{{0,3}}#+[{INL}]*|[{INL}]*)"
    return [
        f"""text_lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM (
  SELECT doc_id, CASE WHEN u = '' THEN [] WHEN ends_with(u, chr(10)) THEN ls[1:-2] ELSE ls END AS ls FROM (
    SELECT doc_id, u, string_split(u, chr(10)) AS ls FROM (
      SELECT doc_id, regexp_replace(text, '{LINE_END}', chr(10), 'g') AS u FROM docs))))""",
        f"""fenced AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS fences FROM (
  SELECT *, regexp_matches(line, '^[{INL}]*```') AS fence FROM text_lines))""",
        """code_free AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS line_no, line
  FROM fenced WHERE NOT fence AND fences % 2 = 0)""",
        rf"""line_signals AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '\p{{Nd}}')) AS numbered,
  count(*) FILTER (regexp_matches(line, '^[{INL}]*##[{INL}]+[^{WS}]')) AS h2,
  count(*) FILTER (regexp_matches(line, '^[{INL}]*###[{INL}]+[^{WS}]')) AS h3,
  sum(len(regexp_extract_all(line, '\[[^\]]+\]\(https?://[^)]+\)')))::BIGINT AS links,
  count(*) FILTER (regexp_matches(line, '^[{INL}]*\|.*\|[{INL}]*$')) AS tables,
  {any_line(border('FAQ') + '|(?i)frequently asked questions')} AS has_faq,
  {any_line('(?i)' + heading + f'(?:{S.SOURCES_HEADINGS})[{INL}]*$')} AS has_sources_section,
  {any_line(f'(?i)^[{INL}]*(?:step[{INL}]+[0-9]+|[0-9]+[.])[{INL}]')} AS has_steps,
  {any_line(border('for example') + r"|(?i)(^|[^\p{L}\p{N}_])(?:e[.]g[.]|example:)[\p{L}\p{N}_]")} AS has_examples,
  {any_line(border('vs[.]?|versus|compare|comparison|alternatives?') + r"|(?i)(^|[^\p{L}\p{N}_])vs[.][\p{L}\p{N}_]")} AS has_comparison_language
  FROM code_free GROUP BY doc_id)""",
        rf"""doc_signals AS MATERIALIZED (SELECT doc_id, scope, {words('text')} AS word_count,
  coalesce(h2, 0) + len(regexp_extract_all(text, '(?i)<h2(?:[^a-z0-9_]|$)')) AS h2_count,
  coalesce(h3, 0) + len(regexp_extract_all(text, '(?i)<h3(?:[^a-z0-9_]|$)')) AS h3_count,
  greatest(coalesce(links, 0), len(regexp_extract_all(text, 'https?://[^{WS})]+'))) AS link_count,
  coalesce(tables, 0) AS table_like_lines, coalesce(has_faq, false) AS has_faq,
  regexp_matches(substr(text, 1, {S.TLDR_CHARS}), '{border('TL;?DR|Summary')}') AS has_tldr,
  coalesce(has_sources_section, false) AS has_sources_section, coalesce(has_steps, false) AS has_steps,
  coalesce(has_examples, false) AS has_examples, coalesce(has_comparison_language, false) AS has_comparison_language,
  regexp_matches(substr(text, 1, {S.FRESHNESS_CHARS}), '{border('updated|last updated|as of|new in|20[12][0-9]')}') AS has_freshness_signals,
  coalesce(numbered, 0)::DOUBLE / greatest(coalesce(n_lines, 0), 1) AS numeric_density,
  {opening(S.DEFINITION_WORDS)} AS top_text, lower({opening(S.INTRO_WORDS)}) AS intro_text
  FROM docs LEFT JOIN line_signals USING (doc_id))""",
        *terms("topics"),
        f"""intents AS (SELECT query_id, scope, CASE WHEN intent_override IS NULL OR intent_override = 'auto' THEN {intent('query')}
  ELSE intent_override END AS intent FROM topics)""",
        """term_hits AS (SELECT t.query_id, d.doc_id, count(*) AS n, count(*) FILTER (contains(intro_text, term)) AS in_intro,
  bool_or(contains(lower(top_text), term)) AS in_top FROM doc_signals d JOIN topics q USING (scope)
  JOIN term_rows t ON t.query_id = q.query_id GROUP BY ALL)""",
        f"""signals AS MATERIALIZED (SELECT d.* EXCLUDE (top_text, intro_text, scope), i.query_id, i.intent,
  coalesce(in_top, false) AND regexp_matches(top_text, '{border('is|are|refers to|means')}') AS has_definition_near_top,
  CASE WHEN n > 0 THEN in_intro::DOUBLE / n ELSE 0.0 END AS intro_query_term_coverage
  FROM doc_signals d JOIN intents i USING (scope) LEFT JOIN term_hits h ON h.query_id = i.query_id AND h.doc_id = d.doc_id)""",
    ]


def signal_steps() -> list[str]:
    return _signals()


def _steps() -> list[str]:
    def step(no: int, name: str, cond: str, order: str, minutes: int, targets: str = "0") -> str:
        return (
            f"SELECT query_id, doc_id, {no} AS rule, {lit(name)} AS step, {order} AS ord, {minutes} AS minutes, "
            f"{targets} AS target_count FROM reports WHERE {cond}"
        )

    def below(n: int, high: int = 1) -> str:
        return f"CASE WHEN coverage_score < {n} THEN {high} ELSE {high + 1} END"

    rows = [
        step(0, "front_load", "intro_query_term_coverage < 0.5 OR best_position > 0.4 OR intro_similarity + 0.05::DOUBLE < avg_similarity",
             "1", 15, "least(3, total_chunks)"),
        step(1, "add_definition", "intent IN ('informational', 'how_to') AND NOT has_definition_near_top", below(70), 10),
        step(2, "reduce_drift", "off_share >= 0.10::DOUBLE", "CASE WHEN off_share >= 0.15::DOUBLE THEN 1 ELSE 2 END", 20, "least(5, chunks_off_topic)"),
        step(3, "strengthen_weak", "chunks_weak > 0", "2", 25, "least(5, chunks_weak)"),
        step(4, "add_steps", "intent = 'how_to' AND NOT has_steps", below(70), 25),
        step(5, "add_comparison", "intent = 'commercial' AND NOT has_comparison_language AND word_count >= 400", "2", 30),
        step(6, "add_headings", "h2_count = 0 AND h3_count = 0 AND word_count >= 400", "2", 20),
        step(7, "add_evidence", "(link_count = 0 OR NOT has_sources_section) AND word_count >= 300", "2", 15),
        step(8, "add_examples", "NOT has_examples AND word_count >= 400", below(80, 2), 15),
        step(9, "add_faq", "NOT has_faq AND word_count >= 500", below(70, 2), 25),
        step(10, "add_summary_box", "NOT has_tldr AND word_count >= 700", "3", 10),
    ]
    return [
        "reports AS MATERIALIZED (SELECT * FROM facts JOIN signals USING (query_id, doc_id))",
        "step_rows AS (" + " UNION ALL ".join(rows) + ")",
        f"""steps AS MATERIALIZED (SELECT query_id, doc_id, position, minutes, step, target_count, ['high', 'medium', 'low'][ord] AS priority FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ord, minutes, rule) AS position FROM step_rows)
  WHERE position <= {S.MAX_NEXT_STEPS})""",
        readiness_steps("reports"),
    ]


def readiness_steps(reports: str) -> str:
    structure = (
        "0.0::DOUBLE + CASE WHEN h2_count >= 2 THEN 0.35::DOUBLE WHEN h2_count = 1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN h3_count >= 1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN has_tldr THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN has_faq THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN has_steps OR intent <> 'how_to' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
    )
    evidence = (
        "0.0::DOUBLE + CASE WHEN link_count >= 2 THEN 0.4::DOUBLE WHEN link_count = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN has_sources_section THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN has_examples THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
        " + CASE WHEN numeric_density >= 0.2::DOUBLE THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    )
    answer = (
        "0.0::DOUBLE + CASE WHEN has_definition_near_top THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"
        " + 0.4::DOUBLE * intro_query_term_coverage + CASE WHEN best_position <= 0.4::DOUBLE THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
    )
    return f"""parts AS (SELECT query_id, doc_id, coverage_score / 100.0::DOUBLE AS c, least({structure}, 1.0::DOUBLE) AS s,
  least({evidence}, 1.0::DOUBLE) AS e, least({answer}, 1.0::DOUBLE) AS a FROM {reports}),
ready AS (SELECT *, 100.0::DOUBLE * (0.0::DOUBLE + 0.5::DOUBLE * c + 0.2::DOUBLE * s + 0.15::DOUBLE * e + 0.15::DOUBLE * a) AS score FROM parts)"""


def _prelude(corpus: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(
        [*_chunks(corpus), *_scored(), *_reports(), *_signals(), *_steps()]
    )


PRELUDES = {corpus: _prelude(corpus) for corpus in CORPORA}


def on(corpus: str, select: str) -> str:
    return f"{PRELUDES[corpus]}\n{select}"
