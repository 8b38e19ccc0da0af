"""DuckDB SQL for the core queries, over the tables registered as views.

Written independently of the operators: regular expressions without look-around, lists and windows. Queries
that SQL cannot express on whole tables (fuzzy similarity, greedy choices, lenient reading of broken rows)
have none; tests hold them against brute force.
"""

from __future__ import annotations

#: White space of any kind, for use inside a bracket.
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"\p{L}\p{N}_"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace(coalesce({x}, ''), '[{_WS}]+', ' ', 'g')")


def _norm(x: str) -> str:
    return _squeeze(f"lower(coalesce({x}, ''))")


def _quote(x: str) -> str:
    return f"'\"' || replace(coalesce({x}, ''), '\"', '\"\"') || '\"'"


def _units(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[{_W}]+|[^{_W}{_WS}]'))"


def _tokens(x: str) -> str:
    return f"CASE WHEN {_units(x)} = 0 THEN 0 ELSE greatest(1, floor({_units(x)} * 1.25)::INT) END"


def _lines(x: str) -> str:
    """Lines of a text whose line breaks are those of chunks and documents."""
    same = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '\\n$', '')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN []::VARCHAR[] ELSE string_split({same}, chr(10)) END"


def _sentences(x: str) -> str:
    out = _squeeze(x)
    for a in ("et al.", "e.g.", "i.e.", "etc.", "mrs.", "fig.", "tab.", "ref.", "vs.", "dr.", "mr.", "ms.", "eq.", "al."):
        out = f"regexp_replace({out}, '{a.replace('.', chr(92) + '.')}', '{a.replace('.', '<DOT>')}', 'gi')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1<DECIMAL>\\2', 'g')"
    out = f"string_split(regexp_replace({out}, '([.!?])[{_WS}]+([A-Z0-9(\\[\"''])', '\\1<SEP>\\2', 'g'), '<SEP>')"
    return f"list_filter(list_transform({out}, lambda s: replace(replace({_strip('s')}, '<DECIMAL>', '.'), '<DOT>', '.')), lambda s: s <> '')"


_NOISY = "'<!-- page ' || chunk_id || ' -->' || chr(10) || '12 www.example.org/' || chunk_id || chr(10) || 'x' || chr(10) || '===' || chr(10) || coalesce(text, '') || ' (n = 2000) [1, 2-4] word- , end &amp;lt; /uniFB01 ne' || repeat(chr(10), 4) || '3.5' || chr(10) || '- ' || chr(10) || 'last'"


def _clean(expr: str) -> str:
    return f"SELECT chunk_key, {expr.replace('{t}', 't')} AS cleaned FROM (SELECT chunk_key, {_NOISY} AS t FROM chunks)"


def _line_filter(test: str) -> str:
    return _clean(f"array_to_string(list_filter({_lines('{t}')}, lambda x: {test}), chr(10))")


_FIELD = r'[ \t\r\n]*"(?:[^"]|"")*"[ \t\r\n]*|[^",]*'
_P6 = f"""
raw AS (
  SELECT 'label_lines' AS src, label_id AS row_id, 0 AS line_no, raw_line AS raw, 4 AS n FROM label_lines WHERE raw_line IS NOT NULL
  UNION ALL SELECT 'eval_preds', pair_id, i, l[i], 3 FROM (SELECT pair_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT pair_id, string_split(pred, chr(10)) AS l FROM eval_preds WHERE pred IS NOT NULL))),
rows_ AS (SELECT * FROM raw WHERE {_strip('raw')} NOT IN ('', '### END')),
judged AS (
  SELECT *, regexp_full_match(raw, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS quoted,
    -- commas and quotes inside quoted fields are hidden, then fields are split
    list_transform(string_split(list_reduce(list_transform(string_split(raw, '"'), lambda p, i: CASE WHEN i % 2 = 0 THEN replace(replace(p, '~', '~t'), ',', '~c') WHEN p = '' AND i > 1 AND i < len(string_split(raw, '"')) THEN '~q' ELSE replace(p, '~', '~t') END), lambda a, b: a || b), ','),
      lambda f: replace(replace(replace(regexp_replace(f, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '~c', ','), '~q', '"'), '~t', '~')) AS f
  FROM rows_),
reasoned AS (
  SELECT *, CASE WHEN NOT quoted THEN 'broken_quoting' WHEN len(f) <> n THEN 'column_count'
    WHEN upper(f[2]) NOT IN ('MIE', 'KE', 'AO') OR NOT regexp_matches(f[1], '[^{_WS}]') OR NOT regexp_matches(f[3], '[^{_WS}]')
      OR len(list_filter(f, lambda x: regexp_matches(x, '[\\x{{FFFD}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]'))) > 0 THEN 'invalid_value' END AS reason
  FROM judged)"""

_MATCHES = """m AS (SELECT paper_stem AS doc_id, event_id, ['sentences', 'lines', 'paragraphs', 'chunks'][chunk_id % 4 + 1] AS kind, chunk_id % 4 AS rank, event_key AS pos, chemical, description AS text, score FROM chunk_events)"""
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, event_id ORDER BY score DESC NULLS LAST, rank, pos) AS r FROM m WHERE event_id IS NOT NULL {0}) WHERE r = 1)"""

_VALID = f"""named AS (
  SELECT paper_stem, chunk_id, event_key AS pos, {_squeeze("CASE WHEN matched_chemical_variant <> '' THEN matched_chemical_variant ELSE chemical END")} AS chemical,
    upper({_strip("coalesce(event_type, '')")}) AS event_type, {_squeeze('description')} AS description FROM chunk_events),
ok AS (SELECT * FROM named WHERE event_type IN ('MIE', 'KE', 'AO') AND chemical <> '' AND description <> ''),
valid AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY paper_stem, chunk_id, lower(chemical), event_type, lower(description) ORDER BY pos) AS r FROM ok) WHERE r = 1)"""
_EXAMPLES = f"""{_VALID},
texts AS (SELECT paper_stem, chunk_id, {_strip("coalesce(arg_min(text, chunk_key), '')")} AS chunk_text FROM (SELECT * FROM chunks WHERE text IS NOT NULL) GROUP BY 1, 2),
listed AS (SELECT paper_stem, chunk_id, count(*) AS n_events, string_agg({_quote('chemical')} || ',' || {_quote('event_type')} || ',' || {_quote('description')}, chr(10) ORDER BY pos) AS body,
    count(*) FILTER (event_type = 'MIE') AS "MIE", count(*) FILTER (event_type = 'KE') AS "KE", count(*) FILTER (event_type = 'AO') AS "AO" FROM valid GROUP BY 1, 2),
ex AS (SELECT t.paper_stem, t.chunk_id, t.chunk_text, coalesce(n_events, 0) AS n_events, n_events IS NOT NULL AS positive, coalesce(body || chr(10), '') || '### END' AS answer,
    coalesce("MIE", 0) AS "MIE", coalesce("KE", 0) AS "KE", coalesce("AO", 0) AS "AO" FROM texts t LEFT JOIN listed l USING (paper_stem, chunk_id) WHERE chunk_text <> '')"""
_SPLIT = """papers_ AS (SELECT DISTINCT paper_stem FROM papers WHERE paper_stem IS NOT NULL),
ranked AS (SELECT paper_stem, row_number() OVER (ORDER BY md5('42|' || paper_stem), paper_stem) AS r, count(*) OVER () AS n FROM papers_),
split AS (SELECT paper_stem, CASE WHEN n > 1 AND r <= greatest(1, floor(n * 0.15)) THEN 'test' ELSE 'train' END AS split FROM ranked)"""
_SAMPLED = f"""{_EXAMPLES}, {_SPLIT},
placed AS (SELECT ex.*, split, sum(positive::INT) OVER (PARTITION BY split) AS n_pos, row_number() OVER (PARTITION BY split, positive ORDER BY md5('1041|' || paper_stem || '|' || chunk_id), paper_stem, chunk_id) AS r FROM ex JOIN split USING (paper_stem)),
sampled AS (SELECT * FROM placed WHERE positive OR r <= floor(n_pos * 0.5)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('43|' || paper_stem || '|' || chunk_id), paper_stem, chunk_id) AS line_no FROM sampled)"""

_SPANS = """s AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS pos, l_returnflag || repeat('x', (l_partkey % 9)::INT) AS text, floor(l_quantity / 10) + 6.0 AS size,
  (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, (l_partkey % 500 + 120)::DOUBLE AS x1, (l_suppkey % 50 + 12)::DOUBLE AS y1 FROM lineitem)"""
_DOMINANT = f"""{_SPANS},
sums AS (SELECT doc_id, size, sum(length(text)) AS chars, min(page * 1000 + pos) AS first FROM s GROUP BY 1, 2),
dom AS (SELECT doc_id, size AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first, size) AS r FROM sums) WHERE r = 1)"""
_NEAR = f"""{_DOMINANT},
sized AS (SELECT * FROM s JOIN dom USING (doc_id)),
near AS (SELECT DISTINCT a.doc_id, a.page, a.pos FROM sized a JOIN sized b USING (doc_id, page) WHERE b.size >= b.dominant - 0.5
  AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1 + 3) > greatest(a.y0, b.y0 - 3)
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1 + 3) - greatest(a.y0, b.y0 - 3)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.2)"""

_LINES_OF = f"list_transform(list_filter(list_transform({_lines('{{c}}')}, lambda x: {_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(NO_EVENTS|NO\\s+EVENT\\s+IDENTIFIED|NO\\s+AOP\\s+IDENTIFIED|###\\s*END)$')), lambda x: {_squeeze('x')})"
_SECTION_LINES = f"""raw AS (SELECT doc_id, i - 1 AS pos, {_strip('l[i]')} AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_lines('text')} AS l FROM documents))),
ls AS (SELECT doc_id, pos, line, line LIKE '#%' AS heading, sum((line LIKE '#%')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_no FROM raw WHERE line <> '')"""
_BLACKLISTED = "regexp_matches({0}, '^(references|reference|bibliography|citations|citation|acknowledgements|acknowledgments|funding|conflicts of interest|conflict of interest|author contributions|ethical approval|supplementary materials|supplementary material)( |$)')"


def _sentence_like(t: str) -> str:
    return f"({_strip(t)} <> '' AND (regexp_matches({_strip(t)}, '[.!?]$') OR (len(string_split({_squeeze(t)}, ' ')) >= 6 AND regexp_matches({t}, '[a-z]')) OR regexp_matches(lower({t}), '(^|[^{_W}])(explains|shows|demonstrates|indicates|suggests|causes|leads)([^{_W}]|$)')))"


_SECTIONS = f"""{_SECTION_LINES},
sec AS (SELECT doc_id, section_no, {_strip("regexp_replace(max(line) FILTER (heading), '^#+', '')")} AS title, length(regexp_extract(max(line) FILTER (heading), '^#+')) AS level, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT heading), '') AS body FROM ls WHERE section_no > 0 GROUP BY 1, 2),
judged AS (SELECT *, NOT {_BLACKLISTED.format(_norm('title'))} AND (body <> '' OR {_sentence_like('title')}) AS kept FROM sec)"""


def _packed(parts: str, glue: str) -> str:
    """A fold over a list of texts: joined as long as they stay within 176 units."""
    cell = f"list_transform({parts}, lambda q: {{'done': []::VARCHAR[], 'cur': q, 'n': {_units('q')}}})"
    fold = f"list_reduce({cell}, lambda a, b: CASE WHEN a.n + b.n <= 176 THEN {{'done': a.done, 'cur': a.cur || {glue} || b.cur, 'n': a.n + b.n}} ELSE {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}} END)"
    return f"CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_append(({fold}).done, ({fold}).cur) END"


_CHUNKS = f"""{_SECTIONS},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS section_index FROM judged WHERE kept),
units AS (SELECT doc_id, section_index, title, level, unnest(range(1, len(u) + 1)) AS i, u FROM (SELECT doc_id, section_index, title, level, CASE WHEN {_strip('title')} = '' THEN []::VARCHAR[] ELSE ['## ' || {_strip('title')} || CASE WHEN regexp_matches({_strip('title')}, '[.!?:]$') THEN '' ELSE '.' END || chr(10)] END || flatten(list_transform(string_split({_strip('body')}, chr(10)), lambda y: {_sentences('y')})) AS u FROM k)),
clauses AS (SELECT doc_id, section_index, title, level, i, u[i] AS unit, CASE WHEN {_units('u[i]')} <= 176 THEN []::VARCHAR[] ELSE list_filter(list_transform(string_split(regexp_replace(u[i], '([;,:])[{_WS}]+', '\1<CUT>', 'g'), '<CUT>'), lambda y: {_strip('y')}), lambda y: y <> '') END AS c FROM units),
cut_ AS (SELECT doc_id, section_index, title, level, i, CASE WHEN len(c) = 0 THEN [unit] WHEN len(c) > 1 AND len(list_filter(c, lambda y: {_tokens('y')} >= {_tokens('unit')})) = 0 THEN {_packed('c', "' '")} ELSE {_packed("string_split(" + _squeeze('unit') + ", ' ')", "' '")} END AS parts FROM clauses),
whole AS (SELECT doc_id, section_index, title, level, flatten(list(parts ORDER BY i)) AS p FROM cut_ GROUP BY ALL),
rows_ AS (SELECT doc_id, section_index, title, level, unnest(range(1, len(t) + 1)) AS place, t FROM (SELECT doc_id, section_index, title, level, {_packed('p', "CASE WHEN right(a.cur, 1) = chr(10) THEN '' ELSE ' ' END")} AS t FROM whole)),
chunks_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, place) - 1 AS chunk_id, section_index, title AS section_title, level AS section_level, {_tokens('t[place]')} AS token_count, t[place] AS text FROM rows_)"""


ORACLE: dict[str, str] = {
    "p6_found": f"WITH {_P6} SELECT src, row_id, line_no, reason FROM reasoned WHERE reason IS NOT NULL",
    "p6_sound": f"WITH {_P6} SELECT src, row_id, line_no, f[1] AS chemical, upper(f[2]) AS event_type, f[3] AS description_short, CASE WHEN src = 'label_lines' THEN f[4] END AS description_long FROM reasoned WHERE reason IS NULL",
    "sentence_tokens_by_lang": f"""WITH s AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, unnest({_sentences('text')}) AS s FROM documents WHERE text IS NOT NULL)
SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sentences, sum({_tokens('s')})::BIGINT AS n_tokens FROM s GROUP BY lang""",
    "norm_text": f"SELECT chunk_key, {_norm('text')} AS normed FROM chunks",
    "csv_quote_lines": f"SELECT event_key, {_quote('chemical')} || ',' || {_quote('event_type')} || ',' || {_quote('description')} AS line FROM chunk_events",
    "text_measures": f"""SELECT doc_id, {_tokens('text')} AS n_tokens, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round_even(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(text), 6) END AS alnum_ratio,
 CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS preview, len(string_split(lower(coalesce(text, '')), 'receptor')) - 1 AS n_hits FROM documents""",
    "sentence_split": f"SELECT chunk_key, i - 1 AS pos, s[i] AS sentence FROM (SELECT chunk_key, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT chunk_key, {_sentences('text')} AS s FROM chunks))",
    "levenshtein_titles": "SELECT paper_stem, levenshtein(regexp_replace(title, '[^ -~]', '', 'g'), regexp_replace(short_title, '[^ -~]', '', 'g')) AS distance FROM papers",
    "clean_comments": _clean("regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"),
    "clean_meaningless_lines": _line_filter(f"length({_strip('x')}) <> 1"),
    "clean_bare_links": _line_filter(f"NOT regexp_matches(x, '(?i)^[{_WS}]*\\p{{Nd}}*[{_WS}]*(https?://[^{_WS}]+|www\\.[^{_WS}]+|[^{_WS}]+\\.[^{_WS}]+)[{_WS}]*$')"),
    "clean_artifacts": _line_filter(f"NOT regexp_matches({_strip('x')}, '^[-=·•*一、]+$')"),
    "clean_dehyphenate": _clean(f"regexp_replace({{t}}, '([{_W}])-\\n([{_W}])', '\\1\\2', 'g')"),
    "clean_linebreaks": """SELECT chunk_key, array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i = len(l) THEN '' WHEN (i = 1 AND l[i] = '') OR right(l[i], 1) IN ('.', '?', '!', ':') OR (i + 1 < len(l) AND l[i + 1] = '') THEN chr(10) ELSE ' ' END), '') AS cleaned
FROM (SELECT chunk_key, string_split(t, chr(10)) AS l FROM (SELECT chunk_key, """ + _NOISY + " AS t FROM chunks))",
    "clean_citations": _clean(
        f"regexp_replace(regexp_replace(regexp_replace({{t}}, '\\([{_WS}]*[A-Z][A-Za-z''\\-]+([{_WS}]+et[{_WS}]+al\\.)?,[{_WS}]*(19|20)\\p{{Nd}}{{2}}([{_WS}]*;[{_WS}]*[A-Z][A-Za-z''\\-]+([{_WS}]+et[{_WS}]+al\\.)?,[{_WS}]*(19|20)\\p{{Nd}}{{2}})*[{_WS}]*\\)', '', 'g'), '\\[[{_WS}]*\\p{{Nd}}+[{_WS}]*(-[{_WS}]*\\p{{Nd}}+)?[{_WS}]*(,[{_WS}]*\\p{{Nd}}+[{_WS}]*(-[{_WS}]*\\p{{Nd}}+)?[{_WS}]*)*\\]', '', 'g'), '(?i)\\([^()]*?(et[{_WS}]+al\\.?|(19|20)\\p{{Nd}}{{2}})[^()]*\\)', '', 'g')"
    ),
    "clean_whitespace": _clean(f"array_to_string(list_transform({_lines(chr(123) + 't2' + chr(125))}, lambda x: {_strip('x')}), chr(10))".replace("{t2}", "regexp_replace({t}, '\\n{3,}', chr(10) || chr(10), 'g')")),
    "clean_spacing": _clean(f"regexp_replace(regexp_replace({{t}}, '[{_WS}]+([.,;:!?])', '\\1', 'g'), ' {{2,}}', ' ', 'g')"),
    "clean_trailing_dashes": _clean(f"regexp_replace({{t}}, '([{_W}])-([{_WS}]|[.,;:!?])', '\\1\\2', 'g')"),
    "clean_coding": _clean("regexp_replace(replace(replace(replace(replace(replace(replace(replace(translate(nfc_normalize({t}), '–—−‒―μ', '-----µ'), ' /uniFB01 ', 'fi'), ' /uniFB01', ' fi'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&le;', '<='), '&ge;', '>='), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\p{Cf}]', '', 'g')"),
    "clean_tables": "SELECT chunk_key, 'before' || chr(10) || 'after' || chr(10) || '| no | table |' || chr(10) || section_title AS cleaned FROM chunks WHERE section_title IS NOT NULL",
    "heading_tests": f"""SELECT chunk_key, section_level > 0 AS is_heading, CASE WHEN section_level > 0 THEN {_strip('section_title')} ELSE {_strip('section_title')} END AS title, section_level AS level,
 {_BLACKLISTED.format(_norm('section_title'))} AS blacklisted, {_sentence_like('section_title')} AS sentence_like FROM chunks WHERE section_title IS NOT NULL""",
    "text_lines": f"WITH {_SECTION_LINES} SELECT doc_id, pos, line, heading, section_no FROM ls",
    "sections": f"WITH {_SECTIONS} SELECT * FROM judged",
    "chunk_pack": f"WITH {_CHUNKS} SELECT * FROM chunks_",
    "chunk_sizes": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(token_count) AS most_tokens, max(section_index) AS last_section FROM chunks_ GROUP BY 1",
    "document_blocks": f"""WITH {_CHUNKS},
blocks AS (SELECT doc_id, 'lines' AS kind, line AS text FROM ls WHERE NOT heading UNION ALL SELECT doc_id, 'sentences', unnest({_sentences('line')}) FROM ls WHERE NOT heading
 UNION ALL SELECT doc_id, 'paragraphs', body FROM sec UNION ALL SELECT doc_id, 'chunks', text FROM chunks_)
SELECT doc_id, kind, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY 1, 2""",
    "chemical_names": f"""WITH c AS (SELECT DISTINCT chemical FROM chunk_events WHERE chemical IS NOT NULL),
k AS (SELECT chemical, {_strip('chemical')} AS c, regexp_full_match(chemical, '(?s).* \\[.*\\]') AS sq, regexp_full_match(chemical, '(?s).* \\(.*\\)') AS rd, contains(chemical, ' / ') AS sl, regexp_full_match({_strip('chemical')}, '(?s).* \\(.*\\)') AS rd2 FROM c)
SELECT chemical,
 CASE WHEN sq THEN {_strip("regexp_extract(chemical, '(?s)^(.*) \\[', 1)")} WHEN rd THEN {_strip("regexp_extract(chemical, '(?s)^(.*) \\(', 1)")} WHEN sl THEN {_strip("string_split(chemical, ' / ')[1]")} ELSE c END AS base,
 CASE WHEN sq THEN {_strip("regexp_extract(chemical, '(?s)^.* \\[(.*)\\]$', 1)")} WHEN rd THEN {_strip("regexp_extract(chemical, '(?s)^.* \\((.*)\\)$', 1)")} WHEN sl THEN {_strip("substr(chemical, strpos(chemical, ' / ') + 3)")} END AS abbr,
 array_to_string(list_sort(list_distinct(list_filter(list_transform([c] || CASE WHEN rd2 THEN [regexp_extract(c, '(?s)^(.*) \\(', 1), regexp_extract(c, '(?s)^.* \\((.*)\\)$', 1)] ELSE []::VARCHAR[] END || CASE WHEN contains(c, ' / ') THEN string_split(c, ' / ') ELSE []::VARCHAR[] END, lambda x: {_norm('x')}), lambda x: x <> ''))), '|') AS names FROM k""",
    "wordbound_match": f"""SELECT event_key, chunk_key,
 {_squeeze('lower(chemical)')} <> '' AND regexp_matches(lower(coalesce(text, '')), '(^|[^{_W}])' || replace(regexp_escape({_squeeze('lower(chemical)')}), '\\ ', '[{_WS}]+') || '($|[^{_W}])') AS named,
 coalesce(description, '') <> '' AND contains({_norm('text')}, {_norm('description')}) AS exact
FROM chunk_events JOIN chunks USING (paper_stem, chunk_id)""",
    "best_match_per_event": f"WITH {_MATCHES}, {_BEST.format('')} SELECT doc_id, event_id, kind, pos, score FROM best",
    "score_range": f"WITH {_MATCHES} SELECT p.paper_stem AS doc_id, coalesce(min(score), 0.0) AS lowest, coalesce(max(score), 0.0) AS highest FROM papers p LEFT JOIN m ON m.doc_id = p.paper_stem GROUP BY 1",
    "unmatched_events": f"WITH {_MATCHES} SELECT paper_stem AS doc_id, line_no AS event_id, label_id FROM label_lines l WHERE NOT EXISTS (SELECT 1 FROM m WHERE score >= 68 AND m.doc_id = l.paper_stem AND m.event_id = l.line_no)",
    "events_by_chemical": f"""WITH {_MATCHES}, {_BEST.format('AND score >= 68')},
every AS (SELECT doc_id, event_id, arg_min_null(chemical, pos) AS chemical FROM m GROUP BY 1, 2),
missed AS (SELECT doc_id, event_id, coalesce(chemical, 'UNKNOWN') AS chemical FROM every e WHERE NOT EXISTS (SELECT 1 FROM m WHERE score >= 68 AND m.doc_id = e.doc_id AND m.event_id = e.event_id)),
both_ AS (SELECT doc_id, chemical, event_id, text FROM best WHERE chemical IS NOT NULL UNION ALL SELECT doc_id, chemical, event_id, NULL FROM missed)
SELECT doc_id, chemical, count(*) AS n_events, count(*) FILTER (text IS NULL) AS n_unmatched, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids FROM both_ GROUP BY 1, 2""",
    "report_rows": f"""WITH {_MATCHES}, {_BEST.format('AND score >= 68')},
e AS (SELECT paper_stem AS doc_id, event_id, arg_min(struct_pack(c := chemical, t := event_type, d := description), event_key) AS e FROM chunk_events GROUP BY 1, 2)
SELECT e.doc_id, e.event_id, coalesce(e.e.c, '') AS chemical, coalesce(e.e.t, '') AS event_type, coalesce(e.e.d, '') AS description, coalesce(b.score, 0.0) AS match_score, coalesce(b.text, '') AS matched_text
FROM e LEFT JOIN best b ON b.doc_id = e.doc_id AND b.event_id = e.event_id AND b.score > 0""",
    "placed_unmatched": f"""WITH {_MATCHES},
e AS (SELECT paper_stem AS doc_id, event_id, arg_min(struct_pack(c := chemical, k := chunk_id), event_key) AS e FROM chunk_events GROUP BY 1, 2),
k AS (SELECT DISTINCT paper_stem, chunk_id FROM chunks)
SELECT doc_id, event_id, chunk_id AS pos, 0.0::DOUBLE AS score, false AS chemical_found, coalesce(e.c, '') AS matched_variant FROM e JOIN k ON k.paper_stem = doc_id AND k.chunk_id = e.k
WHERE NOT EXISTS (SELECT 1 FROM m WHERE score >= 68 AND m.doc_id = e.doc_id AND m.event_id = e.event_id)""",
    "canonical_answers": f"""WITH s AS (SELECT pair_id, list_filter(list_transform({_lines('gold')}, lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM eval_preds),
r AS (SELECT pair_id, i, l[i] AS x FROM (SELECT pair_id, l, unnest(range(1, len(l) + 1)) AS i FROM s))
SELECT s.pair_id, coalesce(string_agg(x, chr(10) ORDER BY lower(x), i) FILTER (lower(x) NOT IN ('no_events', 'no event identified', 'no aop identified', '### end')), '') AS canonical, coalesce(string_agg(x, chr(10) ORDER BY x), '') AS target FROM s LEFT JOIN r USING (pair_id) GROUP BY 1""",
    "line_metrics": f"""WITH s AS (SELECT pair_id, {_LINES_OF.replace('{{c}}', 'gold').replace('{c}', 'gold')} AS g, {_LINES_OF.replace('{{c}}', 'pred').replace('{c}', 'pred')} AS p FROM eval_preds),
d AS (SELECT *, list_distinct(g) AS gs, list_distinct(p) AS ps, len(list_filter(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i])) AS same FROM s)
SELECT pair_id, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT::DOUBLE ELSE (g = p)::INT::DOUBLE END AS ordered_exact, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT::DOUBLE ELSE round_even(same::DOUBLE / len(g), 6) END AS ordered_line_acc,
 len(list_intersect(ps, gs)) AS tp, len(ps) - len(list_intersect(ps, gs)) AS fp, len(gs) - len(list_intersect(ps, gs)) AS fn FROM d""",
    "micro_prf": """WITH s AS (SELECT sum(set_counts.tp)::BIGINT AS tp, sum(set_counts.fp)::BIGINT AS fp, sum(set_counts.fn)::BIGINT AS fn FROM eval_preds),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM s)
SELECT tp, fp, fn, round_even(p, 6) AS precision, round_even(q, 6) AS recall, round_even(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r""",
    "loss_summary": "SELECT count(loss) AS n, round_even(avg(loss), 6) AS mean_loss, round_even(exp(avg(loss)), 4) AS perplexity FROM eval_preds",
    "prompt_passages": f"SELECT pair_id, {_strip('''CASE WHEN regexp_matches(coalesce(prompt, ''), '(?i)(?:^|\\n)Text:\\s*\\n') THEN regexp_replace(prompt, '(?is)^(?:.*?\\n)??Text:\\s*\\n', '') WHEN contains(lower(prompt), 'text:') THEN right(prompt, length(list_last(string_split(lower(prompt), 'text:')))) ELSE coalesce(prompt, '') END''')} AS passage FROM eval_preds",
    "merged_prompts": f"""WITH m AS (SELECT record_id, coalesce(list_filter(messages, lambda x: x.role = 'system')[-1].content, '') AS s, coalesce(list_filter(messages, lambda x: x.role = 'user')[-1].content, '') AS u, coalesce(list_filter(messages, lambda x: x.role = 'assistant')[-1].content, '') AS a FROM train_records)
SELECT record_id, {_strip("CASE WHEN s <> '' AND u <> '' THEN s || chr(10) || chr(10) || u ELSE s || u END")} AS user, a AS assistant FROM m""",
    "cosine_neighbours": """WITH n AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT a, b, round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine FROM n JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b""",
    "sorted_events": "SELECT event_key, chemical, event_type FROM chunk_events",
    "valid_events": f"WITH {_VALID} SELECT * FROM valid",
    "chunk_examples": f"WITH {_EXAMPLES} SELECT paper_stem, chunk_id, n_events, positive, answer, length('Extract the events of this text.' || chr(10) || chr(10) || 'Text:' || chr(10)) + length(chunk_text) AS prompt_chars FROM ex",
    "paper_split": f"WITH {_SPLIT} SELECT paper_stem, split FROM split",
    "kfold_assign": f"WITH {_SPLIT} SELECT paper_stem, ((r - 1) % 5)::INT AS fold FROM ranked",
    "fold_sizes": f"WITH {_SPLIT}, f AS (SELECT (r - 1) % 5 AS fold FROM ranked), k AS (SELECT unnest(range(0, 5)) AS run) SELECT run, CASE WHEN run = fold THEN 'test' ELSE 'train' END AS split, count(*) AS n_papers FROM f, k GROUP BY 1, 2",
    "negative_sample": f"WITH {_SAMPLED} SELECT paper_stem, chunk_id, split, positive FROM sampled",
    "numbered_examples": f"WITH {_SAMPLED} SELECT paper_stem, chunk_id, split, line_no FROM numbered",
    "split_stats": f"""WITH {_SAMPLED} SELECT coalesce(split, 'all') AS split, count(DISTINCT paper_stem) AS total_papers, count(*) AS total_chunks, count(*) FILTER (positive) AS total_positive_chunks, count(*) FILTER (NOT positive) AS total_negative_chunks,
 sum(n_events)::BIGINT AS total_events, round_even(avg(length(chunk_text)), 1) AS average_chunk_length, sum("MIE")::BIGINT AS "MIE", sum("KE")::BIGINT AS "KE", sum("AO")::BIGINT AS "AO" FROM sampled GROUP BY ROLLUP (split)""",
    "split_papers_info": f"WITH {_SAMPLED} SELECT split, paper_stem, paper_stem || '.json' AS filename, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS chunk_ids FROM numbered GROUP BY 1, 2",
    "record_papers": """WITH p AS (SELECT build_id, 'train' AS split, unnest(train.papers) AS p FROM split_info UNION ALL SELECT build_id, 'validation', unnest(validation.papers) FROM split_info UNION ALL SELECT build_id, 'test', unnest(test.papers) FROM split_info),
l AS (SELECT build_id, split, p.id AS paper_id, unnest(p.chunk_ids) AS line_no FROM p) SELECT record_id, paper_id FROM train_records JOIN l USING (build_id, split, line_no)""",
    "token_length_report": f"""WITH t AS (SELECT split, {_tokens("array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10))")} AS tokens FROM train_records WHERE messages IS NOT NULL)
SELECT split, count(*) AS n, min(tokens) AS shortest, max(tokens) AS longest, list_sort(list(tokens))[len(list(tokens)) // 2 + 1] AS median, count(*) FILTER (tokens > 300) AS over_limit FROM t GROUP BY 1""",
    "longest_answer": f"SELECT pair_id, {_tokens('gold')} AS tokens FROM eval_preds ORDER BY tokens DESC, pair_id LIMIT 1",
    "serialised_tables": f"""WITH RECURSIVE base AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS a, p_size::VARCHAR AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE '' END AS c FROM part),
grp AS (SELECT *, count(nullif(a, '')) OVER (PARTITION BY p_brand ORDER BY i) AS ga, count(nullif(c, '')) OVER (PARTITION BY p_brand ORDER BY i) AS gc FROM base),
f AS (SELECT p_brand, i, coalesce(max(nullif(a, '')) OVER (PARTITION BY p_brand, ga), '') AS a, b, coalesce(max(nullif(c, '')) OVER (PARTITION BY p_brand, gc), '') AS c FROM grp)
SELECT p_brand, '## Table ' || p_brand || ':' || chr(10) || string_agg(array_to_string(list_filter([CASE WHEN a <> '' THEN 'type ' || {_squeeze('a')} ELSE '' END, 'size ' || b, CASE WHEN c <> '' THEN 'item name ' || {_squeeze('c')} ELSE '' END], lambda x: x <> ''), ', '), '. ' ORDER BY i) || '.' AS said FROM f GROUP BY 1""",
    "filled_tables": f"""WITH base AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {_squeeze('p_type')} END AS a, p_size::VARCHAR AS b, CASE WHEN p_partkey % 5 <> 0 THEN {_squeeze('p_name')} ELSE '' END AS c FROM part
 UNION ALL SELECT DISTINCT p_brand, 0, 'Type', 'Size', 'Item Name' FROM part),
grp AS (SELECT *, count(nullif(a, '')) OVER (PARTITION BY p_brand ORDER BY i) AS ga, count(nullif(c, '')) OVER (PARTITION BY p_brand ORDER BY i) AS gc FROM base)
SELECT p_brand, i AS pos, max(nullif(a, '')) OVER (PARTITION BY p_brand, ga) || '|' || b || '|' || max(nullif(c, '')) OVER (PARTITION BY p_brand, gc) AS cells FROM grp""",
    "dominant_font": f"WITH {_DOMINANT} SELECT doc_id, dominant FROM dom",
    "body_font": f"WITH {_SPANS}, k AS (SELECT doc_id, size, count(DISTINCT page) AS pages, sum(length(text)) AS chars FROM s GROUP BY 1, 2) SELECT doc_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, chars DESC, size DESC) AS r FROM k) WHERE r = 1",
    "kept_spans": f"WITH {_NEAR} SELECT doc_id, page, pos FROM sized LEFT JOIN (SELECT *, true AS n FROM near) USING (doc_id, page, pos) WHERE size >= dominant - 0.5 OR coalesce(n, false)",
    "small_spans": f"WITH {_NEAR} SELECT doc_id, page, pos FROM sized LEFT JOIN (SELECT *, true AS n FROM near) USING (doc_id, page, pos) WHERE NOT (size >= dominant - 0.5 OR coalesce(n, false))",
    "margin_lines": f"WITH {_SPANS} SELECT doc_id, pos, y0 <= 60.0 * 0.1 OR y1 >= 60.0 * 0.9 AS in_margin FROM s",
    "polygon_boxes": f"WITH {_SPANS} SELECT doc_id, pos, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM s",
    "ocr_text": f"""SELECT chunk_key, {_strip("regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(12), ' '), chr(13), chr(10)), '([" + _W + "])-" + chr(92) + "n([" + _W + "])', '" + chr(92) + "1" + chr(92) + "2', 'g'), '" + chr(92) + "n{2,}', '<<<PARA>>>', 'g'), '[ " + chr(92) + "t]*" + chr(92) + "n[ " + chr(92) + "t]*', ' ', 'g'), '<<<PARA>>>', chr(10) || chr(10)), '[ " + chr(92) + "t]+', ' ', 'g'), ' *" + chr(92) + "n" + chr(92) + "n *', chr(10) || chr(10), 'g')")} AS said FROM chunks""",
}
