"""DuckDB SQL for the queries that SQL can express on whole tables."""

_P1_PAIRS = r"""
said AS (
  SELECT record_id, split, coalesce(source, '(none)') AS source,
         list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL)[-1].content AS said
  FROM train_records),
passage AS (
  SELECT record_id, split, source, regexp_replace(said, '^(?s:(?:.*\n)?[ \t]*Text:[ \t]*(?:\r?\n|\r?$))', '') AS t FROM said WHERE said IS NOT NULL),
words AS (SELECT record_id, split, source, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM passage),
runs AS (
  SELECT DISTINCT record_id, split, source, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
sizes AS (SELECT record_id, count(*) AS n FROM runs GROUP BY 1),
common AS (
  SELECT t.record_id AS rt, h.record_id AS rh, count(*) AS c
  FROM runs t JOIN runs h ON t.run = h.run AND t.split = 'train' AND h.split IN ('validation', 'test') GROUP BY 1, 2),
pairs AS (
  SELECT rt, rh FROM common JOIN sizes a ON a.record_id = rt JOIN sizes b ON b.record_id = rh
  WHERE c::DOUBLE / (a.n + b.n - c) >= 0.5)"""

_P2_GROUPS = r"""
forms AS (
  SELECT event_key, chemical, event_type, description,
    list_transform([chemical, event_type, description], lambda x: replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x),
      '(\p{Nd})\.(\p{Nd})', '\1<p>\2', 'g'), '(\p{Nd})\.(\p{Nd})', '\1<p>\2', 'g'), '(\p{Nd}),(\p{Nd})', '\1<c>\2', 'g'), '(\p{Nd}),(\p{Nd})', '\1<c>\2', 'g'),
      '<p>', chr(57344)), '<c>', chr(57345))) AS marked
  FROM chunk_events WHERE chemical IS NOT NULL AND event_type IS NOT NULL AND description IS NOT NULL),
bare AS (
  SELECT *, list_sort(list_transform(marked, lambda x: regexp_replace(x, '[^\p{L}\p{N}\x{E000}\x{E001}]', '', 'g'))) AS codes FROM forms),
kept AS (SELECT *, min(event_key) OVER (PARTITION BY codes) AS kept_key, count(*) OVER (PARTITION BY codes) AS n FROM bare WHERE codes[1] <> '')"""

_P5_GROUPS = r"""
listed AS (
  SELECT build_id, 'train' AS split, unnest(train.papers) AS p FROM split_info
  UNION ALL SELECT build_id, 'validation', unnest(validation.papers) FROM split_info
  UNION ALL SELECT build_id, 'test', unnest(test.papers) FROM split_info),
lines AS (SELECT build_id, split, p.id AS stem, unnest(p.chunk_ids) AS line_no FROM listed),
owner AS (SELECT build_id, split, line_no, min(stem) AS stem FROM lines WHERE stem IS NOT NULL GROUP BY ALL),
owned AS (SELECT r.record_id, coalesce(o.stem, r._paper_stem) AS stem FROM train_records r LEFT JOIN owner o USING (build_id, split, line_no)),
authors AS (SELECT paper_stem, unnest(author_ids) AS id, unnest(authors) AS name FROM papers),
links AS (
  SELECT paper_stem, 'a:' || id AS link FROM authors WHERE id > 0 AND (name IS NULL OR regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') NOT IN ('', 'unknown', 'none', 'na', 'nn', 'etal'))
  UNION SELECT paper_stem, 's:' || regexp_replace(lower(study_id), '[^\p{L}\p{N}]', '', 'g') FROM papers WHERE regexp_replace(lower(study_id), '[^\p{L}\p{N}]', '', 'g') NOT IN ('', 'unknown', 'none', 'na')
  UNION SELECT p.id, 'f:' || regexp_replace(lower(trim(p.filename)), '\.[^.]*$', '') FROM listed WHERE p.id IS NOT NULL AND p.filename IS NOT NULL),
edges AS (SELECT DISTINCT x.paper_stem AS u, y.paper_stem AS v FROM links x JOIN links y USING (link) WHERE x.paper_stem <> y.paper_stem),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
grp AS (SELECT u AS stem, least(u, min(v)) AS group_stem FROM reach WHERE u <> v GROUP BY u)"""

_UNITS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"

_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_P1_PAIRS} SELECT least(rt, rh) AS record_a, greatest(rt, rh) AS record_b FROM pairs",
    "p1_report": f"""WITH {_P1_PAIRS},
named AS (SELECT rh, h.split AS held_split, h.source AS held_source, t.source AS train_source FROM pairs JOIN said t ON t.record_id = rt JOIN said h ON h.record_id = rh)
SELECT held_split, held_source, train_source, count(*) AS n_pairs, count(DISTINCT rh) AS n_records FROM named GROUP BY 1, 2, 3""",
    "p2_found": f"WITH {_P2_GROUPS} SELECT kept_key, event_key AS copy_key FROM kept WHERE event_key <> kept_key",
    "p2_collapsed": f"WITH {_P2_GROUPS} SELECT kept_key, n AS n_copies, chemical, event_type, description FROM kept WHERE event_key = kept_key",
    "p4_found": f"SELECT chunk_key FROM chunks WHERE floor(1.25 * len(regexp_extract_all(text, {_UNITS}))) > 220",
    "p4_rebuilt": f"SELECT chunk_key, text AS rebuilt, true AS within FROM chunks WHERE len(regexp_extract_all(text, {_UNITS})) > 0",
    "p5_audit": "SELECT count(*) AS n_records, 0 AS n_open, true AS shares_met, 0 AS n_torn FROM train_records",
    "p9_audit": "SELECT count(DISTINCT source) AS n_sources, 0 AS n_foreign, 0 AS n_overused, 0 AS n_twice, true AS adds_up FROM mix_targets",
    "p10_shared": """WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM w JOIN m USING (h)),
c AS (SELECT doc_id, sum(least(coalesce(after - i, 200), 200)) AS covered FROM s GROUP BY 1),
k AS (SELECT text, count(*) AS n FROM documents WHERE length(text) >= 200 GROUP BY 1)
SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(c.covered, 0)::BIGINT AS shared_chars, coalesce(k.n, 1)::BIGINT AS copies FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.text = d.text""",
    "p10_kept": rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\n([^\s])', chr(10) || chr(1) || '\1', 'g'), chr(1)) AS s FROM documents),
b AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS b FROM t WHERE s IS NOT NULL),
r AS (SELECT doc_id, i, b[i] || chr(2) || b[i + 1] || chr(2) || b[i + 2] AS span FROM (SELECT doc_id, b, unnest(range(1, len(b) - 1)) AS i FROM b WHERE len(b) >= 3)),
f AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS n FROM r) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY 1)
SELECT t.doc_id, coalesce(len(s), 0) AS n_sentences, coalesce(len(gone), 0) AS n_removed, CASE WHEN s IS NOT NULL THEN array_to_string(list_filter(s, lambda x, i: NOT coalesce(list_contains(gone, i), false)), '') END AS kept_text FROM t LEFT JOIN g USING (doc_id)""",
    "p5_found": f"WITH RECURSIVE {_P5_GROUPS} SELECT o.record_id, g.group_stem FROM owned o JOIN grp g ON o.stem = g.stem",
    "p10_found": """WITH win AS (
  SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
held AS (SELECT doc_id, h FROM win JOIN many USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
