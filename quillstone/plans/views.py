"""Queries over whole papers, and the views that reports and viewers need, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import divide, events, text
from quillstone.operators import evaluate, matching, tables
from quillstone.plans.oracle import _squeeze, _strip, _tokens, _WS
from quillstone.plans.registry import Query, _labelled, _rows, _table
from quillstone.session import cut, stored
from quillstone.sources import files

_QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def view(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- whole papers


def paper_blocks(spark, d) -> DataFrame:
    """The blocks of every paper (doc_id) from its chunks, first loads only: sentences, lines and paragraphs of each
    chunk's text, and the text itself. A place within a paper is the chunk's number, then the place in the chunk."""
    first = _labelled(spark, d)[0].where("paper_stem IS NOT NULL AND chunk_id IS NOT NULL")
    named = first.select(F.col("paper_stem").alias("doc_id"), "chunk_id", "text")
    parts = divide.document_parts(named, "doc_id", "text", divide.ChunkBudget(), "chunk_id", chunks=False)
    inner = parts.select("doc_id", "kind", (F.shiftleft(F.col("chunk_id").cast("bigint"), 32) + F.col("pos")).alias("pos"), "text")
    return inner.unionByName(named.where("text IS NOT NULL").select("doc_id", F.lit("chunks").alias("kind"), F.col("chunk_id").cast("bigint").alias("pos"), "text"))


def _labels(spark, d) -> DataFrame:
    rows = files.label_events(_table(spark, d, "label_lines"), "paper_stem", "line_no", "raw_line")
    return rows.withColumnRenamed("paper_stem", "doc_id")


_MATCH = ("doc_id", "event_id", "kind", "pos", "score", "chemical_found", "matched_variant", "rank_in_block")


@view()
def label_scores(spark, d):
    """Labels against the sentences, lines, paragraphs and chunks of their whole paper."""
    return matching.annotate(stored(_labels(spark, d)), stored(paper_blocks(spark, d))).select(*_MATCH)


@view()
def label_matches(spark, d):
    """For every label whether a smaller block and whether a chunk supports it: the lists of unmatched labels."""
    labels = stored(_labels(spark, d))
    found = matching.annotate(labels, stored(paper_blocks(spark, d)))
    by_event = found.groupBy("doc_id", "event_id").agg(F.max(F.col("kind") != "chunks").alias("in_units"), F.max(F.col("kind") == "chunks").alias("in_chunks"))
    return labels.select("doc_id", "event_id").distinct().join(by_event, ["doc_id", "event_id"], "left").na.fill(False, ["in_units", "in_chunks"])


@view()
def extracted_scores(spark, d):
    """Extracted events against their whole paper; those without support stay with the chunk they came from, score 0."""
    rows = _table(spark, d, "chunk_events").where("event_key IS NOT NULL AND paper_stem IS NOT NULL")
    first = rows.groupBy(F.col("paper_stem").alias("doc_id"), "event_id").agg(F.min_by(F.struct("chunk_id", "chemical", "event_type", "description"), "event_key").alias("e"))
    ev = stored(first.where("event_id IS NOT NULL").select("doc_id", "event_id", "e.chunk_id", "e.chemical", "e.event_type", F.col("e.description").alias("description_short"), F.lit("").alias("description_long")))
    blocks = stored(paper_blocks(spark, d))
    found = cut(matching.annotate(ev, blocks, short_only=True))
    return found.unionByName(matching.place_unmatched(ev, found, blocks), allowMissingColumns=True).select(*_MATCH)


def _paper_of_pair(spark, d) -> DataFrame:
    """pair_id, paper_stem: a prediction belongs to the training record of its number, whose paper lists its line."""
    info = _table(spark, d, "split_info")
    parts = [info.select("build_id", F.lit(s).alias("split"), F.explode(F.col(f"{s}.papers")).alias("p")) for s in ("train", "validation", "test")]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("p.id IS NOT NULL").select("build_id", "split", "p.id", F.explode("p.chunk_ids").alias("line_no"))
    owner = lines.groupBy("build_id", "split", "line_no").agg(F.min("id").alias("listed"))
    records = _table(spark, d, "train_records").select(F.col("record_id").alias("pair_id"), "build_id", "split", "line_no", "_paper_stem")
    return records.join(owner, ["build_id", "split", "line_no"], "left").select("pair_id", F.coalesce("listed", "_paper_stem").alias("paper_stem")).where("paper_stem IS NOT NULL")


@view()
def evaluate_papers(spark, d):
    """The comparison per paper of ``split_info``; the events of a paper's records count once."""
    return evaluate.evaluate_groups(_table(spark, d, "eval_preds"), _paper_of_pair(spark, d))


@view(f"""WITH p AS (SELECT build_id, 'train' AS split, unnest(train.papers) AS p FROM split_info UNION ALL SELECT build_id, 'validation', unnest(validation.papers) FROM split_info UNION ALL SELECT build_id, 'test', unnest(test.papers) FROM split_info),
l AS (SELECT build_id, split, p.id AS id, unnest(p.chunk_ids) AS line_no FROM p WHERE p.id IS NOT NULL),
o AS (SELECT build_id, split, line_no, min(id) AS listed FROM l GROUP BY ALL)
SELECT e.pair_id, coalesce(o.listed, r._paper_stem) AS paper_stem FROM eval_preds e JOIN train_records r ON r.record_id = e.pair_id LEFT JOIN o USING (build_id, split, line_no) WHERE coalesce(o.listed, r._paper_stem) IS NOT NULL""")
def prediction_papers(spark, d):
    return _table(spark, d, "eval_preds").select("pair_id").join(_paper_of_pair(spark, d), "pair_id")


def letter_vector(c: Column) -> Column:
    """How often each letter from a to z stands in a text: a stand-in for a vector of its meaning."""
    low = F.lower(text.text(c))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"])


@view()
def evaluate_by_vectors(spark, d):
    """The comparison of every record with vectors of the descriptions: what says the same counts once, and
    descriptions are compared by cosine."""
    return evaluate.evaluate_records(_table(spark, d, "eval_preds"), embed=letter_vector)


_GROUPED = "SELECT event_key, paper_stem, chunk_id, event_type, " + ", ".join(f"(length(lower(coalesce(description, ''))) - length(replace(lower(coalesce(description, '')), '{x}', '')))::DOUBLE AS {x}_" for x in "abcdefghijklmnopqrstuvwxyz") + f", {_squeeze('lower(chemical)')} AS name FROM chunk_events"
_VECTOR = "[" + ", ".join(f"{x}_" for x in "abcdefghijklmnopqrstuvwxyz") + "]"


@view(f"""WITH RECURSIVE g AS ({_GROUPED}), v AS (SELECT event_key, paper_stem, chunk_id, name, event_type, {_VECTOR} AS v, row_number() OVER (PARTITION BY paper_stem, chunk_id, name, event_type ORDER BY event_key) AS r FROM g),
k AS (SELECT paper_stem, chunk_id, name, event_type, r, [v] AS kept, [event_key] AS keys FROM v WHERE r = 1
 UNION ALL SELECT k.paper_stem, k.chunk_id, k.name, k.event_type, v.r,
  CASE WHEN len(list_filter(k.kept, lambda x: coalesce(list_cosine_similarity(x, v.v), 0) >= 0.85 AND list_sum(x) > 0 AND list_sum(v.v) > 0)) > 0 THEN k.kept ELSE k.kept || [v.v] END,
  CASE WHEN len(list_filter(k.kept, lambda x: coalesce(list_cosine_similarity(x, v.v), 0) >= 0.85 AND list_sum(x) > 0 AND list_sum(v.v) > 0)) > 0 THEN k.keys ELSE k.keys || [v.event_key] END
 FROM k JOIN v ON v.paper_stem IS NOT DISTINCT FROM k.paper_stem AND v.chunk_id IS NOT DISTINCT FROM k.chunk_id AND v.name = k.name AND v.event_type IS NOT DISTINCT FROM k.event_type AND v.r = k.r + 1)
SELECT unnest(keys) AS event_key FROM (SELECT *, row_number() OVER (PARTITION BY paper_stem, chunk_id, name, event_type ORDER BY r DESC) AS last FROM k) WHERE last = 1""")
def same_meaning_once(spark, d):
    """Events of a chunk without those that say the same as an earlier one of their chemical and type."""
    rows = _table(spark, d, "chunk_events").select("event_key", "paper_stem", "chunk_id", "event_type", text.norm(F.col("chemical")).alias("name"), letter_vector(F.col("description")).alias("vector"))
    return evaluate.semantic_dedup(rows, ["paper_stem", "chunk_id", "name", "event_type"], "event_key", "vector").select("event_key")


# ---------------------------------------------------------------- summaries


@view("SELECT paper_stem, count(*) AS n, min(score) AS lowest, round_even(avg(score), 6) AS mean_score, max(score) AS highest, count(*) FILTER (chemical_found) AS n_found FROM chunk_events GROUP BY 1")
def score_summary(spark, d):
    out = evaluate.score_summary(_table(spark, d, "chunk_events"), ["paper_stem"])
    return out.withColumn("mean_score", F.bround("mean_score", 6))


@view("SELECT paper_stem, string_agg(event_key::VARCHAR, ',' ORDER BY score DESC NULLS LAST, event_key) AS best FROM (SELECT *, row_number() OVER (PARTITION BY paper_stem ORDER BY score DESC NULLS LAST, event_key) AS r FROM chunk_events) WHERE r <= 8 GROUP BY 1")
def top_predictions(spark, d):
    """The eight best scored events of each paper."""
    best = evaluate.best_of_each(_table(spark, d, "chunk_events"), ["paper_stem"], [F.desc_nulls_last("score"), F.col("event_key")], "event_key", 8)
    return best.select("paper_stem", F.array_join(F.transform("best", lambda x: x.cast("string")), ",").alias("best"))


@view("SELECT pair_id, loss FROM eval_preds ORDER BY pair_id LIMIT 20")
def first_records(spark, d):
    """The first twenty records: the limit is the feature."""
    return _table(spark, d, "eval_preds").select("pair_id", "loss").orderBy("pair_id").limit(20)


@view(f"SELECT record_id, tokens FROM (SELECT record_id, {_tokens('array_to_string(list_transform(messages, lambda m: coalesce(m.content, chr(0))), chr(10))').replace('chr(0)', chr(39) * 2)} AS tokens FROM train_records WHERE messages IS NOT NULL) WHERE tokens > 300")
def long_records(spark, d):
    """The records above the limit of tokens."""
    said = F.array_join(F.transform("messages", lambda m: text.text(m["content"])), "\n")
    rows = _table(spark, d, "train_records").where("messages IS NOT NULL").select("record_id", divide.token_count(said).alias("tokens"))
    return rows.where("tokens > 300")


@view(f"SELECT pair_id, {_tokens('gold')} AS tokens, len(list_filter(string_split(coalesce(gold, ''), chr(10)), lambda x: {_strip('x')} NOT IN ('', '### END'))) AS n_events FROM eval_preds ORDER BY tokens DESC, pair_id LIMIT 1")
def longest_answer_events(spark, d):
    """The longest answer with the number of its rows; the first among equals."""
    n = F.size(F.filter(text.lines_of(F.col("gold")), lambda x: ~text.strip(x).isin("", events.END_MARK)))
    rows = _table(spark, d, "eval_preds").select("pair_id", divide.token_count(F.col("gold")).alias("tokens"), n.alias("n_events"))
    return rows.orderBy(F.desc("tokens"), "pair_id").limit(1)


# ---------------------------------------------------------------- viewer and reports


def score_colour(c: Column) -> Column:
    return F.when(c > 75, "high").when(c > 50, "middle").otherwise("low")


def type_colour(c: Column) -> Column:
    t = F.upper(F.trim(text.text(c)))
    return F.when(t.isin("MIE", "KE", "AO"), t).otherwise("other")


@view(f"""SELECT event_key, CASE WHEN score > 75 THEN 'high' WHEN score > 50 THEN 'middle' ELSE 'low' END AS score_colour,
 CASE WHEN upper(trim(coalesce(event_type, ''), ' ')) IN ('MIE', 'KE', 'AO') THEN upper(trim(event_type, ' ')) ELSE 'other' END AS type_colour, {_strip("coalesce(description, '')")} <> '' AS has_text FROM chunk_events""")
def event_colours(spark, d):
    rows = _table(spark, d, "chunk_events")
    return rows.select("event_key", score_colour(F.col("score")).alias("score_colour"), type_colour(F.col("event_type")).alias("type_colour"), (text.strip(text.text("description")) != "").alias("has_text"))


@view("""WITH s AS (SELECT doc_id, string_split(lower(coalesce(text, '')), 'receptor') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 8 + 1), ',') AS places FROM s""")
def found_places(spark, d):
    """Where a word stands in each document."""
    at = text.places(F.col("text"), F.lit("Receptor"))
    return _rows(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("places"))


@view(f"""WITH c AS (SELECT chunk_key, coalesce(text, '') AS t, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '^[{_WS}]+', '')) + 1 AS a, length(regexp_replace(coalesce(text, ''), '[{_WS}]+$', '')) AS b FROM chunks),
k AS (SELECT chunk_key, list_filter(range(a, b + 1), lambda i: NOT regexp_matches(substr(t, i::BIGINT, 1), '[{_WS}]') OR NOT regexp_matches(substr(t, (i - 1)::BIGINT, 1), '[{_WS}]')) AS m FROM c)
SELECT chunk_key, len(m) AS n_chars, coalesce(list_sum(m), 0)::BIGINT AS place_sum, array_to_string(list_filter(m, lambda x, i: i > 1 AND x - m[i - 1] > 1), ',') AS jumps FROM k""")
def normal_places(spark, d):
    """The map from the squeezed text of a chunk back to its original: size, sum and the places behind dropped signs."""
    at = F.col("at")
    rows = _rows(spark, d, "chunks", "chunk_key", "text").select("chunk_key", text.normal_places(F.col("text")).alias("at"))
    jumps = F.filter(at, lambda x, i: (i > 0) & (x - F.get(F.col("at"), i - 1) > 1))
    return rows.select("chunk_key", F.size(at).alias("n_chars"), F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("place_sum"), F.array_join(F.transform(jumps, lambda x: x.cast("string")), ",").alias("jumps"))


@view("SELECT p.paper_stem, p.paper_stem || '.md' AS path, n_events FROM (SELECT DISTINCT paper_stem FROM documents) p JOIN (SELECT paper_stem, count(*) AS n_events FROM chunk_events GROUP BY 1) e USING (paper_stem)")
def viewer_papers(spark, d):
    """The papers that have both a text and scored events, by path."""
    docs = _table(spark, d, "documents").select("paper_stem").distinct()
    scored = _table(spark, d, "chunk_events").groupBy("paper_stem").agg(F.count("*").alias("n_events"))
    return docs.join(scored, "paper_stem").select("paper_stem", F.concat("paper_stem", F.lit(".md")).alias("path"), "n_events").orderBy("path")


@view("SELECT l.paper_stem, count(*) AS n_labels, NOT EXISTS (SELECT 1 FROM chunks c WHERE c.paper_stem = l.paper_stem) AS no_text FROM label_lines l WHERE l.paper_stem IS NOT NULL GROUP BY l.paper_stem")
def label_papers(spark, d):
    """Papers with labels, and whether their text is missing (they are skipped with a warning)."""
    texts = _table(spark, d, "chunks").select("paper_stem", F.lit(True).alias("has")).where("paper_stem IS NOT NULL").distinct()
    return _table(spark, d, "label_lines").where("paper_stem IS NOT NULL").groupBy("paper_stem").agg(F.count("*").alias("n_labels")).join(texts, "paper_stem", "left").select("paper_stem", "n_labels", F.col("has").isNull().alias("no_text"))


@view("""SELECT paper_stem, chunk_key, number, '## Table ' || number || ':' AS heading FROM (SELECT paper_stem, chunk_key, row_number() OVER (PARTITION BY paper_stem ORDER BY chunk_key) AS number FROM chunks) WHERE chunk_key % 7 <> 0""")
def numbered_tables(spark, d):
    """Items of a paper numbered in order, where those that fail consume a number."""
    items = _table(spark, d, "chunks").select("paper_stem", "chunk_key")
    return tables.numbered(items, "paper_stem", ["chunk_key"], F.col("chunk_key") % 7 != 0, "Table").select("paper_stem", "chunk_key", "number", "heading")


@view("""WITH r AS (SELECT pair_id, set_counts.tp AS tp, set_counts.fp AS fp, set_counts.fn AS fn FROM eval_preds),
a AS (SELECT 0 AS part, pair_id, tp, fp, fn FROM r UNION ALL SELECT 1, NULL, coalesce(sum(tp), 0), coalesce(sum(fp), 0), coalesce(sum(fn), 0) FROM r),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM a)
SELECT part, coalesce('record ' || pair_id, 'all') || ' tp/fp/fn ' || coalesce(tp::BIGINT || '/' || fp::BIGINT || '/' || fn::BIGINT, '') || printf(' precision %.4f recall %.4f f1 %.4f', p::DOUBLE, q::DOUBLE, (CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END)::DOUBLE) AS line FROM b""")
def record_report(spark, d):
    """The text report over the stored counts of the records."""
    c = _table(spark, d, "eval_preds").select("pair_id", *[F.col(f"set_counts.{x}").alias(x) for x in ("tp", "fp", "fn")])
    sums = c.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    with_prf = lambda df: df.select("*", *[x.alias(n) for x, n in zip(events.prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))])
    return files.record_report(with_prf(c), with_prf(sums)).select("part", "line")
