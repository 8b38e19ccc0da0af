"""Queries over the core operators, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import clean, divide, events, fuzzy, text
from quillstone.functions.columns import let, once
from quillstone.operators import dataset, evaluate, layout, matching, parse_rows, tables
from quillstone.operators.skew import attach
from quillstone.plans import pipeline
from quillstone.session import balanced, cut, in_parallel
from quillstone.sources import files

Query = Callable[[SparkSession, str], DataFrame]
PROMPT = "Extract the events of this text.\n\nText:\n"
_QUERIES: dict[str, Query] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """The columns of a table for work that is heavy per row and needs no shuffle."""
    return in_parallel(_table(spark, d, name).select(key, *columns), key)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "documents", "doc_id", "text")


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- faulty rows


@query
def p6_found(spark, d):
    return parse_rows.faulty_rows(_table(spark, d, "label_lines"), _table(spark, d, "eval_preds"))


@query
def p6_sound(spark, d):
    return parse_rows.sound_rows(_table(spark, d, "label_lines"), _table(spark, d, "eval_preds"))


# ---------------------------------------------------------------- text


@query
def sentence_tokens_by_lang(spark, d):
    docs = _rows(spark, d, "documents", "doc_id", "text", "lang").where("text IS NOT NULL")
    counts = let(divide.sentences(F.col("text")), lambda s: F.struct(F.size(s).alias("n"), F.aggregate(F.transform(s, divide.token_count), F.lit(0), lambda a, x: a + x).alias("t")))
    # documents are summed where they stand: a row per language is shuffled, none per sentence
    rows = once(docs.select(F.coalesce("lang", F.lit("(none)")).alias("lang"), "text"), "c", counts).where("c.n > 0")
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("c.n").alias("n_sentences"), F.sum("c.t").alias("n_tokens"))


@query
def norm_text(spark, d):
    return _table(spark, d, "chunks").select("chunk_key", text.norm(F.col("text")).alias("normed"))


@query
def csv_quote_lines(spark, d):
    return _table(spark, d, "chunk_events").select("event_key", events.event_line(F.col("chemical"), F.col("event_type"), F.col("description")).alias("line"))


@query
def text_measures(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", divide.token_count(c).alias("n_tokens"), F.bround(text.alnum_ratio(c), 6).alias("alnum_ratio"), text.preview(c).alias("preview"), text.occurrences(c, F.lit("receptor")).alias("n_hits"))


@query
def sentence_split(spark, d):
    rows = _rows(spark, d, "chunks", "chunk_key", "text").select("chunk_key", F.posexplode(divide.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows


@query
def levenshtein_titles(spark, d):
    return _table(spark, d, "papers").select("paper_stem", F.levenshtein(F.regexp_replace("title", "[^ -~]", ""), F.regexp_replace("short_title", "[^ -~]", "")).alias("distance"))


# ---------------------------------------------------------------- cleaning


def _noisy(chunks: DataFrame) -> Column:
    """Chunk text with the things the rules remove, composed alike in the SQL."""
    n = F.col("chunk_id").cast("string")
    return F.concat(F.lit("<!-- page "), n, F.lit(" -->\n12 www.example.org/"), n, F.lit("\nx\n===\n"), text.text("text"), F.lit(" (n = 2000) [1, 2-4] word- , end &amp;lt; /uniFB01 ne\n\n\n\n3.5\n- \nlast"))


def _rule(fn) -> Query:
    def run(spark, d):
        chunks = _rows(spark, d, "chunks", "chunk_key", "chunk_id", "text")
        return chunks.select("chunk_key", fn(_noisy(chunks)).alias("cleaned"))

    return run


for _name, _fn in {
    "clean_comments": clean.strip_comments,
    "clean_meaningless_lines": clean.drop_meaningless_lines,
    "clean_bare_links": clean.drop_bare_links,
    "clean_artifacts": clean.drop_artifacts,
    "clean_dehyphenate": clean.dehyphenate,
    "clean_linebreaks": clean.fix_linebreaks,
    "clean_citations": clean.drop_citations,
    "clean_whitespace": clean.fix_whitespace,
    "clean_spacing": clean.fix_spacing,
    "clean_trailing_dashes": clean.drop_trailing_dashes,
    "clean_coding": clean.fix_coding,
    "clean_headings": clean.normalise_headings,
    "clean_join_lines": clean.join_broken_lines,
}.items():
    _QUERIES[_name] = _rule(_fn)


@query
def clean_markdown(spark, d):
    chunks = _rows(spark, d, "chunks", "chunk_key", "chunk_id", "text")
    return clean.clean_documents(chunks.select("chunk_key", _noisy(chunks).alias("cleaned")), "cleaned", "cleaned")


@query
def clean_tables(spark, d):
    """Tables composed from the chunks' numbers stand between two lines of text."""
    n = F.col("chunk_id").cast("string")
    body = F.concat(F.lit("before\n| a | b |\n|---|:-:|\n| "), n, F.lit(" | x |\n| last\nafter\n| no | table |\n"), F.col("section_title"))
    return _table(spark, d, "chunks").where("section_title IS NOT NULL").select("chunk_key", clean.drop_tables(body).alias("cleaned"))


@query
def clean_tables_in_text(spark, d):
    """A table composed from the chunk's number stands after the first line of the whole text of every chunk, its title at the end."""
    body, n = text.text("text"), text.text(F.col("chunk_id").cast("string"))
    first = F.substring_index(body, "\n", 1)
    table = F.concat(F.lit("\nbefore\n| a | b |\n|---|:-:|\n| "), n, F.lit(" | x |\n| last\nafter\n| no | table |\n"))
    said = F.concat(first, table, F.substring(body, F.length(first) + 2, F.length(body)), F.lit("\n"), text.text("section_title"))
    return _table(spark, d, "chunks").select("chunk_key", clean.drop_tables(said).alias("cleaned"))


# ---------------------------------------------------------------- division


@query
def heading_tests(spark, d):
    t = F.col("section_title")
    line = F.concat(F.repeat(F.lit("#"), F.col("section_level")), F.lit(" "), t, F.lit(" "))
    rows = _table(spark, d, "chunks").where("section_title IS NOT NULL").select("chunk_key", "section_title", line.alias("line"))
    c = F.col("line")
    return rows.select("chunk_key", divide.is_heading(c).alias("is_heading"), divide.clean_heading(c).alias("title"), divide.heading_level(c).alias("level"), divide.is_blacklisted(t).alias("blacklisted"), divide.looks_like_sentence(t).alias("sentence_like"))


@query
def text_lines(spark, d):
    return divide.text_lines(_docs(spark, d)).select("doc_id", "pos", "line", "heading", "section_no")


@query
def sections(spark, d):
    return divide.extract_sections(_docs(spark, d))


@query
def chunk_pack(spark, d):
    return divide.build_chunks(_docs(spark, d))


@query
def chunk_sizes(spark, d):
    made = divide.build_chunks(_docs(spark, d))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("token_count").alias("most_tokens"), F.max("section_index").alias("last_section"))


@query
def document_blocks(spark, d):
    blocks = divide.document_parts(_docs(spark, d))
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


# ---------------------------------------------------------------- events and names


@query
def label_events(spark, d):
    return files.label_events(_table(spark, d, "label_lines"), "paper_stem", "line_no", "raw_line")


@query
def parse_answers(spark, d):
    return events.parse_events(_table(spark, d, "eval_preds").select("pair_id", "pred"), "pred").select("pair_id", "line_pos", "chemical", "event_type", "description")


@query
def parse_stats(spark, d):
    return events.parse_stats(_table(spark, d, "eval_preds"), "pair_id", "pred")


def _chemicals(spark, d):
    return _table(spark, d, "chunk_events").select("chemical").where("chemical IS NOT NULL").distinct()


@query
def chemical_names(spark, d):
    c = F.col("chemical")
    rows = once(_chemicals(spark, d), "n", events.label_names(c))
    return rows.select("chemical", F.col("n.base").alias("base"), F.col("n.abbr").alias("abbr"), F.array_join(F.array_sort(events.name_set(c)), "|").alias("names"))


@query
def wordbound_match(spark, d):
    ev = _table(spark, d, "chunk_events").select("event_key", "paper_stem", "chunk_id", "chemical", "description")
    ch = _table(spark, d, "chunks").select("chunk_key", "paper_stem", "chunk_id", "text")
    pairs = ev.join(ch, ["paper_stem", "chunk_id"])
    return pairs.select("event_key", "chunk_key", events.contains_words(F.col("text"), F.col("chemical")).alias("named"), text.contains_normalised(F.col("text"), F.col("description")).alias("exact"))


# ---------------------------------------------------------------- matching


def _chunk_events(spark, d):
    rows = _table(spark, d, "chunk_events").where("event_key IS NOT NULL")
    return rows.select(F.concat_ws("#", "paper_stem", "chunk_id").alias("doc_id"), F.col("event_key").alias("event_id"), "chemical", "event_type", F.col("description").alias("description_short"), F.lit("").alias("description_long"))


def _chunk_blocks(spark, d):
    """Sentences and whole text of each chunk; the first load of a chunk counts."""
    ch = _table(spark, d, "chunks").groupBy("paper_stem", "chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    ch = ch.select(F.concat_ws("#", "paper_stem", "chunk_id").alias("doc_id"), "text")
    s = ch.select("doc_id", F.lit("sentences").alias("kind"), F.posexplode(divide.sentences(F.col("text"))).alias("pos", "text"))
    return s.unionByName(ch.select("doc_id", F.lit("chunks").alias("kind"), F.lit(0).alias("pos"), "text"))


@query
def annotate_chunks(spark, d):
    found = matching.annotate(_chunk_events(spark, d), _chunk_blocks(spark, d), short_only=True, min_score=40.0)
    return found.select("doc_id", "event_id", "kind", "pos", "score", "chemical_found", "matched_variant", "rank_in_block")


@query
def fuzzy_scores(spark, d):
    """Description of each event against that of the next event of its paper (by number; the first delivery counts)."""
    ev = _table(spark, d, "chunk_events").where("event_key IS NOT NULL AND paper_stem IS NOT NULL")
    a = ev.groupBy("paper_stem", "event_id").agg(F.min_by(F.struct(F.col("description").alias("d")), "event_key")["d"].alias("a"), F.min("event_key").alias("event_key"))
    b = a.select("paper_stem", (F.col("event_id") - 1).alias("event_id"), F.col("a").alias("b"))
    pairs = cut(a.join(b, ["paper_stem", "event_id"]))
    sim = once(balanced(pairs, pairs.count(), "event_key"), "s", fuzzy.similarities(text.norm(F.col("a")), text.norm(F.col("b"))))
    return sim.select("event_key", F.bround("s.pr", 6).alias("partial"), F.bround("s.ts", 6).alias("token_set"), F.bround(fuzzy.blend(F.col("s")), 6).alias("fuzzy"))


def _matches(spark, d):
    """Extracted events as matches: the kind follows from the chunk number."""
    kind = F.element_at(F.array(*[F.lit(k) for k in matching.KINDS]), F.pmod("chunk_id", F.lit(4)) + 1)
    return _table(spark, d, "chunk_events").select(F.col("paper_stem").alias("doc_id"), "event_id", kind.alias("kind"), F.col("event_key").alias("pos"), "chemical", F.col("description").alias("text"), "score", "chemical_found")


@query
def best_match_per_event(spark, d):
    return matching.best_matches(_matches(spark, d)).select("doc_id", "event_id", "kind", "pos", "score")


@query
def score_range(spark, d):
    papers = _table(spark, d, "papers").select(F.col("paper_stem").alias("doc_id"))
    return matching.score_range(_matches(spark, d), papers)


@query
def unmatched_events(spark, d):
    ev = _table(spark, d, "label_lines").select(F.col("paper_stem").alias("doc_id"), F.col("line_no").alias("event_id"), "label_id")
    return matching.unmatched(ev, _matches(spark, d).where("score >= 68"))


@query
def events_by_chemical(spark, d):
    m = _matches(spark, d).where("score >= 68")
    missed = matching.unmatched(_matches(spark, d).groupBy("doc_id", "event_id").agg(F.min_by("chemical", "pos").alias("chemical")), m)
    ids = F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",")
    return matching.events_by_chemical(m, missed).select("doc_id", "chemical", "n_events", "n_unmatched", ids.alias("event_ids"))


@query
def report_rows(spark, d):
    ev = _table(spark, d, "chunk_events").groupBy(F.col("paper_stem").alias("doc_id"), "event_id").agg(F.min_by(F.struct("chemical", "event_type", "description"), "event_key").alias("e"))
    ev = ev.select("doc_id", "event_id", "e.chemical", "e.event_type", F.col("e.description").alias("description_short"))
    return matching.best_for_csv(ev, _matches(spark, d).where("score >= 68"))


@query
def placed_unmatched(spark, d):
    ev = _table(spark, d, "chunk_events").groupBy(F.col("paper_stem").alias("doc_id"), "event_id").agg(F.min_by(F.struct("chemical", "chunk_id"), "event_key").alias("e")).select("doc_id", "event_id", "e.chemical", "e.chunk_id")
    ch = _table(spark, d, "chunks").groupBy(F.col("paper_stem").alias("doc_id"), F.col("chunk_id").alias("pos")).agg(F.min_by("text", "chunk_key").alias("text")).withColumn("kind", F.lit("chunks"))
    return matching.place_unmatched(ev, _matches(spark, d).where("score >= 68"), ch).select("doc_id", "event_id", "pos", "score", "chemical_found", "matched_variant")


# ---------------------------------------------------------------- evaluation


@query
def canonical_answers(spark, d):
    return _table(spark, d, "eval_preds").select("pair_id", events.canonical_answer(F.col("gold")).alias("canonical"), events.canonical_target(F.col("gold")).alias("target"))


@query
def line_metrics(spark, d):
    rows = _table(spark, d, "eval_preds").select("pair_id", F.struct(events.event_lines(F.col("gold")).alias("g"), events.event_lines(F.col("pred")).alias("p")).alias("x"))
    rows = once(rows.select("pair_id", F.col("x.g").alias("g"), F.col("x.p").alias("p")), "m", F.struct(events.ordered_metrics(F.col("p"), F.col("g")).alias("o"), events.set_counts(F.col("p"), F.col("g")).alias("s")))
    return rows.select("pair_id", "m.o.ordered_exact", F.bround("m.o.ordered_line_acc", 6).alias("ordered_line_acc"), "m.s.tp", "m.s.fp", "m.s.fn")


@query
def micro_prf(spark, d):
    s = _table(spark, d, "eval_preds").agg(*[F.sum(f"set_counts.{x}").alias(x) for x in ("tp", "fp", "fn")])
    p, r, f1 = events.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("tp", "fp", "fn", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(f1, 6).alias("f1"))


@query
def loss_summary(spark, d):
    return evaluate.loss_summary(_table(spark, d, "eval_preds")).select("n", F.bround("mean_loss", 6).alias("mean_loss"), F.bround("perplexity", 4).alias("perplexity"))


@query
def prompt_passages(spark, d):
    return _table(spark, d, "eval_preds").select("pair_id", events.prompt_passage(F.col("prompt")).alias("passage"))


@query
def merged_prompts(spark, d):
    rows = once(_table(spark, d, "train_records").select("record_id", "messages"), "m", events.merged_prompt(F.col("messages")))
    return rows.select("record_id", "m.user", "m.assistant")


@query
def evaluate_records(spark, d):
    return evaluate.evaluate_records(_table(spark, d, "eval_preds"))


@query
def evaluation_totals(spark, d):
    t = evaluate.totals(evaluate.evaluate_records(_table(spark, d, "eval_preds")))
    return t.select("n_gold", "n_pred", "tp", "fp", "fn", F.bround("precision", 6).alias("precision"), F.bround("recall", 6).alias("recall"), F.bround("f1", 6).alias("f1"))


@query
def cosine_neighbours(spark, d):
    """Cosine of each vector with the next one of its label."""
    e = _table(spark, d, "embeddings")
    nxt = e.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b IS NOT NULL")
    pairs = nxt.join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return pairs.select("a", "b", F.bround(evaluate.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query
def semantic_dedup(spark, d):
    return evaluate.semantic_dedup(_table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", evaluate.DEDUP_THRESHOLD).select("vec_id", "label")


@query
def sorted_events(spark, d):
    return evaluate.sort_events(_table(spark, d, "chunk_events").select("event_key", "chemical", "event_type", "description")).select("event_key", "chemical", "event_type")


# ---------------------------------------------------------------- datasets


def _valid(spark, d):
    ev = _table(spark, d, "chunk_events")
    chemical = F.coalesce(F.when(F.col("matched_chemical_variant") != "", F.col("matched_chemical_variant")), "chemical")
    return dataset.valid_events(ev, ["paper_stem", "chunk_id"], ["event_key"], chemical, F.col("event_type"), F.col("description")).withColumnRenamed("event_key", "pos")


def _examples(spark, d):
    ch = _table(spark, d, "chunks").groupBy("paper_stem", "chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    return dataset.chunk_examples(ch, _valid(spark, d), PROMPT)


@query
def valid_events(spark, d):
    return _valid(spark, d)


@query
def chunk_examples(spark, d):
    return _examples(spark, d).select("paper_stem", "chunk_id", "n_events", "positive", F.element_at("messages", 2)["content"].alias("answer"), F.length(F.element_at("messages", 1)["content"]).alias("prompt_chars"))


@query
def paper_split(spark, d):
    return dataset.split_papers(_table(spark, d, "papers"), 0.15)


@query
def kfold_assign(spark, d):
    return dataset.assign_folds(_table(spark, d, "papers"), 5)


@query
def fold_sizes(spark, d):
    return dataset.fold_copies(dataset.assign_folds(_table(spark, d, "papers"), 5), 5).groupBy("run", "split").agg(F.count("*").alias("n_papers"))


def _sampled(spark, d):
    split = dataset.split_papers(_table(spark, d, "papers"), 0.15)
    return dataset.sample_negatives(_examples(spark, d).join(split, "paper_stem"), 0.5)


@query
def negative_sample(spark, d):
    return _sampled(spark, d).select("paper_stem", "chunk_id", "split", "positive")


@query
def numbered_examples(spark, d):
    return dataset.number_examples(_sampled(spark, d)).select("paper_stem", "chunk_id", "split", "line_no")


@query
def split_stats(spark, d):
    return dataset.split_stats(_sampled(spark, d))


@query
def split_papers_info(spark, d):
    info = dataset.split_papers_info(dataset.number_examples(_sampled(spark, d)))
    return info.select("split", "paper_stem", "filename", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


@query
def record_papers(spark, d):
    """Records joined with the papers that list their lines."""
    info = _table(spark, d, "split_info")
    parts = [info.select("build_id", F.lit(s).alias("split"), F.explode(F.col(f"{s}.papers")).alias("p")) for s in ("train", "validation", "test")]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("build_id", "split", F.col("p.id").alias("paper_id"), F.explode("p.chunk_ids").alias("line_no"))
    return _table(spark, d, "train_records").select("record_id", "build_id", "split", "line_no").join(lines, ["build_id", "split", "line_no"]).select("record_id", "paper_id")


@query
def token_length_report(spark, d):
    said = F.array_join(F.transform("messages", lambda m: text.text(m["content"])), "\n")
    rows = _table(spark, d, "train_records").where("messages IS NOT NULL").select("split", divide.token_count(said).alias("tokens"))
    return dataset.token_lengths(rows, "split", "tokens", 300)


@query
def longest_answer(spark, d):
    rows = _table(spark, d, "eval_preds").select("pair_id", divide.token_count(F.col("gold")).alias("tokens"))
    return dataset.longest_answer(rows, "tokens", ["pair_id"])


# ---------------------------------------------------------------- tables and layout


def _grid(spark, d):
    """Tables composed from parts: brands as tables, every third type cell empty, a header row on top."""
    p = _table(spark, d, "part")
    cell = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    rows = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.array(cell, F.concat(F.lit(" "), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))).alias("cells")))).alias("r"))
    head = F.array(F.lit("Type"), F.lit("Size"), F.lit("Item Name"))
    return rows.select("p_brand", F.concat(F.array(head), F.transform("r", lambda x: x["cells"])).alias("rows"))


@query
def serialised_tables(spark, d):
    return _grid(spark, d).select("p_brand", tables.serialise(F.col("rows"), F.concat(F.lit("## Table "), F.col("p_brand"))).alias("said"))


@query
def filled_tables(spark, d):
    rows = _grid(spark, d).select("p_brand", F.posexplode(tables.fill_down(tables.clean_rows(F.col("rows")))).alias("pos", "r"))
    return rows.select("p_brand", "pos", F.array_join("r", "|").alias("cells"))


def _spans(spark, d):
    """Spans composed from line items: an order is a document, its lines stand on pages."""
    li = _table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.pmod("l_linenumber", F.lit(2)).alias("page"),
        F.col("l_linenumber").alias("pos"),
        F.concat("l_returnflag", F.repeat(F.lit("x"), F.pmod(F.col("l_partkey"), F.lit(9)).cast("int"))).alias("text"),
        (F.floor(F.col("l_quantity") / 10) + 6.0).alias("size"),
        F.pmod("l_partkey", F.lit(500)).cast("double").alias("x0"),
        F.pmod("l_suppkey", F.lit(50)).cast("double").alias("y0"),
        (F.pmod("l_partkey", F.lit(500)) + 120).cast("double").alias("x1"),
        (F.pmod("l_suppkey", F.lit(50)) + 12).cast("double").alias("y1"),
        F.lit(800.0).alias("page_height"),
    )


@query
def dominant_font(spark, d):
    return layout.dominant_size(_spans(spark, d))


@query
def body_font(spark, d):
    return layout.body_size(_spans(spark, d))


@query
def kept_spans(spark, d):
    s = _spans(spark, d)
    sized = s.join(layout.dominant_size(s), "doc_id")
    return layout.keep_spans(sized, "dominant", True).select("doc_id", "page", "pos")


@query
def small_spans(spark, d):
    s = _spans(spark, d)
    sized = s.join(layout.dominant_size(s), "doc_id")
    return layout.keep_spans(sized, "dominant", False).select("doc_id", "page", "pos")


@query
def margin_lines(spark, d):
    return _spans(spark, d).select("doc_id", "pos", layout.in_margin(F.col("y0"), F.col("y1"), F.lit(60.0)).alias("in_margin"))


@query
def ocr_blocks(spark, d):
    """Boxes composed from line items: an order is an image."""
    boxes = _spans(spark, d).select(F.col("doc_id").alias("image_id"), "text", F.lit(0.9).alias("score"), "x0", (F.col("y0") * 8).alias("y0"), "x1", (F.col("y0") * 8 + 12).alias("y1"))
    return layout.image_texts(boxes)


@query
def polygon_boxes(spark, d):
    s = _spans(spark, d)
    pts = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    rows = once(s.select("doc_id", "pos", pts.alias("p")), "b", layout.polygon_box(F.col("p")))
    return rows.select("doc_id", "pos", "b.w", "b.h", "b.cx", "b.cy")


@query
def ocr_text(spark, d):
    return _table(spark, d, "chunks").select("chunk_key", layout.normalise_ocr(F.col("text")).alias("said"))


# ---------------------------------------------------------------- pipeline


def _stored_answers(spark, d):
    """Extractor for ``pipeline.score_documents``: the stored events of the document's paper and chunk number stand in for the model's answers."""
    ev = _table(spark, d, "chunk_events").where("event_key IS NOT NULL")
    lines = F.sort_array(F.collect_list(F.struct("event_key", events.event_line(F.col("chemical"), F.col("event_type"), F.col("description")).alias("line"))))
    answers = ev.groupBy("paper_stem", "chunk_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("answer"))
    papers = _table(spark, d, "documents").select("doc_id", "paper_stem")

    def extract(chunks: DataFrame) -> DataFrame:
        asked = cut(chunks.select("doc_id", "chunk_id").join(papers, "doc_id"))
        counted = asked.groupBy("paper_stem", "chunk_id").agg(F.count("*").alias("n"))
        known = cut(answers.join(counted, ["paper_stem", "chunk_id"]))
        # a chunk without stored events has an answer without rows
        return attach(asked, known, ["paper_stem", "chunk_id"], "n", asked.count(), "left").drop("paper_stem").na.fill({"answer": "### END"})

    return extract


def _scored(spark, d):
    return pipeline.score_documents(_table(spark, d, "documents"), _stored_answers(spark, d))


@query
def pipeline_report(spark, d):
    """Documents to scored events: cleaned, divided, matched and reported, with stored events standing in for the model's answers."""
    return _scored(spark, d)[1]


@query
def pipeline_matches(spark, d):
    return _scored(spark, d)[0].select("doc_id", "event_id", "kind", "pos", "score", "chemical_found", "matched_variant", "rank_in_block")


def _labelled(spark, d):
    """The first load of each chunk, and the valid events."""
    return _table(spark, d, "chunks").groupBy("paper_stem", "chunk_id").agg(F.min_by("text", "chunk_key").alias("text")), _valid(spark, d)


@query
def pipeline_dataset(spark, d):
    """Labels to dataset: the numbered examples of the production split."""
    return pipeline.label_dataset(*_labelled(spark, d), PROMPT)[0].select("paper_stem", "chunk_id", "split", "positive", "n_events", "line_no", "messages")


@query
def pipeline_dataset_stats(spark, d):
    return pipeline.label_dataset(*_labelled(spark, d), PROMPT)[1]


@query
def pipeline_dataset_papers(spark, d):
    return pipeline.label_dataset(*_labelled(spark, d), PROMPT)[2]


@query
def pipeline_folds(spark, d):
    """The numbered examples of every fold."""
    folds = pipeline.fold_datasets(*_labelled(spark, d), PROMPT)
    rows = [df.select(F.lit(i).alias("fold"), "paper_stem", "chunk_id", "split", "positive", "line_no") for i, df in folds.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def pipeline_predictions(spark, d):
    """Predictions to metrics: the counts of every record, and their totals in the row without pair_id."""
    counts, totals = pipeline.prediction_report(_table(spark, d, "eval_preds"))
    return counts.unionByName(totals, allowMissingColumns=True)


@query
def score_predictions(spark, d):
    preds = _table(spark, d, "eval_preds")
    ev = evaluate.answer_events(preds, "pair_id", "pred")
    withtext = ev.join(preds.select("pair_id", events.prompt_passage(F.col("prompt")).alias("passage")), "pair_id")
    rows = cut(withtext)
    return matching.score_predictions(balanced(rows, rows.count(), "pair_id", "pos"), "passage").select("pair_id", "pos", "score", "chemical_found")
