"""Readers and writers of the pipeline's files.

Every reader takes a folder or path pattern and gives the file's stem as ``doc_id``; line positions are
those of the file. Schemas are declared, never inferred.
"""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.events import event_line, row_fields
from quillstone.functions.text import lines_of, strip, text

_SCORED = "event_id: INT, chemical: STRING, event_type: STRING, event_description_short: STRING, event_description_long: STRING, score: DOUBLE, chemical_found: BOOLEAN, matched_chemical_variant: STRING"
_CHUNK = "chunk_id: INT, section_index: INT, section_title: STRING, section_level: INT, token_count: INT, text: STRING"
_STATS = "total_papers: INT, total_chunks: INT, total_positive_chunks: INT, total_negative_chunks: INT, total_events: INT, average_chunk_length: DOUBLE, event_type_distribution: STRUCT<MIE: INT, KE: INT, AO: INT>, papers: ARRAY<STRUCT<id: STRING, filename: STRING, chunk_ids: ARRAY<INT>>>"

#: Declared schemas of the JSON files, by stage.
SCHEMAS = {
    "divided": f"lines ARRAY<STRING>, sentences ARRAY<STRING>, paragraphs ARRAY<STRUCT<title: STRING, body: STRING>>, sections ARRAY<STRUCT<title: STRING, level: INT, body: STRING>>, chunks ARRAY<STRUCT<{_CHUNK}>>",
    "extracted": f"chunks ARRAY<STRUCT<{_CHUNK}, predicted_events: ARRAY<STRUCT<chemical: STRING, event_type: STRING, description: STRING>>, raw_model_output: STRING>>",
    "scored": f"sentences ARRAY<STRUCT<text: STRING, events: ARRAY<STRUCT<{_SCORED}>>>>, lines ARRAY<STRUCT<text: STRING, events: ARRAY<STRUCT<{_SCORED}>>>>, paragraphs ARRAY<STRUCT<title: STRING, text: STRING, events: ARRAY<STRUCT<{_SCORED}>>>>, chunks ARRAY<STRUCT<{_CHUNK}, events: ARRAY<STRUCT<{_SCORED}>>>>",
    "records": "messages ARRAY<STRUCT<role: STRING, content: STRING>>",
    "predictions": "loss DOUBLE, prompt STRING, gold STRING, pred STRING, exact_match BOOLEAN, ordered STRUCT<ordered_exact: DOUBLE, ordered_line_acc: DOUBLE>, set_counts STRUCT<tp: INT, fp: INT, fn: INT>",
    "split_info": f"seed INT, empty_ratio DOUBLE, test_ratio DOUBLE, train STRUCT<{_STATS}>, test STRUCT<{_STATS}>",
}


def stem_of(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(path), r"^.*/", ""), r"\.[^.]*$", "")


def readable(c: Column) -> Column:
    """The text without bytes that are no UTF-8."""
    return F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit(""))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """doc_id, path, length of the files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(stem_of(F.col("path")).alias("doc_id"), "path", "length")


def read_binary(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, content: one row per file, for pluggable page readers."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(stem_of(F.col("path")).alias("doc_id"), "content")


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """doc_id, text: whole files as UTF-8; bytes that are none are left out."""
    found = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return found.select(stem_of(F.col("_metadata.file_path")).alias("doc_id"), readable(F.col("value")).alias("text"))


def read_lines(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """key, pos, line of every line of a text; any line break ends a line."""
    return docs.select(key, F.posexplode(lines_of(F.col(body))).alias("pos", "line"))


def read_json(spark: SparkSession, folder: str, stage: str, pattern: str = "*.json") -> DataFrame:
    """doc_id and the declared fields of whole-file JSON documents; missing fields are null."""
    found = spark.read.schema(SCHEMAS[stage]).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    return found.select(stem_of(F.col("_metadata.file_path")).alias("doc_id"), "*")


def read_jsonl(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """doc_id (the file's stem), record_no (from 1 in each file, over lines that are not blank) and the declared fields.

    Files are split as usual. A line's number is the count of lines in the blocks of its file before its own, which is one
    row for each block, and its place in the block; so no file is read whole or sorted in one task.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(*at, F.col("value").alias("line")).where(strip(F.col("line")) != "")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))).join(blocks, ["path", "block"])
    return placed.select(stem_of(F.col("path")).alias("doc_id"), (F.col("offset") + F.col("place")).alias("record_no"), F.from_json("line", SCHEMAS[stage]).alias("r")).select("doc_id", "record_no", "r.*")


def read_labels(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id, event_id, chemical, event_type, description_short, description_long of headerless label files."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    docs = files.select(stem_of(F.col("_metadata.file_path")).alias("doc_id"), readable(F.col("value")).alias("text"))
    return label_events(read_lines(docs), "doc_id", "pos", "line")


def label_events(rows: DataFrame, key: str, position: str, raw: str) -> DataFrame:
    """Label events of raw rows: rows with fewer than four fields are dropped but keep their number; more
    fields than four are ignored; fields are stripped."""
    named = row_fields(rows.where(F.col(raw).isNotNull()), raw, "__f")
    f = F.col("__f")
    return named.where(F.size("__f") >= 4).select(key, F.col(position).alias("event_id"), f[0].alias("chemical"), f[1].alias("event_type"), f[2].alias("description_short"), f[3].alias("description_long"))


def pending(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row, nulls written, non-ASCII kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def paper_documents(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """file, content: for each paper one indented JSON document {key, name: [fields of its rows in order]}; nulls are
    written, non-ASCII is kept. A document is one text, so a paper's rows meet in one row here."""
    item = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*fields).alias("__item"))
    listed = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["__item"]).alias(name))
    said = F.to_json(F.struct(key, name), {"ignoreNullFields": "false", "pretty": "true"})
    return listed.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("file"), said.alias("content"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines without internal columns (those that begin with an underscore)."""
    write_json(df.drop(*[c for c in df.columns if c.startswith("_")]), path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def chunk_reports(records: DataFrame, number: str = "record_no") -> DataFrame:
    """file, content: a markdown report of each record's passage, gold and predicted events.

    ``records``: number, passage, gold and pred (arrays of struct(chemical, event_type, description)).
    """
    lines = lambda c: F.when(F.size(c) == 0, F.lit("_none_")).otherwise(F.array_join(F.transform(c, lambda e: F.concat(F.lit("- "), event_line(e["chemical"], e["event_type"], e["description"]))), "\n"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# Chunk "), F.col(number).cast("string")), text("passage"), F.lit("## Gold events"), lines(F.col("gold")), F.lit("## Predicted events"), lines(F.col("pred")))
    return records.select(F.format_string("chunk_%04d.md", F.col(number)).alias("file"), body.alias("content"))


def write_texts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(file, content) rows as text, one folder per file name."""
    df.select("file", F.col("content").alias("value")).write.mode(mode).partitionBy("file").text(path)


def write_lines(df: DataFrame, order: list[str], path: str, mode: str = "overwrite") -> None:
    """(file, line) rows as text, one folder per file name, in ``order``: the parts of a folder follow each other by
    name, so a long report is never sorted in one task."""
    placed = df.repartitionByRange("file", *order).sortWithinPartitions("file", *order)
    placed.select("file", F.col("line").alias("value")).write.mode(mode).partitionBy("file").text(path)


def record_report(counts: DataFrame, totals: DataFrame, key: str = "pair_id") -> DataFrame:
    """file, part, place, line: the text report of an evaluation, a line per record and the summary behind them."""
    hits = F.concat_ws("/", *[F.col(c).cast("bigint").cast("string") for c in ("tp", "fp", "fn")])
    said = lambda lead: F.concat(lead, F.lit(" tp/fp/fn "), hits, F.format_string(" precision %.4f recall %.4f f1 %.4f", "precision", "recall", "f1"))
    rows = counts.select(F.lit("report.txt").alias("file"), F.lit(0).alias("part"), F.col(key).cast("string").alias("place"), said(F.concat(F.lit("record "), F.col(key).cast("string"))).alias("line"))
    return rows.unionByName(totals.select(F.lit("report.txt").alias("file"), F.lit(1).alias("part"), F.lit("").alias("place"), said(F.lit("all")).alias("line")))


@dataclass(frozen=True)
class Settings:
    """Settings of the pipeline, from an INI file; what is missing keeps its default."""

    min_chunk_tokens: int = 96
    target_chunk_tokens: int = 160
    max_chunk_tokens: int = 220
    model_context_tokens: int = 8192
    reserved_output_tokens: int = 300
    safety_margin_tokens: int = 96
    test_ratio: float = 0.15
    empty_ratio: float = 1.0
    k_folds: int = 5
    seed: int = 42

    @classmethod
    def read(cls, path: str) -> Settings:
        ini = configparser.ConfigParser()
        ini.read(path, encoding="utf-8")
        given = {k: v for s in ini.sections() for k, v in ini.items(s)}
        kinds = {f: type(v) for f, v in cls().__dict__.items()}
        return cls(**{k: kind(given[k]) for k, kind in kinds.items() if k in given})
