"""Event rows: names of a chemical, parsing of answers, canonical forms and line metrics."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.columns import let, once
from quillstone.functions.text import contains_words, csv_quote, lines_of, norm, squeeze, strip, text
from quillstone.operators.parse_rows import quote_pieces, split_fields

#: Lines that stand for "no events" or close an answer, in lower case.
SENTINELS = ("no_events", "no event identified", "no aop identified", "### end")
#: Fixed value: the pattern of such a line, with any white space inside.
SENTINEL_LINE = r"(?iU)^\s*(NO_EVENTS|NO\s+EVENT\s+IDENTIFIED|NO\s+AOP\s+IDENTIFIED|###\s*END)\s*$"
END_MARK = "### END"
TYPE_ORDER = ("MIE", "KE", "AO")
#: A numbered compound in a name, and the lead of a list of such numbers in a text.
NUMBERED = r"(?i)(?:compound|no[.:]?)\s*(\d+)"
NUMBER_LIST = r"(?iU)(?:compound[s]?|no[.:]?)\s*[\d,and\s]*\b"


def label_names(chemical: Column) -> Column:
    """struct(base, abbr): ``X [abbr]``, else ``X (abbr)``, else ``A / B`` (first slash); abbr may be null."""
    c = text(chemical)

    def cut(left: str, right: str) -> tuple[Column, Column]:
        at = F.length(c) - F.locate(left[::-1], F.reverse(c)) - len(left) + 2
        return strip(F.substring(c, F.lit(1), at - 1)), strip(F.substring(c, at + len(left), F.length(c) - at - len(left)))

    square, round_ = cut(" [", "]"), cut(" (", ")")
    slash = F.split(c, " / ", 2)
    is_square = F.contains(c, F.lit(" [")) & F.endswith(c, F.lit("]"))
    is_round = F.contains(c, F.lit(" (")) & F.endswith(c, F.lit(")"))
    is_slash = F.contains(c, F.lit(" / "))
    base = F.when(is_square, square[0]).when(is_round, round_[0]).when(is_slash, strip(slash[0])).otherwise(strip(c))
    abbr = F.when(is_square, square[1]).when(is_round, round_[1]).when(is_slash, strip(F.get(slash, F.lit(1))))
    return F.struct(base.alias("base"), abbr.alias("abbr"))


def prediction_names(chemical: Column) -> Column:
    """As ``label_names`` without the square form."""
    c = text(chemical)
    at = F.length(c) - F.locate("( ", F.reverse(c))
    is_round = F.contains(c, F.lit(" (")) & F.endswith(c, F.lit(")"))
    is_slash = F.contains(c, F.lit(" / "))
    slash = F.split(c, " / ", 2)
    base = F.when(is_round, strip(F.substring(c, F.lit(1), at - 1))).when(is_slash, strip(slash[0])).otherwise(strip(c))
    abbr = F.when(is_round, strip(F.substring(c, at + 2, F.length(c) - at - 2))).when(is_slash, strip(F.get(slash, F.lit(1))))
    return F.struct(base.alias("base"), abbr.alias("abbr"))


def name_set(chemical: Column) -> Column:
    """All normalised names: the whole, base and abbreviation in round brackets, every part between slashes."""

    def names(c: Column) -> Column:
        at = F.length(c) - F.locate("( ", F.reverse(c))
        is_round = F.contains(c, F.lit(" (")) & F.endswith(c, F.lit(")"))
        both = F.array(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 2, F.length(c) - at - 2))
        none = F.array().cast("array<string>")
        parts = F.when(F.contains(c, F.lit(" / ")), F.split(c, " / ", -1)).otherwise(none)
        every = F.concat(F.array(c), F.when(is_round, both).otherwise(none), parts)
        return F.array_distinct(F.filter(F.transform(every, norm), lambda x: x != ""))

    return let(strip(text(chemical)), names)


def same_chemical(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_set(a), name_set(b))


def found_name(body: Column, chemical: Column) -> Column:
    """struct(found, variant): the first of raw, base, abbreviation that stands in the text as whole words,
    else a compound number of the base listed in the text; the variant is the raw name if none is found."""

    def look(names: Column) -> Column:
        raw, base, abbr = text(chemical), names["base"], text(names["abbr"])
        number = F.regexp_extract(base, NUMBERED, 1)
        listed = (number != "") & F.rlike(text(body), F.concat(F.lit(NUMBER_LIST), number, F.lit(r"\b")))
        hit = (
            F.when(raw == "", F.lit(None).cast("string"))
            .when(contains_words(body, raw), raw)
            .when((base != "") & (base != raw) & contains_words(body, base), base)
            .when((abbr != "") & (abbr != raw) & contains_words(body, abbr), abbr)
            .when((base != "") & listed, base)
        )
        return let(hit, lambda h: F.struct(h.isNotNull().alias("found"), F.coalesce(h, raw).alias("variant")))

    return let(label_names(chemical), look)


def found_prediction(body: Column, chemical: Column) -> Column:
    """Whether raw, base or abbreviation of a predicted chemical stands in the text as whole words."""
    names = prediction_names(chemical)
    raw, base, abbr = text(chemical), names["base"], text(names["abbr"])
    return ((raw != "") & contains_words(body, raw)) | ((base != "") & (base != raw) & contains_words(body, base)) | ((abbr != "") & contains_words(body, abbr))


def event_line(chemical: Column, event_type: Column, description: Column) -> Column:
    return F.concat_ws(",", csv_quote(chemical), csv_quote(event_type), csv_quote(description))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lenient(rows: pd.Series) -> pd.Series:
    def read(row: str | None) -> list[str] | None:
        if row is None:
            return None
        try:
            return [x.strip() for x in next(csv.reader([row]), [])]
        except csv.Error:
            return []

    return rows.map(read)


def row_fields(df: DataFrame, raw: str, name: str) -> DataFrame:
    """``df`` with the stripped fields of a comma separated row.

    Rows whose quotes stand only at the edges of fields are split in the JVM. The others are read leniently,
    as common readers do: a quote inside an unquoted field is a plain sign, text after a closing quote
    belongs to the field, an unclosed quote runs to the end.
    """
    pieces = once(df, "__pieces", quote_pieces(F.col(raw)))
    n = F.size("__pieces")
    edge = lambda p, i: F.when(i % 2 == 1, F.lit(True)).when(n == 1, F.lit(True)).when(i == 0, (p == "") | F.endswith(p, F.lit(","))).when(i == n - 1, (p == "") | F.startswith(p, F.lit(","))).otherwise((p == "") | (F.startswith(p, F.lit(",")) & F.endswith(p, F.lit(","))))
    tight = once(pieces, "__tight", (n % 2 == 1) & F.forall(F.transform("__pieces", edge), lambda x: x))
    return tight.withColumn(name, F.when(F.col("__tight"), split_fields(F.col("__pieces"))).otherwise(_lenient(F.when(~F.col("__tight"), F.col(raw))))).drop("__pieces", "__tight")


def parsed_lines(df: DataFrame, answer: str) -> DataFrame:
    """``df`` with one row per visible line of ``answer``: line_pos, line, fields (stripped; lenient quoting)."""
    rows = df.select("*", F.posexplode(lines_of(F.col(answer))).alias("line_pos", "__line")).withColumn("line", strip(F.col("__line"))).drop("__line").where("line <> ''")
    return row_fields(rows, "line", "fields")


def parse_events(df: DataFrame, answer: str, strict: bool = False) -> DataFrame:
    """Rows of at least three fields: chemical, event_type, description. ``strict`` upper-cases the type and
    asks for three fields that are not empty."""
    rows = parsed_lines(df, answer).where(F.size("fields") >= 3)
    t = F.upper(F.col("fields")[1]) if strict else F.col("fields")[1]
    out = rows.withColumn("chemical", F.col("fields")[0]).withColumn("event_type", t).withColumn("description", F.col("fields")[2]).drop("line", "fields")
    return out.where("chemical <> '' AND event_type <> '' AND description <> ''") if strict else out


def parse_stats(df: DataFrame, key: str, answer: str) -> DataFrame:
    """key, total_lines, valid_lines (three fields that are not empty) of each answer."""
    lines = parsed_lines(df.select(key, answer), answer)
    f = F.col("fields")
    valid = (F.size(f) >= 3) & (f[0] != "") & (f[1] != "") & (f[2] != "")
    stats = lines.groupBy(key).agg(F.count("*").alias("total_lines"), F.count_if(valid).alias("valid_lines"))
    return df.select(key).join(stats, key, "left").na.fill({"total_lines": 0, "valid_lines": 0})


def canonical_answer(c: Column) -> Column:
    """Lines stripped, blank lines and sentinels dropped, sorted without regard to case (stable)."""
    kept = F.filter(F.transform(lines_of(c), strip), lambda x: (x != "") & ~F.lower(x).isin(*SENTINELS))
    keyed = F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "\n")


def canonical_target(c: Column) -> Column:
    """The training form: lines stripped, blank lines dropped, sorted by code points; sentinels stay."""
    return F.array_join(F.array_sort(F.filter(F.transform(lines_of(c), strip), lambda x: x != "")), "\n")


def event_lines(c: Column) -> Column:
    """Normalised lines in order, without blank lines and sentinels."""
    kept = F.filter(F.transform(lines_of(c), strip), lambda x: (x != "") & ~x.rlike(SENTINEL_LINE))
    return F.transform(kept, squeeze)


def event_triples(c: Column) -> Column:
    """The distinct field triples of the lines."""
    triple = lambda f: F.struct(F.get(f, F.lit(0)).alias("chemical"), F.get(f, F.lit(1)).alias("event_type"), F.get(f, F.lit(2)).alias("description"))
    parsed = F.transform(event_lines(c), lambda x: split_fields(quote_pieces(x)))
    return F.array_distinct(F.transform(F.filter(parsed, lambda f: F.size(f) >= 3), triple))


def ordered_metrics(pred: Column, gold: Column) -> Column:
    """struct(ordered_exact, ordered_line_acc) of two arrays of lines."""
    same = F.size(F.filter(F.zip_with(pred, gold, lambda p, g: F.coalesce(p == g, F.lit(False))), lambda x: x))
    none_gold = F.size(gold) == 0
    exact = F.when(none_gold & (F.size(pred) == 0), 1.0).when(none_gold, 0.0).when(pred == gold, 1.0).otherwise(0.0)
    acc = F.when(none_gold & (F.size(pred) == 0), 1.0).when(none_gold, 0.0).otherwise(same / F.size(gold))
    return F.struct(exact.alias("ordered_exact"), acc.alias("ordered_line_acc"))


def set_counts(pred: Column, gold: Column) -> Column:
    """struct(tp, fp, fn) by sets of lines."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    return F.struct(F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def merged_prompt(messages: Column) -> Column:
    """struct(user, assistant): the last message of each role counts; system and user with a blank line between."""
    last = lambda role: text(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"])
    said = F.filter(F.array(last("system"), last("user")), lambda x: x != "")
    return F.struct(strip(F.array_join(said, "\n\n")).alias("user"), last("assistant").alias("assistant"))


def prompt_passage(prompt: Column, prefix: str | None = None) -> Column:
    """The passage of a prompt: after the first line ``Text:``; else after the last ``text:``; else all.

    With ``prefix`` the instruction is taken off first; if its end is itself such a line, what follows is
    searched again, so a passage that holds ``text:`` loses what stands before it.
    """
    p = text(prompt)
    if prefix:
        p = F.when(F.startswith(p, F.lit(prefix)), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(p)

    def find(q: Column) -> Column:
        marked = q.rlike(r"(?i)(?:^|\n)Text:\s*\n")
        after = F.regexp_replace(q, r"(?is)\A.*?(?:^|(?<=\n))Text:\s*\n", "")
        inline = F.contains(F.lower(q), F.lit("text:"))
        tail = F.substring_index(F.lower(q), "text:", -1)
        return strip(F.when(marked, after).when(inline, F.right(q, F.length(tail))).otherwise(q))

    return let(p, find)


def type_rank(c: Column) -> Column:
    t = F.upper(text(c))
    return F.when(t == "MIE", 0).when(t == "KE", 1).when(t == "AO", 2).otherwise(99)
