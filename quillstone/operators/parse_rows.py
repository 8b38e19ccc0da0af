"""Rows that fail to parse: separate faulty delimited rows, with the reason, from typed sound rows.

Each row is first read permissively (``from_csv`` under an explicit schema). A reading that reproduces
the raw row when quoted again is taken as it is; any other row is reclassified from its raw text, which
faulty rows keep as corrupt. The reason is the first that holds of

* ``broken_quoting``  a quoted field is not closed, or has text after its closing quote, or an unquoted
  field holds a quote;
* ``column_count``    not exactly the expected number of fields;
* ``invalid_value``   the type is not MIE, KE or AO, a required field is blank, or a field holds U+FFFD
  or a control character other than tab and line breaks.

Quoting is decided by splitting at the quote sign: pieces with an even index stand outside quotes. The
row is well quoted if their number is odd and each outside piece between two quoted ones is empty (a
doubled quote) or goes from the closed field to a comma and from a comma to the opening quote. Everything
stays in Catalyst; no row is sent to Python and no regular expression backtracks over a field.

Edge cases: null and blank rows and lines ``### END`` are no rows. Very long fields cost time linear in
their length. An empty table gives an empty result. Extra columns are carried along by the caller's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.columns import once

#: The event types.
EVENT_TYPES = ("MIE", "KE", "AO")
#: Fixed value: the line that closes an answer.
END_MARK = "### END"

#: White space that does not count around a field.
_EDGE = r"^[ \t\r\n]+|[ \t\r\n]+$"
_BAD_CHAR = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"

LABEL_FIELDS = ("chemical", "event_type", "event_description_short", "event_description_long")
PRED_FIELDS = ("chemical", "event_type", "description")


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_row(c: Column) -> Column:
    """Not null, not blank, not the end marker."""
    bare = F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F\x{FEFF}]+|[\s\x1C-\x1F\x{FEFF}]+$", "")
    return c.isNotNull() & (bare != "") & (bare != END_MARK)


def quote_pieces(raw: Column) -> Column:
    """The pieces between quote signs; those with an even index stand outside quotes."""
    return F.split(raw, '"', -1)


def well_quoted(pieces: Column) -> Column:
    n = F.size(pieces)

    def good(p: Column, i: Column) -> Column:
        opens = p.rlike(r"^[ \t\r\n]*$|,[ \t\r\n]*$")
        closes = p.rlike(r"^[ \t\r\n]*$|^[ \t\r\n]*,")
        between = (p == "") | (p.rlike(r"^[ \t\r\n]*,") & p.rlike(r",[ \t\r\n]*$"))
        return F.when(i % 2 == 1, F.lit(True)).when(n == 1, F.lit(True)).when(i == 0, opens).when(i == n - 1, closes).otherwise(between)

    return (n % 2 == 1) & F.forall(F.transform(pieces, good), lambda x: x)


def split_fields(pieces: Column) -> Column:
    """The fields of a well quoted row, unquoted and stripped.

    Commas outside quotes become ``~c`` and every ``~`` of the text ``~t``, so that joining the pieces and
    splitting at ``~c`` is unambiguous whatever the text holds.
    """
    n = F.size(pieces)

    def encode(p: Column, i: Column) -> Column:
        safe = F.replace(p, F.lit("~"), F.lit("~t"))
        doubled = (i % 2 == 0) & (i > 0) & (i < n - 1) & (p == "")
        return F.when(i % 2 == 1, safe).when(doubled, F.lit('"')).otherwise(F.replace(safe, F.lit(","), F.lit("~c")))

    joined = F.array_join(F.transform(pieces, encode), "")
    return F.transform(F.split(joined, "~c", -1), lambda x: strip_edges(F.replace(x, F.lit("~t"), F.lit("~"))))


def classify_rows(rows: DataFrame, raw: str, fields: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns ``reason`` and ``corrupt`` (the raw text of a faulty row), both null for sound
    rows, and ``fields`` (a struct of typed fields, null for faulty ones).

    The reader's reading is taken where it gives back the raw row; all others are reclassified.
    """
    schema = ", ".join(f"{f} STRING" for f in (*fields, "_corrupt"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    read = once(rows.where(is_row(F.col(raw))), "__read", F.from_csv(F.col(raw), schema, options))
    got = [F.col(f"__read.{x}") for x in fields]
    requoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for x in got])
    plain = F.col("__read._corrupt").isNull() & (requoted == F.col(raw))
    read = once(read, "__plain", plain)
    read = once(read, "__pieces", F.when(~F.col("__plain"), quote_pieces(F.col(raw))))
    read = once(read, "__quoted", F.when(F.col("__plain"), F.lit(True)).otherwise(well_quoted(F.col("__pieces"))))
    by_reader = F.array(*[strip_edges(F.coalesce(x, F.lit(""))) for x in got])
    split = once(read, "__fields", F.when(F.col("__plain"), by_reader).when(F.col("__quoted"), split_fields(F.col("__pieces"))))
    f = F.col("__fields")
    named = {name: F.get(f, F.lit(i)) for i, name in enumerate(fields)}
    bad_value = ~F.upper(named["event_type"]).isin(*EVENT_TYPES) | F.exists(f, lambda x: x.rlike(_BAD_CHAR))
    for name in required:
        bad_value = bad_value | ~named[name].rlike(r"(?U)[^\s]")
    reason = F.when(~F.col("__quoted"), "broken_quoting").when(F.size(f) != len(fields), "column_count").when(bad_value, "invalid_value")
    typed = F.struct(*[(F.upper(named[x]) if x == "event_type" else named[x]).alias(x) for x in fields])
    return (
        once(split, "reason", reason)
        .withColumn("corrupt", F.when(F.col("reason").isNotNull(), F.col(raw)))
        .withColumn("fields", F.when(F.col("reason").isNull(), typed))
        .drop("__read", "__plain", "__pieces", "__quoted", "__fields")
    )


def label_rows(labels: DataFrame) -> DataFrame:
    """Rows of ``label_lines``, classified: src, row_id, line_no, raw, reason, corrupt, fields."""
    rows = labels.select(F.lit("label_lines").alias("src"), F.col("label_id").alias("row_id"), F.lit(0).alias("line_no"), F.col("raw_line").alias("raw"))
    return classify_rows(rows, "raw", LABEL_FIELDS, ("chemical", "event_description_short"))


def pred_rows(preds: DataFrame) -> DataFrame:
    """Lines of ``eval_preds.pred``, classified; ``line_no`` counts from 1."""
    lines = preds.select(F.lit("eval_preds").alias("src"), F.col("pair_id").alias("row_id"), F.posexplode(F.split("pred", "\n", -1)).alias("pos", "raw"))
    rows = lines.select("src", "row_id", (F.col("pos") + 1).alias("line_no"), "raw")
    return classify_rows(rows, "raw", PRED_FIELDS, ("chemical", "description"))


def faulty_rows(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """src, row_id, line_no, reason of each faulty row of both tables."""
    cols = ["src", "row_id", "line_no", "reason"]
    both = label_rows(labels).select(cols).unionByName(pred_rows(preds).select(cols))
    return both.where(F.col("reason").isNotNull())


def sound_rows(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """The sound rows as typed columns: src, row_id, line_no, chemical, event_type, description_short, description_long."""
    a = label_rows(labels).where("reason IS NULL").select("src", "row_id", "line_no", F.col("fields.chemical").alias("chemical"), F.col("fields.event_type").alias("event_type"), F.col("fields.event_description_short").alias("description_short"), F.col("fields.event_description_long").alias("description_long"))
    b = pred_rows(preds).where("reason IS NULL").select("src", "row_id", "line_no", F.col("fields.chemical").alias("chemical"), F.col("fields.event_type").alias("event_type"), F.col("fields.description").alias("description_short"), F.lit(None).cast("string").alias("description_long"))
    return a.unionByName(b)
