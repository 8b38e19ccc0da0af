"""Tables as arrays of rows: padding, header detection, fill-down and serialisation, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.columns import let
from quillstone.functions.text import squeeze


def clean_cell(c: Column) -> Column:
    """Null as the empty text; white space squeezed."""
    return squeeze(c)


def normalise_header(c: Column) -> Column:
    return F.lower(clean_cell(c))


def clean_rows(rows: Column) -> Column:
    """Cells cleaned, rows without any text dropped."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda x: x != ""))


def pad_rows(rows: Column) -> Column:
    """All rows as long as the longest, filled with empty texts."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return let(F.struct(rows.alias("r"), width.alias("w")), lambda s: F.transform(s["r"], lambda r: F.concat(r, F.array_repeat(F.lit(""), s["w"] - F.size(r)))))


def looks_like_header(row: Column) -> Column:
    """At least half of the cells have text, and fewer than half of those are numbers."""

    def test(cells: Column) -> Column:
        full = F.filter(cells, lambda x: x != "")
        numeric = F.size(F.filter(full, lambda x: x.rlike(r"^[%\d.,\-+()/]+$")))
        return (F.size(full) >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2))) & (numeric < F.size(full) / 2)

    return let(F.transform(row, clean_cell), test)


def fill_down(rows: Column) -> Column:
    """An empty cell takes the (filled) cell above, if another cell of its row has text."""
    padded = pad_rows(rows)

    def step(acc: Column, row: Column) -> Column:
        above = F.try_element_at(acc, F.lit(-1))
        others = lambda i: F.exists(F.transform(row, lambda x, j: (x != "") & (j != i)), lambda y: y)
        filled = F.transform(row, lambda x, i: F.when((x == "") & others(i), F.get(above, i)).otherwise(x))
        return F.concat(acc, F.array(filled))

    start = F.array().cast("array<array<string>>")
    return F.aggregate(padded, start, lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).otherwise(step(acc, r)))


def serialise(rows: Column, label: Column) -> Column:
    """``label:`` and the rows as ``header value`` pieces; null if nothing is left to say."""

    def write(s: Column) -> Column:
        has_head = (F.size(s) >= 2) & looks_like_header(F.get(s, F.lit(0)))
        heads = F.when(has_head, F.transform(F.get(s, F.lit(0)), normalise_header)).otherwise(F.transform(F.get(s, F.lit(0)), lambda x: F.lit("")))
        data = F.when(has_head, F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)

        def line(hs: Column, r: Column) -> Column:
            named = F.transform(r, lambda x, i: F.when(x == "", F.lit("")).otherwise(F.concat(F.get(hs, i), F.when(F.get(hs, i) == "", "").otherwise(" "), x)))
            return F.array_join(F.filter(named, lambda x: x != ""), ", ")

        def body(parts: Column) -> Column:
            texts = F.filter(F.transform(parts["rows"], lambda r: line(parts["heads"], r)), lambda x: x != "")
            return F.when(F.size(texts) > 0, F.concat(label, F.lit(":\n"), F.array_join(texts, ". "), F.lit(".")))

        return F.when(F.size(s) > 0, let(F.struct(heads.alias("heads"), fill_down(data).alias("rows")), body))

    return let(pad_rows(clean_rows(rows)), write)


def numbered(items: DataFrame, key: str, order: list[str], usable: Column, label: str) -> DataFrame:
    """The usable items of a document with their number and heading: every item takes a number, also one that fails."""
    ranked = items.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(usable).withColumn("heading", F.concat(F.lit(f"## {label} "), F.col("number").cast("string"), F.lit(":")))
