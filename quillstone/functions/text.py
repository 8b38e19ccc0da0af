"""Text normalisation and containment tests as column functions.

White space is that of Unicode together with the four ASCII separators, as text tools outside the JVM see
it. Null counts as the empty text throughout, and the empty needle is found nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.columns import let

#: One white space character.
WS = r"[\s\x1C-\x1F\x{85}]"


def text(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text(c), rf"(?U){WS}+", " "))


def norm(c: Column) -> Column:
    """``squeeze`` in lower case."""
    return squeeze(F.lower(text(c)))


def csv_quote(c: Column) -> Column:
    """The value in double quotes, inner quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))


def contains_normalised(haystack: Column, needle: Column) -> Column:
    """Whether the normalised needle stands in the normalised haystack; a needle of white space does."""
    return (text(needle) != "") & F.contains(norm(haystack), norm(needle))


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether the needle's words follow each other in the haystack, not inside longer words."""
    words = squeeze(F.lower(text(needle)))
    quoted = F.replace(F.replace(words, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.concat(F.lit("\\E"), F.lit(rf"{WS}+"), F.lit("\\Q")))
    pattern = F.concat(F.lit(r"(?U)(?<![\w])\Q"), quoted, F.lit(r"\E(?![\w])"))
    return (words != "") & F.rlike(F.lower(text(haystack)), pattern)


def lines_of(c: Column) -> Column:
    """The lines of a text; every kind of line break ends a line, one at the very end adds none."""
    same = F.regexp_replace(text(c), r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]", "\n")
    # the text is named once, so that rules over lines can be nested without computing it again
    return let(same, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, r"\n\z", ""), "\n", -1)))


def preview(c: Column, n: int = 120) -> Column:
    """The first ``n`` characters, with an ellipsis where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def alnum_ratio(c: Column) -> Column:
    """Share of letters and digits; 0 for the empty text."""
    kept = F.length(F.regexp_replace(text(c), r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(text(c)) > 0, kept / F.length(text(c))).otherwise(0.0)


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often the needle stands in the haystack, case aside, without overlaps."""
    h, n = F.lower(text(haystack)), F.lower(text(needle))
    return F.when(n == "", 0).otherwise(((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("int"))


def places(haystack: Column, needle: Column) -> Column:
    """The positions (from 1) of the needle in the haystack, case aside, without overlaps."""
    h, n = F.lower(text(haystack)), F.lower(text(needle))

    def of(x: Column) -> Column:
        # the text in front of each place, and the needles before it
        start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next"))
        parts = F.split(x, F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
        step = lambda acc, p: F.struct(F.concat(acc["at"], F.array(acc["next"] + F.length(p))).alias("at"), (acc["next"] + F.length(p) + F.length(n)).alias("next"))
        return let(parts, lambda ps: F.aggregate(F.slice(ps, F.lit(1), F.size(ps) - 1), start, step, lambda acc: acc["at"]))

    return F.when(n == "", F.array().cast("array<int>")).otherwise(let(h, of))


def normal_places(c: Column) -> Column:
    """For each character of the squeezed text its position (from 1) in the original; a run of white space counts
    as its first character, none at the ends."""
    def of(s: Column) -> Column:
        blank = lambda i: F.substr(s, i, F.lit(1)).rlike(rf"(?U){WS}")
        first, last = F.length(s) - F.length(lstrip(s)) + 1, F.length(rstrip(s))
        kept = lambda i: ~blank(i) | ~blank(i - 1)
        return F.when(first > last, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(first, last), kept))

    return let(text(c), of)
