"""Splitting oversized texts at natural boundaries, with overlap.

The unit is a run of letters, digits and underscores or any other single character that is no white
space; a text of n units counts floor(1.25 n) tokens. Each gap between units has a strength (paragraph,
line, sentence, clause, comma, word, none). A sparse table over the strengths answers range-maximum
queries: the next cut is the strongest gap in the permissible window of lengths, the rightmost one among
equals. The next piece starts about ``overlap`` tokens before the cut, at the strongest gap near there.

Edge cases: a null or blank text gives no piece; a text within the limit gives one piece; the pieces
cover the text in order and without loss (piece i without its first ``overlap_chars`` characters,
appended to the pieces before, gives the text); a single unit longer than any limit stays whole, as units
are not cut. Ties are broken rightward. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"\w+|[^\w\s]")

#: Gap strengths: none, word, comma, clause, sentence, line, paragraph.
NONE, WORD, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_CLOSERS = "\"')]}”’»"
_SENTENCE_END = ".!?。！？؟।…"
_CLAUSE_END = ";:؛；："
_COMMAS = ",،、，"


def units_within(tokens: int) -> int:
    """The largest n with floor(1.25 n) <= tokens."""
    return (4 * tokens + 3) // 5


def tokens_of(units: int) -> int:
    return 5 * units // 4


def gap_strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the gap before each unit 1..n-1."""
    out = np.zeros(max(len(starts) - 1, 0), dtype=np.int8)
    for i in range(1, len(starts)):
        gap = text[ends[i - 1] : starts[i]]
        if not gap:
            continue
        breaks = gap.count("\n")
        if breaks > 1:
            out[i - 1] = PARAGRAPH
            continue
        j = ends[i - 1] - 1
        while j > 0 and text[j] in _CLOSERS:
            j -= 1
        last = text[j]
        if last in _SENTENCE_END:
            out[i - 1] = SENTENCE if not breaks else LINE
        elif breaks:
            # a line break inside a sentence is only the wrapping of a line
            out[i - 1] = LINE if text[starts[i]] == "#" else CLAUSE if last in _CLAUSE_END else COMMA if last in _COMMAS else WORD
        elif last in _CLAUSE_END:
            out[i - 1] = CLAUSE
        elif last in _COMMAS:
            out[i - 1] = COMMA
        else:
            out[i - 1] = WORD
    return out


class SparseTable:
    """Range maximum in O(1) after O(n log n); among equals the rightmost index."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # value first, then index: one maximum answers both
        base = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.rows = n, [base]
        width = 1
        while 2 * width <= n:
            prev = self.rows[-1]
            self.rows.append(np.maximum(prev[:-width], prev[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Index of the maximum in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k) + 1])) % (self.n + 1)


def split_text(text: str | None, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap_chars, tokens) of the pieces; ``start`` and ``end`` are offsets in ``text``."""
    if not text:
        return []
    spans = [m.span() for m in UNIT.finditer(text)]
    n, limit = len(spans), units_within(max_tokens)
    if not n:
        return []
    if n <= limit:
        return [(0, len(text), 0, tokens_of(n))]
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    table = SparseTable(gap_strengths(text, starts, ends))
    back = min(units_within(overlap_tokens), limit // 2)
    slack = max(back // 4, 1)
    pieces, first, done = [], 0, 0  # units: first of this piece, first not yet covered
    while True:
        if n - first <= limit:
            cut = n
        else:
            # gap g stands before unit g + 1; a piece takes at least half of the room it has left
            lo = max(done + 1, first + (limit + 1) // 2)
            cut = table.argmax(lo - 1, first + limit - 1) + 1
        begin = 0 if first == 0 else int(starts[first])
        stop = len(text) if cut == n else int(starts[cut])
        covered = 0 if first == 0 else int(starts[done]) - begin
        pieces.append((begin, stop, covered, tokens_of(cut - first)))
        if cut == n:
            return pieces
        lo, hi = max(first + 1, cut - back - slack), max(first + 1, cut - back + slack)
        done = cut
        first = table.argmax(lo - 1, min(hi, cut - 1) - 1) + 1 if back and min(hi, cut - 1) >= lo else cut


def split_oversized(chunks: DataFrame, key: str = "chunk_key", text: str = "text", max_tokens: int = 220, overlap_tokens: int = 30) -> DataFrame:
    """key, piece_no (from 1), n_pieces, start_char, overlap_chars, n_tokens, piece; one pass, no shuffle."""
    kind = chunks.schema[key].dataType.simpleString()
    names = [key, "piece_no", "n_pieces", "start_char", "overlap_chars", "n_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = split_text(t, max_tokens, overlap_tokens)
                for no, (start, stop, covered, tokens) in enumerate(parts, 1):
                    source.append(i)
                    for col, v in zip(cols, (no, len(parts), start, covered, tokens, t[start:stop])):
                        col.append(v)
            kinds = [pa.int32()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start_char int, overlap_chars int, n_tokens int, piece string"
    return chunks.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def oversized(chunks: DataFrame, key: str = "chunk_key", text: str = "text", max_tokens: int = 220) -> DataFrame:
    """The keys of the texts that had to be cut."""
    return split_oversized(chunks, key, text, max_tokens).where("piece_no = 2").select(key)
