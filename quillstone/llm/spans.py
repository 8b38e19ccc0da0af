"""Long exact spans shared between records, by sliding sentence spans.

Every span is hashed at an anchor and joined with all others globally. Anchors are sentence ends: the
hashed span starts at the closing sign of a sentence and runs over the sentences that follow, for half of
the wanted length. A shared stretch need not hold a whole sentence, so spans between sentence ends alone
would lose some: wherever ``window`` consecutive start positions hold no sentence end, the position with
the smallest hash is the anchor instead. Either choice depends only on the characters of the stretch, so
any two texts with an identical run of ``min_chars`` code points share an anchor inside that run (and no
text is left out, whatever its punctuation). Candidates are then verified character by character.

One pass over the rows gives each the 128-bit fingerprint of its text and its anchors; the texts themselves are
read once more, for those that have a candidate. Texts that are equal as a whole are one class, named by
its smallest key; pairs are expanded to members at the end. An anchor that occurs in more than ``PAIR_LIMIT``
texts is refined by the hashes of all ``min_chars``-windows that hold it, so that texts are paired only if they
share such a window. Coverage (``shared_extent``) needs no pairs at all: a window counts if another text has it.

Classes, anchors and windows may each stand in a third of all rows: they meet their rows in ``attach`` or in
salted tasks (``spread``).

Edge cases: null texts and texts under ``min_chars`` share nothing; repeated rows pair with each other;
an empty table gives an empty result; lengths are counted in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.columns import let, once
from quillstone.operators.skew import attach, spread
from quillstone.session import cut, stored

#: Texts that share an anchor are paired directly up to this number, else over refined windows.
PAIR_LIMIT = 32
#: Code points hashed at once (memory bound, no effect on results).
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        _POW.update(n=n, up=_powers(_BASE, n), down=_powers(_INVERSE, n))
    return _POW["up"], _POW["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` code points."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _tables(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * up[:n], out=total[1:])
    return _mix((total[k:] - total[:-k]) * down[: n + 1 - k])


def sentence_ends(codes: np.ndarray) -> np.ndarray:
    """Whether a position closes a sentence: . ! ? before white space, or a line break before text."""
    out = np.zeros(len(codes), dtype=bool)
    if len(codes) > 1:
        here, after = codes[:-1], codes[1:]
        blank = (after == 32) | (after == 10) | (after == 13)
        out[:-1] = (((here == 46) | (here == 33) | (here == 63)) & blank) | ((here == 10) & ~blank)
    return out


def anchors(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions chosen in ``codes`` and the hashes of the ``k`` code points from there."""
    n = len(codes)
    if n < k + window - 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    places, values = [], []
    step = max(BLOCK, 2 * (k + window))
    for start in range(0, n - (k + window - 1) + 1, step):
        part = codes[start : start + step + k + window - 2]
        h = window_hashes(part, k)
        # sentence ends come first: their rank loses the top bit, all others gain it
        rank = (h >> np.uint64(1)) | np.where(sentence_ends(part)[: len(h)], np.uint64(0), np.uint64(1 << 63))
        low = rank.copy()
        width = 1
        while width < window:  # minimum over `window` positions by doubling
            more = min(width, window - width)
            low = np.minimum(low[:-more], low[more:])
            width += more
        # a position is chosen if it has the minimum of some window that holds it
        m = len(low)
        reach = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
        width = 1
        while width < window:
            more = min(width, window - width)
            reach = np.maximum(reach[:-more], reach[more:])
            width += more
        at = np.flatnonzero(rank[: m + window - 1] <= reach)
        places.append(at + start)
        values.append(h[at])
    place, value = np.concatenate(places), np.concatenate(values)
    if len(places) > 1:
        place, first = np.unique(place, return_index=True)
        value = value[first]
    return place, value


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _drop_repeats(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return order[first]


def signed(docs: DataFrame, min_chars: int) -> DataFrame:
    """key, print, spans of the rows (key, text) long enough to share anything: the 128-bit fingerprint of
    the text and its distinct anchor hashes; one pass, no shuffle."""
    k = min_chars // 2
    window = min_chars - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # Short texts are hashed together. Windows over a seam add anchors but remove none, and
                # spans that run over the end of their text are dropped.
                begin, size = at, 0
                while at < len(texts) and (at == begin or size + len(texts[at]) <= BLOCK):
                    size += len(texts[at])
                    at += 1
                codes = [_codes(t) for t in texts[begin:at]]
                starts = np.cumsum([0, *map(len, codes)])
                place, value = anchors(np.concatenate(codes), k, window)
                owner = np.searchsorted(starts, place, side="right") - 1
                keep = place + k <= starts[owner + 1]
                owner, value = owner[keep], value[keep]
                kept = _drop_repeats(owner, value)
                sizes = np.bincount(owner[kept], minlength=at - begin)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(value[kept].view(np.int64)))
                prints = pa.array([xxhash.xxh3_128_digest(c.tobytes()) for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.slice(begin, at - begin), prints, lists], names=["key", "print", "spans"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.where(F.length("text") >= min_chars).select("key", "text").mapInArrow(run, f"key {kind}, print binary, spans array<bigint>")


def _ranges(codes: np.ndarray, starts: np.ndarray, length: int) -> list[list[int]]:
    """Start and end of the stretches covered by windows of ``length`` at ``starts`` (sorted)."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    lo = starts[np.concatenate([[0], breaks + 1])]
    hi = starts[np.concatenate([breaks, [len(starts) - 1]])] + length
    return np.stack([lo, hi], axis=1).tolist()


def _same_windows(a: str, b: str, ha: np.ndarray, hb: np.ndarray, k: int) -> np.ndarray:
    """The windows of ``a`` that ``b`` holds, each compared with one of equal hash character by character."""
    order = np.argsort(hb, kind="stable")
    at = np.searchsorted(hb[order], ha)
    hit = np.flatnonzero((at < len(hb)) & (hb[order[np.minimum(at, len(hb) - 1)]] == ha)) if len(hb) else np.empty(0, dtype=np.int64)
    other = order[at[hit]]
    # windows that follow each other in both texts are compared as one stretch
    breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(other) != 1)) + 1
    good = []
    for x, y in zip(np.split(hit, breaks), np.split(other, breaks)):
        if len(x) and a[x[0] : x[-1] + k] == b[y[0] : y[-1] + k]:
            good.append(x)
        else:
            good.append(np.array([i for i in x.tolist() if a[i : i + k] in b], dtype=np.int64))
    return np.concatenate(good) if good else hit


def common_ranges(a: str, b: str, min_chars: int) -> tuple[list[list[int]], list[list[int]]]:
    """The stretches of ``a`` and of ``b`` covered by identical runs of ``min_chars`` or more."""
    ca, cb = _codes(a), _codes(b)
    ha, hb = window_hashes(ca, min_chars), window_hashes(cb, min_chars)
    return _ranges(ca, _same_windows(a, b, ha, hb, min_chars), min_chars), _ranges(cb, _same_windows(b, a, hb, ha, min_chars), min_chars)


def _windows_at(text: str, spans: list[int], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``min_chars`` that hold one of the anchors ``spans``; linear memory."""
    k = min_chars // 2
    window = min_chars - k + 1
    codes = _codes(text)
    place, value = anchors(codes, k, window)
    whole = window_hashes(codes, min_chars)
    hit = place[np.isin(value.view(np.int64), np.array(spans, dtype=np.int64))]
    edge = np.zeros(len(whole) + 1, dtype=np.int64)
    np.add.at(edge, np.clip(hit - window + 1, 0, len(whole)), 1)
    np.add.at(edge, np.clip(hit + 1, 0, len(whole)), -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return starts, whole[starts].view(np.int64)


class _Corpus:
    """The rows to compare: ``members`` (key, cls), ``sizes`` (cls, n), ``prints`` (cls, span) of one row of each class."""

    def __init__(self, docs: DataFrame, key: str, text: str, min_chars: int):
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.min_chars = min_chars
        rows = cut(signed(self.docs, min_chars))
        classes = cut(rows.groupBy("print").agg(F.min("key").alias("cls"), F.count("*").alias("n")))
        self.sizes = classes.select("cls", "n")
        self.total = self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        copied = classes.where("n > 1")
        self.copies = cut(attach(rows.select("key", "print"), copied, ["print"], "n", self.total).where("key <> cls").select("key", "cls"))
        self.firsts = rows.select(F.col("key").alias("cls"), "spans").join(self.copies.select(F.col("key").alias("cls")), "cls", "left_anti")
        self.prints = self.firsts.select("cls", F.explode("spans").alias("span"))

    @property
    def members(self) -> DataFrame:
        return self.firsts.select(F.col("cls").alias("key"), "cls").unionByName(self.copies)

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """The columns of ``classes`` (unique cls) with the class's text."""
        said = self.docs.select(F.col("key").alias("cls"), "text")
        return said.join(classes, "cls")

    def spans_by_class(self, spans: DataFrame) -> DataFrame:
        """cls, spans: those of ``spans`` (span, n) that each class has."""
        held = attach(self.prints, spans.select("span", "n"), ["span"], "n", self.total)
        return held.groupBy("cls").agg(F.collect_set("span").alias("spans"))

    def windows(self, spans: DataFrame, with_start: bool) -> DataFrame:
        """cls, win (and start): the windows of all classes that hold an anchor of ``spans`` (span, n)."""
        length = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cls, text, held in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    starts, found = _windows_at(text, held, length)
                    if not with_start:
                        found = np.unique(found)
                    columns = [pa.array([cls.as_py()] * len(found), cls.type), pa.array(found), *([pa.array(starts.astype(np.int32))] if with_start else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=["cls", "win", "start"][: len(columns)])

        kind = self.docs.schema["key"].dataType.simpleString()
        rows = self.texts_of(self.spans_by_class(spans)).select("cls", "text", "spans")
        return rows.mapInArrow(run, f"cls {kind}, win bigint" + (", start int" if with_start else ""))


def _hot_pairs(corpus: _Corpus, hot: DataFrame) -> DataFrame:
    """Pairs of texts under hot anchors: those that share a whole window of ``min_chars``."""
    wins = cut(corpus.windows(hot, False))
    # successive windows of one stretch pair the same texts: one window stands for each set of texts, known by
    # its size, its ends and 128 bits of two sums over its members
    marks = [F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark"), F.bit_xor(F.xxhash64(F.lit("x"), "cls")).alias("mask")]
    groups = wins.groupBy("win").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), *marks).where("n > 1")
    kept = cut(groups.groupBy("n", "lo", "hi", "mark", "mask").agg(F.min("win").alias("win")).select("win", "n"))
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = cut(attach(wins, kept, ["win"], "n", total))
    return spread(shared.select("win", F.col("cls").alias("a")), shared.select("win", F.col("cls").alias("b")), ["win"], kept, total).where("a < b").select("a", "b")


def class_pairs(corpus: _Corpus) -> DataFrame:
    """a, b (cls, a < b) of all pairs of different texts that share a stretch."""
    prints, min_chars = corpus.prints, corpus.min_chars
    stats = prints.groupBy("span").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("n > 1")
    stats = stored(stats)
    two = stats.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    some = prints.join(stats.where(F.col("n").between(3, PAIR_LIMIT)).select("span"), "span")
    several = some.alias("x").join(some.alias("y"), "span").where("x.cls < y.cls").select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    found = two.unionByName(several)
    hot = stats.where(F.col("n") > PAIR_LIMIT).select("span", "n")
    if not hot.isEmpty():
        found = found.unionByName(_hot_pairs(corpus, hot))
    pairs = stored(found.distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = cut(corpus.texts_of(involved))
    # texts are long: they are shuffled, not collected for a broadcast
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [bool(common_ranges(s, t, min_chars)[0]) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(same, pa.bool_())) for i in range(2)], names=["a", "b"])

    kind = corpus.docs.schema["key"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, f"a {kind}, b {kind}")


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 200) -> DataFrame:
    """doc_a < doc_b for all rows whose texts have an identical run of ``min_chars`` code points or more."""
    corpus = _Corpus(docs, key, text, min_chars)
    classes, members, total = class_pairs(corpus), corpus.members, corpus.total
    counts = lambda name: corpus.sizes.select(F.col("cls").alias(name), "n")
    with_a = spread(members.select(F.col("cls").alias("a"), F.col("key").alias("ka")), classes, ["a"], counts("a"), total)
    across = spread(members.select(F.col("cls").alias("b"), F.col("key").alias("kb")), with_a, ["b"], counts("b"), total).select("ka", "kb")
    copied = members.join(corpus.copies.select("cls").distinct(), "cls", "left_semi")
    within = spread(copied.select("cls", F.col("key").alias("ka")), copied.select("cls", F.col("key").alias("kb")), ["cls"], corpus.sizes, total).where("ka < kb").select("ka", "kb")
    return across.unionByName(within).select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b"))


def shared_extent(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 200) -> DataFrame:
    """For every row: doc_id, n_chars, shared_chars (how many of them stand in a shared stretch), copies (rows with the same text).

    No pairs are made: the windows around anchors that several texts have are counted, and those of more than one
    text cover their place. Rows with null or short texts share nothing. A text that occurs in several rows
    is shared as a whole.
    """
    corpus = _Corpus(docs, key, text, min_chars)
    shared = cut(corpus.prints.groupBy("span").agg(F.count("*").alias("n")).where("n > 1"))
    wins = cut(corpus.windows(shared, True))
    held = wins.groupBy("win").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("win", "n")
    hits = attach(wins, cut(held), ["win"], "n", wins.count()).select("cls", "start")
    after = F.lead("start").over(Window.partitionBy("cls").orderBy("start"))
    covered = hits.select("cls", F.least(F.coalesce(after - F.col("start"), F.lit(min_chars)), F.lit(min_chars)).alias("gain")).groupBy("cls").agg(F.sum("gain").alias("covered"))
    by_class = cut(corpus.sizes.join(covered, "cls", "left").where("n > 1 OR covered IS NOT NULL"))
    named = by_class.select("cls", "covered", F.col("n").alias("copies"), "n")
    per_row = attach(corpus.members, named, ["cls"], "n", corpus.total).select("key", "covered", "copies")
    out = corpus.docs.select("key", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(per_row, "key", "left")
    return out.select(
        F.col("key").alias("doc_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
    )


def drop_repeated_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_text: sentences in a run of ``run`` consecutive sentences that
    stands earlier (in a row with a smaller key, or further up) are removed; the first place stays.

    Texts of fewer than ``run`` sentences and null texts lose nothing (a null text stays null).
    """
    pieces = F.split("text", r"(?<=[.!?])(?=\s)|(?<=\n)(?=\S)", -1)
    # the sentences are computed once: inside a lambda they would be computed for every run
    rows = once(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "s", pieces)
    bare = F.transform("s", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    hashed = let(bare, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - run + 1), lambda i: F.xxhash64(F.concat_ws("\u0001", F.slice(b, i, run)))))
    spans = cut(rows.where(F.size("s") >= run).select("key", F.posexplode(hashed).alias("pos", "span")))
    first = spans.groupBy("span").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first)
    total = spans.count()
    later = attach(spans, first, ["span"], "n", total).where(F.struct("key", "pos") != F.col("first"))
    gone = later.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + run - 1)))).alias("gone"))
    out = rows.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    keep = F.filter("s", lambda x, i: ~F.array_contains("gone", i))
    return out.select(F.col("key").alias("doc_id"), F.coalesce(F.size("s"), F.lit(0)).alias("n_sentences"), F.size("gone").alias("n_removed"), F.array_join(keep, "").alias("kept_text"))
