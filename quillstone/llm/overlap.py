"""Same or near-same passages across splits, by minwise hashing with banded buckets.

The passage of a record is what follows the last line ``Text:`` of its user message, or the whole user
message. Its features are all runs of three consecutive lower-case words (runs of letters and digits),
hashed to 64 bits. One pass over the records gives each the 128-bit fingerprint of its run set and ``BANDS``
bucket keys of ``ROWS`` minwise hashes each; passages and runs themselves are never shuffled here.
Passages with the same set of runs are one class, named by its smallest record. The buckets of training classes are joined
with those of held-out classes, so buckets of one kind drop out and only cross-split pairs are made. The
run sets are then made again for the classes of candidate pairs alone, and the exact Jaccard similarity decides.
With 40 bands of 4 rows a pair at 0.6 is missed with probability 0.4 per cent, one at 0.7 with 2e-5, and one
at 0.1 becomes a candidate with probability 0.4 per cent.

A third of all records may be one class: its record rows meet the pairs of the class in salted tasks.

Edge cases: null or empty messages, records without a user message and passages under three words are no
cases; the last user message counts; repeated rows pair like others; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import attach, spread
from quillstone.session import cut

BANDS, ROWS = 40, 4
SHINGLE = 3
THRESHOLD = 0.5
#: Word hashes kept per worker before the store is emptied (memory bound, no effect on results).
KNOWN_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
HELD = ("validation", "test")


def user_passage(messages: Column) -> Column:
    """The passage in the last user message."""
    said = F.try_element_at(F.filter(messages, lambda m: (m["role"] == "user") & m["content"].isNotNull()), F.lit(-1))["content"]
    return F.regexp_replace(said, r"(?s)^(?:.*\n)?[ \t]*Text:[ \t]*(?:\r?\n|\r?$)", "")


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_sets(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of the runs of ``k`` words, text after text, and where each text's begin
    (and the last one's end); a text under ``k`` words has none."""
    words = [_WORD.findall(t.lower()) for t in texts]
    flat = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), dtype=np.int64, count=len(texts)))
    n = max(len(flat) - k + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = _mixed(h * _MIX + flat[j : j + n])
    inside = owner[:n] == owner[len(owner) - n :]  # a run over the seam of two texts is none
    h, owner = h[inside], owner[:n][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.searchsorted(owner[first], np.arange(len(texts) + 1))


def _fingerprints(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data = values.tobytes()
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = BANDS * ROWS
    return rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def band_keys(values: np.ndarray, offsets: np.ndarray, seed: int = 7) -> np.ndarray:
    """Bucket keys (sets x BANDS) of the hash sets values[offsets[i]:offsets[i + 1]] (none empty).

    A key has its band in the upper bits and 42 bits of hash: different values in one bucket only make candidates.
    """
    factors, adds = _constants(seed)
    out = np.zeros((len(offsets) - 1, BANDS), dtype=np.uint64)
    # the values are hashes already: 32 of their bits suffice to draw the smallest under each linear map
    x = (values.view(np.uint64) >> np.uint64(16)).astype(np.uint32)
    h = np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, factors[i], out=h)
        h += adds[i]
        low = np.minimum.reduceat(h, offsets[:-1])
        band = i // ROWS
        out[:, band] = _mixed((out[:, band] ^ low) * _MIX)
    return ((out >> np.uint64(22)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(42))).view(np.int64)


def _signed(records: DataFrame) -> DataFrame:
    """record_id, split, source, print (128-bit fingerprint of the run set), keys; records with too few words are left out."""
    said = records.where(F.col("split").isin("train", *HELD)).select("record_id", "split", "source", user_passage(F.col("messages")).alias("passage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                values, offsets = run_sets([t or "" for t in batch.column(3).to_pylist()])
                kept = np.flatnonzero(np.diff(offsets))
                if not len(kept):
                    continue
                offsets = np.append(offsets[kept], len(values))
                keys = band_keys(values, offsets)
                prints = pa.array(_fingerprints(values, offsets), pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in range(3)), prints, lists], names=["record_id", "split", "source", "print", "keys"])

    return said.mapInArrow(run, "record_id bigint, split string, source string, print binary, keys array<bigint>")


def _prepared(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Members (record_id, split, source, cls); classes (cls, print, keys, in_train, in_held); sizes of the classes
    of several records (cls, n); the number of members. A class is named by its smallest record_id."""
    rows = cut(_signed(records))
    is_train = F.col("split") == "train"
    grouped = rows.groupBy("print").agg(F.min("record_id").alias("cls"), F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_held"), F.count("*").alias("n"))
    several = cut(grouped.where("n > 1"))
    total = rows.count()
    copies = cut(attach(rows.select("record_id", "print"), several, ["print"], "n", total).where("record_id <> cls").select("record_id", "cls"))
    # one row of each class: copies drop out, and the first record of several gets the flags of all
    marks = copies.select("record_id", F.lit(True).alias("copy"), F.lit(None).cast("boolean").alias("t"), F.lit(None).cast("boolean").alias("h"))
    marks = marks.unionByName(several.select(F.col("cls").alias("record_id"), F.lit(False).alias("copy"), F.col("in_train").alias("t"), F.col("in_held").alias("h")))
    marked = rows.join(marks, "record_id", "left")
    members = marked.join(copies, "record_id", "left").select("record_id", "split", "source", F.coalesce("cls", "record_id").alias("cls"))
    classes = marked.where(~F.coalesce("copy", F.lit(False))).select(F.col("record_id").alias("cls"), "print", "keys", F.coalesce("t", is_train).alias("in_train"), F.coalesce("h", ~is_train).alias("in_held"))
    return members, classes, several.select("cls", "n"), total


def _sets_of(records: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, runs of the classes (cls, print), from the record that stands for each."""
    said = records.select(F.col("record_id").alias("cls"), user_passage(F.col("messages")).alias("passage"))
    wanted = said.join(classes, "cls").select("cls", "print", "passage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = run_sets([t or "" for t in batch.column(2).to_pylist()])
            # the fingerprint tells the record from another of the same id
            right = [i for i, (x, p) in enumerate(zip(_fingerprints(values, offsets), batch.column(1).to_pylist())) if x == p]
            runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))).take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), runs], names=["cls", "runs"])

    return wanted.mapInArrow(run, "cls bigint, runs array<bigint>")


def class_pairs(records: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """t, h: classes with a training and with a held-out record whose run sets are alike by ``threshold`` or more.

    A class that has both kinds of records pairs with itself.
    """
    # a bucket without a training or without a held-out class finds no partner in this join
    train = classes.where("in_train").select(F.col("cls").alias("t"), F.explode("keys").alias("bucket"))
    held = classes.where("in_held").select(F.col("cls").alias("h"), F.explode("keys").alias("bucket"))
    candidates = cut(train.join(held, "bucket").where("t <> h").select("t", "h").distinct())
    involved = candidates.select(F.explode(F.array("t", "h")).alias("cls")).distinct()
    sets = cut(_sets_of(records, classes.select("cls", "print").join(involved, "cls", "left_semi")))
    # run sets are long: they are shuffled, not collected for a broadcast
    both = candidates.join(sets.select(F.col("cls").alias("t"), F.col("runs").alias("runs_t")).hint("merge"), "t").join(sets.select(F.col("cls").alias("h"), F.col("runs").alias("runs_h")).hint("merge"), "h")
    common = F.size(F.array_intersect("runs_t", "runs_h"))
    alike = both.where(common / (F.size("runs_t") + F.size("runs_h") - common) >= threshold).select("t", "h")
    return alike.unionByName(classes.where("in_train AND in_held").select(F.col("cls").alias("t"), F.col("cls").alias("h")))


def overlapping_records(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """record_a < record_b: one in train, the other in validation or test, their passages alike."""
    members, classes, sizes, total = _prepared(records)
    pairs = cut(class_pairs(records, classes, threshold))
    train = members.where("split = 'train'").select(F.col("cls").alias("t"), F.col("record_id").alias("rt"))
    held = members.where("split <> 'train'").select(F.col("cls").alias("h"), F.col("record_id").alias("rh"))
    with_held = spread(held, pairs, ["h"], sizes.withColumnRenamed("cls", "h"), total)
    found = spread(train, with_held, ["t"], sizes.withColumnRenamed("cls", "t"), total)
    return found.select(F.least("rt", "rh").alias("record_a"), F.greatest("rt", "rh").alias("record_b"))


def overlap_report(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """held_split, held_source, train_source, n_pairs; and n_records, the held-out records of the row's kind
    with at least one such pair. Counted from class sizes, without listing the pairs."""
    members, classes, _, _ = _prepared(records)
    pairs = cut(class_pairs(records, classes, threshold))
    src = F.coalesce("source", F.lit("(none)"))
    train = members.where("split = 'train'").groupBy(F.col("cls").alias("t"), src.alias("train_source")).agg(F.count("*").alias("nt"))
    held = members.where("split <> 'train'").groupBy(F.col("cls").alias("h"), F.col("split").alias("held_split"), src.alias("held_source")).agg(F.count("*").alias("nh"))
    by_class = pairs.join(train, "t").groupBy("h", "train_source").agg(F.sum("nt").alias("nt"))
    joined = by_class.join(held, "h")
    return joined.groupBy("held_split", "held_source", "train_source").agg(F.sum(F.col("nt") * F.col("nh")).alias("n_pairs"), F.sum("nh").alias("n_records"))
