"""Records that differ only in formatting: dictionary-encoded columns, grouped as integer tuples.

1. The chosen columns are dictionary-encoded batch by batch, and each distinct value of a batch is
   canonicalised once: lower case, letters and digits only; a point or comma between two digits belongs to
   the number and stays.
2. Each canonical form has an integer identifier: its 128-bit fingerprint, so that every task gives a form
   the same integer and neither the dictionary nor the records have to be shuffled to meet.
3. A record becomes the tuple of its identifiers, sorted, so that the column order is of no account.
4. The compact tuples (16 bytes for each column) are grouped.

Only a key and one tuple per record are shuffled. A third of all rows may be one record: the rows of a group
meet the group's first key through ``attach``, which broadcasts only the groups that hold over 1/2000 of all
rows and so number under 2000.

Edge cases: a record with a value that is null or has no letter or digit is no case and forms no group;
exact copies and repeated rows count as copies; the smallest key stands for its group (a repeated smallest key
stands once); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import attach
from quillstone.session import cut

COLUMNS = ("chemical", "event_type", "description")

_PLAIN = re.compile(r"[^\W_]+")
_INNER = re.compile(r"(?<=\d)[.,](?=\d)|[^\W_]+")


def canonical(value: str) -> str:
    """Lower case, letters and digits; points and commas stay between two digits."""
    low = value.lower()
    return "".join((_INNER if "." in low or "," in low else _PLAIN).findall(low))


def identifiers(values: list[str | None]) -> list[bytes | None]:
    """The integer of each value's canonical form, as 16 bytes; none for null and for forms without letter or digit."""
    return [xxhash.xxh3_128_digest(form) if value is not None and (form := canonical(value)) else None for value in values]


def encode(records: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, codes: the sorted identifiers of each record all of whose values have one; one pass, no shuffle."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for i in range(1, len(columns) + 1):
                coded = batch.column(i).dictionary_encode()
                known = identifiers(coded.dictionary.to_pylist())
                cells.append([None if j is None else known[j] for j in coded.indices.to_pylist()])
            tuples = [None if None in x else b"".join(sorted(x)) for x in zip(*cells)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tuples, pa.binary())], names=["key", "codes"])

    return records.select(F.col(key).alias("key"), *columns).mapInArrow(run, f"key {kind}, codes binary").where("codes IS NOT NULL")


def grouped(records: DataFrame, key: str = "event_key", columns: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(key, codes) of the records, and per group codes, kept_key, n."""
    rows = cut(encode(records, key, columns))
    return rows, cut(rows.groupBy("codes").agg(F.min("key").alias("kept_key"), F.count("*").alias("n")))


def collapsed(records: DataFrame, key: str = "event_key", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """kept_key, n_copies and the columns of the kept record: one row for each distinct record."""
    _, groups = grouped(records, key, columns)
    kept = records.select(F.col(key).alias("kept_key"), *columns)
    return groups.select("kept_key", F.col("n").alias("n_copies")).join(kept, "kept_key")


def copies(records: DataFrame, key: str = "event_key", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """kept_key, copy_key: one row for each record that is not the first of its group."""
    rows, groups = grouped(records, key, columns)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return attach(rows, groups.where("n > 1"), ["codes"], "n", total).where("key <> kept_key").select("kept_key", F.col("key").alias("copy_key"))
