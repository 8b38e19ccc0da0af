"""Equi-joins whose large side may hold a third of its rows under one key.

``attach`` adds the columns of a table with one row per key to a large table. Keys that hold more than
``1 / HOT_SHARE`` of the large side's rows can number at most ``HOT_SHARE``: that bound, not a guess,
lets them be broadcast. All other keys go through an ordinary shuffled join, where none is hot. ``small``
should be a checkpointed or written table, as it is read once more to see whether there are hot keys.
``spread`` joins with any number of rows per key: the large side's rows under a hot key are salted over
``SALTS`` tasks and the other side's rows of that key are repeated for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HOT_SHARE of all rows.
HOT_SHARE = 2000
#: Keys with fewer rows than this are never hot.
LEAST_HOT = 1000
#: The rows of a hot key are spread over so many tasks.
SALTS = 64


def attach(big: DataFrame, small: DataFrame, keys: list[str], count_col: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (unique on ``keys``; ``count_col``: rows of ``big`` under the key).

    Rows of ``big`` with a null key match nothing (they are kept by ``how="left"``). An empty side gives
    an empty (or null-filled) result. ``count_col`` is dropped from the result.
    """
    least = max(int(total) // HOT_SHARE, LEAST_HOT)
    if small.where(F.col(count_col) > F.lit(least)).isEmpty():
        extra = [c for c in small.columns if c not in keys and c != count_col]
        return big.join(small.drop(count_col), keys, how).select(*big.columns, *extra)
    hot = small.where(F.col(count_col) > F.lit(least)).drop(count_col)
    cold = small.where(F.col(count_col) <= F.lit(least)).drop(count_col)
    mark = hot.select(*keys).withColumn("__hot", F.lit(True))
    marked = big.join(F.broadcast(mark), keys, "left")
    extra = [c for c in small.columns if c not in keys and c != count_col]
    order = [*big.columns, *extra]
    hot_rows = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, "inner").select(order)
    cold_rows = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys, how).select(order)
    return cold_rows.unionByName(hot_rows)


def spread(big: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """``big`` inner-joined with ``other`` on ``keys``; ``counts`` (keys, n) holds the rows of ``big`` under each
    key (keys left out count as never hot) and should be a checkpointed or written table.

    Rows with a null key match nothing; an empty side gives an empty result; the columns of ``big`` come first.
    """
    order = [*big.columns, *[c for c in other.columns if c not in keys]]
    hot = counts.where(F.col("n") > F.lit(max(int(total) // HOT_SHARE, LEAST_HOT))).select(*keys)
    if hot.isEmpty():
        return big.join(other, keys).select(order)
    mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salted = big.join(mark, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = other.join(mark, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return salted.join(repeated, [*keys, "__salt"]).select(order)
