"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once, also where later filters refer to it.

    A plain column would be copied into every filter pushed below it; predicates are not pushed through
    a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` may use it many times or in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
