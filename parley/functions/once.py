"""Values that are computed once a row, however often later expressions look at them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with ``cols`` added by a generator of one row.

    Catalyst moves filters and later expressions into the projections below them, which computes an
    array anew for every element that a lambda looks at. It does not move them past a generator.
    """
    kept = [c for c in df.columns if c not in cols]
    made = df.select(*kept, F.explode(F.array(F.struct(*(c.alias(name) for name, c in cols.items())))).alias("_once"))
    return made.select(*kept, "_once.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value bound to a lambda's variable, so that inner lambdas don't compute it anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
