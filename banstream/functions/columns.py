"""Using a column's value more than once without computing it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often conditions and projections after use them.

    Spark puts expressions in place of their names in what follows, but not across a generator.
    """
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
