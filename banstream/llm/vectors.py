"""What the operators on vectors have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond this would leave the integers in which sums of products are exact.
LARGEST = 1 << 22


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, by: int, kept: Column) -> Column:
    """floor(by * x) of every component as an integer; a component of a magnitude over LARGEST is an error.

    NULL where ``kept`` does not hold, whatever the vector is: Spark may try a column before the filter on its rows.
    """
    step = lambda x: F.floor(F.lit(float(by)) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(float(by)) * x.cast("double")) <= LARGEST
    every = F.transform(vector, lambda x: F.when(fits(x), step(x).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {by} is beyond {LARGEST}")).cast("int")))
    return F.when(kept, every)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` integers, as a matrix of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
