"""Vectors with integer components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest integer component: squares of differences, and their sums over 64 components, stay exact in 63 bits.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """``columns`` and ``x``, the components as floor(scale * component), of the rows whose vector holds finite numbers only.

    Null vectors and vectors with null or non-finite components are left out.  A component beyond ``LIMIT`` is an error.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    far = F.exists(x, lambda v: F.abs(v * scale) >= LIMIT)
    whole = F.transform(x, lambda v: F.floor(v * scale))
    checked = F.when(far, F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more"))).otherwise(whole)
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select(*columns, checked.cast("array<bigint>").alias("x"))
