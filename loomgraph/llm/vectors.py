"""Vectors as integers, for the operators over embeddings: exact sums and products, whatever the order of their terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers up to this are exact in a double; a long holds up to LONG.
EXACT, LONG = 1 << 53, (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there, and no component is infinite or not a number."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken, F.lit(False))


def numbered(df: DataFrame, id_col: str, vector_col: str, where: Column, *more: Column) -> DataFrame:
    """(row, vec_id, x, more): the rows of df with a finite vector that meet the condition, numbered, components as doubles."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    kept = df.where(finite(F.col(vector_col)) & where)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), *more)


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, still as doubles: their values are whole, so nothing is lost."""
    return np.floor(flat * float(scale))


def whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers of any length."""
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(v) for v in values.ravel().tolist()]
    return out


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max()) if values.size else 0.0


def as_longs(values: np.ndarray) -> np.ndarray:
    """Integers as longs; what a long can't hold takes its end."""
    if values.dtype == object:
        return np.array([max(-LONG - 1, min(LONG, int(v))) for v in values.ravel()], np.int64).reshape(values.shape)
    return values.astype(np.int64)
