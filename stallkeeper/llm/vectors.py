"""What the two embedding operators share: which vectors take part, and one node per distinct vector."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(v: Column) -> Column:
    """True for a vector without null or non-finite components that is not zero. Values are doubles."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(1.7976931348623157e308)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v) of all rows; v is null where the vector takes no part."""
    v = F.col(vector_column).cast("array<double>")
    return df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.when(usable(v), v).alias("v"))


def matrix(column) -> np.ndarray:
    """A pyarrow list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest part so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
