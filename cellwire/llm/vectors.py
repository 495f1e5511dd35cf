"""What the vector operators share: validity, and blocks of two sides that meet in tasks of bounded size."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most vectors of one side in one task.
BLOCK = 4096


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, dim, vec): vectors that are not null, not zero and hold only finite components."""
    v = F.col("vec")
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vec"))
        .where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
        .select("vec_id", F.size("vec").alias("dim"), "vec")
    )


def matrix(column: pd.Series) -> np.ndarray:
    """The vectors of a pandas column as rows, in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    return np.stack(column.to_numpy()).astype(np.float64)


def dealt(rows: DataFrame, parts: int, *columns: str) -> DataFrame:
    """Number of one of ``parts`` blocks, by hash, so a block's size is about rows / parts whatever the data."""
    return rows.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int"))


def sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last, so equal rows give equal sums."""
    return np.add.accumulate(a * b, axis=1)[:, -1]
