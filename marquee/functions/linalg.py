"""Distributed linear algebra on long / factor tables.

A sparse matrix is a table ``(row, col, value)``; a dense factor is a table
``(key, vec array<double>)``. Products are joins + keyed aggregates (one sum
per factor component, partial aggregation map-side). Small Gram matrices are
summed from per-partition numpy partials, and only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEC = "vec"


def rademacher(key: Column, j: int, seed: int) -> Column:
    """Deterministic +-1 test-matrix entry for (key, j): stable under any
    partitioning and recomputation."""
    h = F.xxhash64(key, F.lit(j), F.lit(seed))
    return F.when(F.pmod(h, F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def random_block(keys: DataFrame, key: str, width: int, seed: int) -> DataFrame:
    return keys.select(F.col(key).alias("key"),
                       F.array(*[rademacher(F.col(key), j, seed) for j in range(width)]).alias(VEC))


def multiply(entries: DataFrame, factor: DataFrame, row: str, col: str, width: int) -> DataFrame:
    """``A @ M``: ``entries`` (row, col, value) times ``factor`` (key=col, vec)."""
    j = entries.join(factor.withColumnRenamed("key", col), col)
    aggs = [F.sum(F.col("value") * F.col(VEC)[i]).alias(f"_m{i}") for i in range(width)]
    return j.groupBy(row).agg(*aggs).select(
        F.col(row).alias("key"), F.array(*[F.col(f"_m{i}") for i in range(width)]).alias(VEC))


def cross_gram(rows: DataFrame, left: str, right: str, shape: tuple[int, int]) -> np.ndarray:
    """``L^T R`` of two vector columns: numpy partials per partition, summed by entry."""
    schema = T.StructType([T.StructField("ij", T.IntegerType()), T.StructField("g", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                acc += np.stack(pdf.iloc[:, 0].to_numpy()).T @ np.stack(pdf.iloc[:, 1].to_numpy())
        yield pd.DataFrame({"ij": np.arange(acc.size, dtype=np.int32), "g": acc.ravel()})

    found = (rows.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(partial, schema)
             .groupBy("ij").agg(F.sum("g").alias("g")).collect())
    g = np.zeros(shape[0] * shape[1])
    for r in found:
        g[r["ij"]] = r["g"]
    return g.reshape(shape)


def gram(factor: DataFrame, width: int) -> np.ndarray:
    return cross_gram(factor, VEC, VEC, (width, width))


def combine(columns: list[Column], matrices: list[np.ndarray]) -> Column:
    """``sum of column @ matrix`` row by row (an Arrow-batched numpy product)."""
    mats = [np.asarray(m, dtype=np.float64) for m in matrices]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(*vs: pd.Series) -> pd.Series:
        if len(vs[0]) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(sum(np.stack(v.to_numpy()) @ m for v, m in zip(vs, mats))))

    return apply(*columns)


def transform(factor: DataFrame, mat: np.ndarray) -> DataFrame:
    """``M @ mat`` row by row."""
    return factor.select("key", combine([F.col(VEC)], [mat]).alias(VEC))
