"""Separable transforms: cosine by a broadcast basis and a sum, 5/3 wavelet by neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dct_basis(spark: SparkSession, n: int) -> DataFrame:
    """(u, x, c): the orthonormal DCT-II of ``n`` samples; n * n rows."""
    rows = [
        (u, x, math.cos((2 * x + 1) * u * math.pi / (2 * n)) * math.sqrt(2 / n) * (math.sqrt(0.5) if u == 0 else 1.0))
        for u in range(n)
        for x in range(n)
    ]
    return spark.createDataFrame(rows, "u int, x int, c double")


def dct(df: DataFrame, keys: list[str], sizes: dict[str, int], value: str = "v", inverse: bool = False) -> DataFrame:
    """The D-dimensional transform, one dimension after another. The basis of a dimension has
    size * size rows whatever the data, so it is broadcast. Blocks are dealt by ``keys`` once; all
    sums find their rows in one task, so there is no other shuffle."""
    names, out = list(sizes), df.repartition(*keys).withColumn(value, F.col(value).cast("double"))
    for name in names:
        basis = dct_basis(df.sparkSession, sizes[name])
        have, want = ("u", "x") if inverse else ("x", "u")
        basis = basis.select(F.col(have).alias(name), F.col(want).alias("__to"), "c")
        others = [n for n in names if n != name]
        joined = out.join(F.broadcast(basis), name)
        out = joined.groupBy(*keys, *others, F.col("__to").alias(name)).agg(F.sum(F.col(value) * F.col("c")).alias(value))
    return out.select(*keys, *names, value)


def _nearby(line: Window, value, edge):
    """Sum of both neighbours; beyond an end there is ``edge``."""
    return F.lag(value, 1, edge).over(line) + F.lead(value, 1, edge).over(line)


def dwt53(df: DataFrame, keys: list[str], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """One level of the 5/3 wavelet by lifting, dimension by dimension: odd samples lose the
    rounded mean of their neighbours, even ones gain a quarter of the new neighbours; then the
    even samples come first. Missing neighbours are 0. One shuffle, by ``keys``."""
    out = df.repartition(*keys)
    for name, n in sizes.items():
        line = Window.partitionBy(*keys, *(k for k in sizes if k != name)).orderBy(name)
        odd = F.col(name) % 2 == 1
        out = out.withColumn("__d", F.when(odd, F.col(value) - F.shiftright(_nearby(line, value, 0) + 1, 1)).otherwise(F.col(value)))
        out = out.withColumn(value, F.when(odd, F.col("__d")).otherwise(F.col("__d") + F.shiftright(_nearby(line, "__d", 0) + 2, 2)))
        half = F.floor(F.col(name) / 2).cast("int")
        out = out.withColumn(name, F.when(odd, half + (n + 1) // 2).otherwise(half)).drop("__d")
    return out


def idwt53(df: DataFrame, keys: list[str], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """The inverse: dimensions in reverse order, since the rounding of each depends on it."""
    out = df.repartition(*keys)
    for name, n in reversed(sizes.items()):
        low = (n + 1) // 2
        out = out.withColumn(name, F.when(F.col(name) < low, 2 * F.col(name)).otherwise(2 * (F.col(name) - low) + 1))
        line = Window.partitionBy(*keys, *(k for k in sizes if k != name)).orderBy(name)
        odd = F.col(name) % 2 == 1
        out = out.withColumn("__s", F.when(odd, F.col(value)).otherwise(F.col(value) - F.shiftright(_nearby(line, value, 0) + 2, 2)))
        out = out.withColumn(value, F.when(odd, F.col("__s") + F.shiftright(_nearby(line, "__s", 0) + 1, 1)).otherwise(F.col("__s"))).drop("__s")
    return out
