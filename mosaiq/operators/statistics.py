"""Aggregates over blocks, views and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sse(a: Column, b: Column) -> Column:
    d = a.cast("long") - b.cast("long")
    return F.sum(d * d)


def sad(a: Column, b: Column) -> Column:
    return F.sum(F.abs(a.cast("long") - b.cast("long")))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    return 10 * F.log10(F.lit(peak * peak) / mse)


def bits_per_pixel(compressed_bytes: Column, pixels: Column) -> Column:
    return 8.0 * compressed_bytes / pixels


def diagonal_counts(df: DataFrame, keys: list[str], diag: str = "diag", value: str = "v") -> DataFrame:
    """Per diagonal: whether it holds something, and zeros less others."""
    full = F.count_if(F.col(value) != 0)
    return df.groupBy(*keys, diag).agg((full > 0).alias("occupied"), (F.count("*") - 2 * full).alias("balance"))


def last_diagonal(df: DataFrame, keys: list[str], diag: str = "diag", value: str = "v") -> DataFrame:
    """The last diagonal that holds something (null: none) and how many do."""
    held = F.when(F.col(value) != 0, F.col(diag))
    return df.groupBy(*keys).agg(F.max(held).alias("last_diag"), F.count_distinct(held).alias("n_diags"))


def significant_neighbours(df: DataFrame, keys: list[str], names: list[str], value: str = "v") -> DataFrame:
    """How many of the next cells along each dimension are not 0."""
    parts = []
    for name in names:
        line = Window.partitionBy(*keys, *(n for n in names if n != name)).orderBy(name)
        parts.append((F.lead(value, 1, 0).over(line) != 0).cast("int"))
    return df.withColumn("significant", sum(parts[1:], parts[0]))


def uniform(df: DataFrame, *columns: str) -> DataFrame:
    """Whether all rows agree in the columns."""
    return df.agg((F.count_distinct(F.struct(*columns)) <= 1).alias("uniform"))


def symbol_weights(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*keys, symbol).agg(F.count("*").alias("weight"))


def bucket_bounds(weights: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Start and end of each symbol's bucket in the sorted sequence."""
    before = Window.partitionBy(*keys).orderBy(symbol)
    tail = F.sum("weight").over(before)
    return weights.withColumn("head", tail - F.col("weight")).withColumn("tail", tail)


def table_diagonal_average(df: DataFrame, keys: list[str], diag: Column, value: str) -> DataFrame:
    return df.withColumn("average", F.avg(value).over(Window.partitionBy(*keys, diag)))
