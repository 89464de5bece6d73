"""Orders of the cells of a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diagonal(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(n) for n in names))


def ranked(df: DataFrame, keys: list[str], *order: Column | str, out: str = "rank") -> DataFrame:
    """The place of each cell in its block, from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def diagonal_scan(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Diagonal by diagonal; inside one, the last coordinate is the slowest."""
    return ranked(df.withColumn("diag", diagonal(names)), keys, "diag", *reversed(names))


def coding_order(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Diagonals from the highest, as coefficients are coded."""
    return ranked(df.withColumn("diag", diagonal(names)), keys, F.desc("diag"), *reversed(names))


def zigzag(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Odd diagonals with rising x, even ones with falling x."""
    d = F.col(x) + F.col(y)
    return ranked(df, keys, d, F.when(d % 2 == 1, F.col(x)).otherwise(-F.col(x)))


def traversal(df: DataFrame, keys: list[str], reference: Column, index: Column) -> DataFrame:
    """The first cell, then all others by falling reference; ties in the order of ``index``."""
    return ranked(df.withColumn("__i", index).withColumn("__r", reference), keys, F.col("__i") != 0, F.desc("__r"), "__i").drop("__i", "__r")


def radius(names: list[str]) -> Column:
    return -reduce(lambda a, b: a + b, (F.col(n) * F.col(n) for n in names))


def hyperboloid(names: list[str]) -> Column:
    return -reduce(lambda a, b: a * b, (F.col(n) + 1 for n in names))


def diagonal_flags(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, diag, coded, last) for the diagonals up to the last with a value that isn't 0."""
    some = df.groupBy(*keys, "diag").agg(F.max(F.col(value) != 0).alias("coded"))
    end = F.max(F.when(F.col("coded"), F.col("diag"))).over(Window.partitionBy(*keys))
    out = some.withColumn("__end", end).withColumn("last", F.coalesce(F.col("diag") == F.col("__end"), F.lit(False)))
    return out.where(F.col("__end").isNull() | (F.col("diag") <= F.col("__end"))).select(*keys, "diag", "coded", "last")
