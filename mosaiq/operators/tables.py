"""Quantiser tables: base tables, their scaling and their bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, transforms

# The base tables of the JPEG standard (quality 50), row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]


def base_tables(spark: SparkSession) -> DataFrame:
    """(name, x, y, q): 64 rows for each base table."""
    named = F.explode(F.create_map(F.lit("luma"), F.lit(LUMA), F.lit("chroma"), F.lit(CHROMA))).alias("name", "qs")
    rows = spark.range(1).select(named).select("name", F.posexplode("qs").alias("i", "q"))
    return blocks.shaped(rows, {"x": 8, "y": 8}).select("name", "x", "y", "q")


def uniform_table(spark: SparkSession, sizes: dict[str, int], q: int) -> DataFrame:
    cells = spark.range(math.prod(sizes.values())).select(F.col("id").cast("int").alias("i"), F.lit(q).alias("q"))
    return blocks.shaped(cells, sizes)


def scaled_nearest(df: DataFrame, sizes: dict[str, tuple[int, int]], value: str = "v") -> DataFrame:
    """Each dimension from its first size to its second: cut, or filled by the last entry.
    The last entry stands for several positions, so no join is needed."""
    out = df
    for name, (have, want) in sizes.items():
        places = F.when(F.col(name) == have - 1, F.sequence(F.lit(have - 1), F.lit(max(have, want) - 1))).otherwise(F.array(F.col(name)))
        out = out.withColumn(name, F.explode(places)).where(F.col(name) < want)
    return out


def scaled_by_dct(df: DataFrame, keys: list[str], sizes: dict[str, tuple[int, int]], value: str = "v") -> DataFrame:
    """Transform, drop the coefficients beyond the new size (those that lack are 0), transform back, round."""
    there = transforms.dct(df, keys, {n: have for n, (have, _) in sizes.items()}, value)
    for name, (_, want) in sizes.items():
        there = there.where(F.col(name) < want)
    back = transforms.dct(there, keys, {n: want for n, (_, want) in sizes.items()}, value, inverse=True)
    return back.withColumn(value, F.round(value).cast("int"))


def entry_bytes(entries: int) -> int:
    """Bytes of an index into ``entries`` places: 1, 2, 4 or 8."""
    bits = max(1, math.ceil(math.log2(entries)))
    return next(n for n in (1, 2, 4, 8) if bits <= 8 * n)


def packed(values: Column, width: int = 1) -> Column:
    """An array of integers as big-endian bytes of ``width`` each."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2 * width, "0")), ""))


def unpacked(data: Column, width: int = 1) -> Column:
    n = F.octet_length(data) / width
    piece = lambda i: F.conv(F.substring(F.hex(data), (i * 2 * width + 1).cast("int"), F.lit(2 * width)), 16, 10).cast("long")
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), piece))
