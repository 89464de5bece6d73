"""Fixtures and index space: positions, tiles, padding, cropping and view addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idiv(a, b) -> Column:
    """Floor division of integers."""
    return F.floor(F.col(a) / F.lit(b) if isinstance(a, str) else a / F.lit(b)).cast("int")


def signal(embeddings: DataFrame) -> DataFrame:
    """(vec_id, i, v): embeddings as integer signals, v = round(256 e)."""
    rows = embeddings.select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.select("vec_id", "i", F.round(F.col("e").cast("double") * 256).cast("int").alias("v"))


def shaped(df: DataFrame, sizes: dict[str, int], index: str = "i") -> DataFrame:
    """Replace a linear index by coordinates, the first name fastest."""
    step, out = 1, df
    for name, size in sizes.items():
        out = out.withColumn(name, (idiv(index, step) % size).cast("int"))
        step *= size
    return out.drop(index)


def linear_index(coordinates: list[str], sizes: list[int]) -> Column:
    """x0 + s0 * (x1 + s1 * (...))."""
    out = F.col(coordinates[-1])
    for name, size in zip(reversed(coordinates[:-1]), reversed(sizes[:-1]), strict=True):
        out = F.col(name) + size * out
    return out


def num_diagonals(sizes: list[int]) -> int:
    return sum(s - 1 for s in sizes) + 1


def aligned(n: Column, block: int) -> Column:
    """The next multiple of the block size."""
    return (F.floor((n + (block - 1)) / block) * block).cast("int")


def block_grid(spark, sizes: dict[str, int], step: dict[str, int]) -> DataFrame:
    """Offsets of all blocks with their number ``block``; the last dimension is outermost."""
    from pyspark.sql import Window

    grid = spark.range(1).select()
    for name, size in sizes.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1), F.lit(step[name]))))
    order = Window.orderBy(*reversed(list(sizes)))
    return grid.withColumn("block", F.row_number().over(order) - 1)


def padded_tiles(df: DataFrame, keys: list[str], size: int, block: int, x: str = "i", v: str = "v") -> DataFrame:
    """Cut lines of ``size`` samples into blocks, the last one filled by its last sample: (keys,
    tile, x, v). The last sample stands for several positions, so no join is needed."""
    top = -(-size // block) * block
    last = F.col(x) == size - 1
    places = F.when(last, F.sequence(F.col(x), F.lit(top - 1))).otherwise(F.array(F.col(x)))
    rows = df.select(*keys, F.explode(places).alias("p"), v)
    return rows.select(*keys, idiv("p", block).alias("tile"), (F.col("p") % block).alias(x), v)


def cropped(tiles: DataFrame, size: int, block: int, x: str = "i") -> DataFrame:
    """Put tiles together again; what lies beyond ``size`` is dropped."""
    return tiles.withColumn(x, F.col("tile") * block + F.col(x)).where(F.col(x) < size).drop("tile")


def tiles(df: DataFrame, sizes: dict[str, int], step: dict[str, int]) -> DataFrame:
    """Cut a signal of any number of dimensions into blocks of ``step``: adds ``tile_`` and the name of
    each dimension. Blocks at the end are filled by the last sample along each dimension."""
    out = df
    for name, size in sizes.items():
        top = -(-size // step[name]) * step[name]
        last = F.sequence(F.lit(size - 1), F.lit(top - 1))
        out = out.withColumn(name, F.explode(F.when(F.col(name) == size - 1, last).otherwise(F.array(F.col(name)))))
    for name in sizes:
        out = out.withColumn(f"tile_{name}", idiv(name, step[name])).withColumn(name, (F.col(name) % step[name]).cast("int"))
    return out


def joined_tiles(df: DataFrame, sizes: dict[str, int], step: dict[str, int]) -> DataFrame:
    """The inverse of ``tiles``: what lies beyond ``sizes`` is dropped."""
    out = df
    for name, size in sizes.items():
        out = out.withColumn(name, F.col(f"tile_{name}") * step[name] + F.col(name)).where(F.col(name) < size).drop(f"tile_{name}")
    return out


def view_address(image: str, side: int) -> list[Column]:
    """u and v of an image number in a square of views."""
    return [(F.col(image) % side).cast("int").alias("u"), idiv(image, side).alias("v")]


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
