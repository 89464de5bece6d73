"""Neighbourhood filters and block prediction."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def low_pass(df: DataFrame, keys: list[str], names: list[str], value: str = "v") -> DataFrame:
    """[1 2 1] along each dimension, ends repeated, divided by 4 for each dimension at the end."""
    out = df.repartition(*keys).withColumn("__v", F.col(value).cast("long"))
    for name in names:
        line = Window.partitionBy(*keys, *(n for n in names if n != name)).orderBy(name)
        near = F.coalesce(F.lag("__v").over(line), "__v") + F.coalesce(F.lead("__v").over(line), "__v")
        out = out.withColumn("__v", near + 2 * F.col("__v"))
    return out.withColumn(value, F.col("__v") / float(4 ** len(names))).drop("__v")


def faces(blocks: DataFrame, key: str, across: int, size: int) -> DataFrame:
    """(key, left, top): the samples beside each block of an image, ``across`` blocks wide, whose blocks
    are numbered row by row by ``key`` and hold ``size`` by ``size`` samples in the array ``v``.

    ``left`` is the last column of the block before, ``top`` the last row of the one above. At the
    image's border a face that lies outside takes the nearest sample that comes before the
    block: the first of the other face. The first block sees zeros. Two joins on the key, no window."""
    edge = lambda f: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), f)
    column = edge(lambda y: F.element_at("v", y * size + size).cast("long"))
    row = edge(lambda x: F.element_at("v", x + (size - 1) * size + 1).cast("long"))
    k = F.col(key)
    left = blocks.select((k + 1).alias(key), column.alias("left"))
    top = blocks.select((k + across).alias(key), row.alias("top"))
    zero = F.array_repeat(F.lit(0).cast("long"), size)
    out = blocks.select(key).join(left, key, "left").join(top, key, "left")
    first, up = k % across == 0, k < across
    own_left, own_top = F.coalesce("left", zero), F.coalesce("top", zero)
    return out.select(
        key,
        F.when(first & up, zero).when(first, F.array_repeat(F.element_at(own_top, 1), size)).otherwise(own_left).alias("left"),
        F.when(first & up, zero).when(up, F.array_repeat(F.element_at(own_left, 1), size)).otherwise(own_top).alias("top"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def dc_prediction(beside: DataFrame, key: str, size: int) -> DataFrame:
    """Floor of the mean of the samples of all adjacent faces."""
    total = _total(F.col("left")) + _total(F.col("top"))
    return beside.select(key, F.floor(total / (2 * size)).cast("long").alias("dc"))


def smoothed(face: Column, size: int) -> Column:
    """[1 2 1] along a face with its ends repeated, divided by 4."""
    at = lambda i: F.element_at(face, F.least(F.greatest(i, F.lit(1)), F.lit(size)))
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (at(i - 1) + 2 * at(i) + at(i + 1)) / 4.0)


def predictions(beside: DataFrame, key: str, size: int) -> DataFrame:
    """(key, x, y, none, dc, planar, across, down): what each way predicts for each sample. Along an axis the
    smoothed face is carried through the block; planar is the mean of both."""
    every = dc_prediction(beside, key, size).join(beside, key)
    every = every.withColumn("l", smoothed(F.col("left"), size)).withColumn("t", smoothed(F.col("top"), size))
    cell = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i")
    x, y = F.col("i") % size, F.floor(F.col("i") / size).cast("int")
    across, down = F.element_at("l", y + 1), F.element_at("t", x + 1)
    cells = every.select(key, "dc", "l", "t", cell)
    return cells.select(key, x.cast("int").alias("x"), y.alias("y"), F.lit(0.0).alias("none"), F.col("dc").cast("double").alias("dc"), ((across + down) / 2).alias("planar"), across.alias("across"), down.alias("down"))


def directions(dims: int) -> list[tuple[int, ...]]:
    """Candidates with steps in -2..2, dimension 0 fastest: one step forward and one of size 2 at least."""
    every = (d[::-1] for d in itertools.product(range(-2, 3), repeat=dims))
    return [d for d in every if max(d) > 0 and max(map(abs, d)) == 2]


def best_mode(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, mode, sse) the mode of least error; of equal ones the first."""
    return errors.groupBy(*keys).agg(F.min(F.struct("sse", "mode")).alias("m")).select(*keys, "m.mode", "m.sse")


def shifted(coordinate: Column, shift: Column | int, size: int) -> Column:
    """Where the content at a coordinate goes when an image is rolled by ``shift``."""
    return F.pmod(coordinate - shift, F.lit(size)).cast("int")


def shift_of_view(view: Column, side: int, step: Column | int) -> Column:
    """The shift of a view: its distance from the middle one, times the step."""
    return (view - side // 2) * step
