"""Symbol sequences: runs, move-to-front, suffix order and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(df: DataFrame, keys: list[str], order: str, value: str = "v") -> DataFrame:
    """(zeroes, amplitude) for each value that isn't 0: the zeros just before it."""
    rows = df.where(F.col(value) != 0)
    line = Window.partitionBy(*keys).orderBy(order)
    gap = F.col(order) - F.coalesce(F.lag(order).over(line), F.lit(-1)) - 1
    return rows.select(*keys, order, gap.cast("long").alias("zeroes"), F.col(value).alias("amplitude"))


def magnitude_class(a: Column) -> Column:
    """Bit length of the absolute value."""
    return F.when(a == 0, 0).otherwise(F.length(F.bin(F.abs(a).cast("long")))).cast("int")


def packed_symbol(zeroes: Column, amplitude: Column, class_bits: int) -> Column:
    return zeroes * (1 << class_bits) + magnitude_class(amplitude)


def suffix_types(df: DataFrame, keys: list[str], order: str, symbol: str) -> DataFrame:
    """S if a suffix is smaller than the next one, else L; the last is L. ``lms``: an S after an L."""
    line = Window.partitionBy(*keys).orderBy(order)
    after = F.lead(symbol).over(line)
    known = F.when(after.isNull() | (F.col(symbol) > after), "L").when(F.col(symbol) < after, "S")
    out = df.withColumn("__t", known)
    rest = line.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("type", F.first("__t", ignorenulls=True).over(rest)).drop("__t")
    return out.withColumn("lms", (F.col("type") == "S") & F.coalesce(F.lag("type").over(line) == "L", F.lit(False)))


def rotations(df: DataFrame, text: str) -> DataFrame:
    """The Burrows-Wheeler transform of short strings by sorting rotations: ``last`` (the last
    characters in that order) and ``primary`` (the place of the string itself)."""
    n = F.length(text)
    every = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(F.concat(F.substring(F.col(text), k + 1, n), F.substring(F.col(text), F.lit(1), k)).alias("r"), k.alias("k")),
    )
    out = df.where(n > 0).withColumn("__r", F.sort_array(every))
    last = F.array_join(F.transform("__r", lambda x: F.substring(x["r"], n, F.lit(1))), "")
    primary = F.array_position(F.transform("__r", lambda x: x["k"]), 0) - 1
    return out.withColumn("last", last).withColumn("primary", primary.cast("int")).drop("__r")


def restored(last: Column, primary: Column) -> Column:
    """The string whose rotations gave ``last`` and ``primary``: the sorted characters, each with its
    place in ``last``, lead from one row to the next."""
    order = F.sort_array(F.transform(F.split(last, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
    start = F.struct(primary.cast("int").alias("at"), F.lit("").alias("out"))

    def step(state: Column, row: Column) -> Column:
        here = F.element_at(row, state["at"] + 1)
        return F.struct(here["i"].alias("at"), F.concat(state["out"], here["c"]).alias("out"))

    return F.when(F.length(last) == 0, "").otherwise(F.aggregate(F.array_repeat(order, F.length(last)), start, step)["out"])


def suffix_array(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, rank, pos): suffixes of short strings in order. Work grows with the square of a string's length."""
    every = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda k: F.struct(F.substring(F.col(text), k + 1, F.length(text)).alias("s"), k.alias("k")))
    rows = df.where(F.length(text) > 0).select(*keys, F.posexplode(F.sort_array(every)).alias("rank", "x"))
    return rows.select(*keys, "rank", F.col("x.k").alias("pos"))


def canonical_codes(lengths: DataFrame, keys: list[str], symbol: str, length: str = "length") -> DataFrame:
    """Codewords in the order of (length, symbol): the running sum of 2^-length, cut to length."""
    line = Window.partitionBy(*keys).orderBy(length, symbol).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.pow(F.lit(2.0), 32 - F.col(length))).over(line), F.lit(0.0))
    code = F.floor(used / F.pow(F.lit(2.0), 32 - F.col(length))).cast("long")
    return lengths.withColumn("code", F.lpad(F.bin(code), F.col(length).cast("int"), "0"))
