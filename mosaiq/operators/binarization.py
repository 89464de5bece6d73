"""Numbers as strings of binary decisions, as the coders' contexts and bypass see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _low_bits(value: Column, n: Column) -> Column:
    """The ``n`` lowest bits, the highest first."""
    return F.when(n > 0, F.lpad(F.bin(value), n.cast("int"), "0")).otherwise("")


def _ones(n: Column) -> Column:
    return F.repeat(F.lit("1"), n.cast("int"))


def unary(value: Column) -> Column:
    return F.concat(_ones(value), F.lit("0"))


def exp_golomb(value: Column, k: int) -> Column:
    """Order ``k``: value + 2^k has n bits; n - 1 - k ones, a zero, then all bits but the first."""
    whole = value.cast("long") + (1 << k)
    n = F.length(F.bin(whole))
    return F.concat(_ones(n - 1 - k), F.lit("0"), F.substring(F.bin(whole), F.lit(2), n - 1))


def exp_golomb_value(bits: Column, k: int) -> Column:
    ones = F.instr(bits, "0") - 1
    tail = F.concat(F.lit("0"), F.substring(bits, ones + 2, F.length(bits)))
    return F.conv(tail, 2, 10).cast("long") + F.pow(F.lit(2.0), ones + k).cast("long") - (1 << k)


def ueg0(value: Column, most: int) -> Column:
    """Unary up to ``most`` ones; from there order 0 for the rest."""
    return F.when(value < most, unary(value)).otherwise(F.concat(F.lit("1" * most), exp_golomb(value - most, 0)))


def ueg0_value(bits: Column, most: int) -> Column:
    short = F.instr(bits, "0") - 1
    rest = F.substring(bits, F.lit(most + 1), F.length(bits))
    return F.when(short < most, short.cast("long")).otherwise(exp_golomb_value(rest, 0) + most)


def rice(value: Column, k: Column) -> Column:
    v = value.cast("long")
    quotient = F.floor(v / F.pow(F.lit(2.0), k)).cast("long")
    low = v - quotient * F.pow(F.lit(2.0), k).cast("long")
    return F.concat(unary(quotient), _low_bits(low, k))


def adaptive_rice(values: Column) -> Column:
    """Codes of an array in order; k starts at 0 and rises by one, up to 4, after a value above 3 * 2^k."""
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("codes"))

    def step(state: Column, v: Column) -> Column:
        k = state["k"]
        more = (v > 3 * F.pow(F.lit(2.0), k)) & (k < 4)
        return F.struct(F.when(more, k + 1).otherwise(k).alias("k"), F.concat(state["codes"], F.array(rice(v, k))).alias("codes"))

    return F.aggregate(values, start, step)["codes"]
