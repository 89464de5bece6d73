"""Colour projections, level shifts and quantisers: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import clamped

# Coefficients of the transform between RGB and YCbCr (ITU-T T.871).
TO_YCBCR = {"y": (0.299, 0.587, 0.114), "cb": (-0.168736, -0.331264, 0.5), "cr": (0.5, -0.418688, -0.081312)}
FROM_YCBCR = {"r": (1.0, 0.0, 1.402), "g": (1.0, -0.344136, -0.714136), "b": (1.0, 1.772, 0.0)}


def _matrix(table: dict[str, tuple[float, ...]], *inputs: Column) -> list[Column]:
    return [(row[0] * inputs[0] + row[1] * inputs[1] + row[2] * inputs[2]).alias(name) for name, row in table.items()]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """y, cb, cr as doubles; chroma has no offset."""
    return _matrix(TO_YCBCR, r, g, b)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    return _matrix(FROM_YCBCR, y, cb, cr)


def rgb_to_ycocg(r: Column, g: Column, b: Column) -> list[Column]:
    return [(r / 4 + g / 2 + b / 4).alias("y"), (r / 2 - b / 2).alias("co"), (g / 2 - r / 4 - b / 4).alias("cg")]


def ycocg_to_rgb(y: Column, co: Column, cg: Column) -> list[Column]:
    return [(y + co - cg).alias("r"), (y + cg).alias("g"), (y - co - cg).alias("b")]


def rct_forward(r: Column, g: Column, b: Column, depth: int = 8) -> list[Column]:
    """The reversible transform with its level shift: y, u, v."""
    y = F.shiftright(r + 2 * g + b, 2) - (1 << (depth - 1))
    return [y.alias("y"), (b - g).alias("u"), (r - g).alias("v")]


def rct_inverse(y: Column, u: Column, v: Column, depth: int = 8) -> list[Column]:
    top = (1 << depth) - 1
    g = clamped(y + (1 << (depth - 1)) - F.shiftright(u + v, 2), 0, top)
    return [clamped(v + g, 0, top).alias("r"), g.alias("g"), clamped(u + g, 0, top).alias("b")]


def bit_depth(maxval: Column) -> Column:
    """Bits that samples up to ``maxval`` need."""
    return F.ceil(F.log2(maxval + 1)).cast("int")


def rounding_shift(a: Column, bits: int) -> Column:
    return F.shiftright(a + (1 << (bits - 1)), bits)


def quantised(c: Column, bits: int) -> Column:
    """round(c / 2^bits), half away from zero."""
    return F.round(c / float(1 << bits))


def dequantised(c: Column, bits: int) -> Column:
    return c * float(1 << bits)


def shift_quantised(c: Column, bits: int) -> Column:
    """The arithmetic shift: floor, also of negatives."""
    return F.shiftright(c, bits)


def shift_dequantised(c: Column, bits: int) -> Column:
    return F.shiftleft(c, bits)


def quality_scaled(entry: Column, quality: int) -> Column:
    factor = 50.0 / quality if quality < 50 else (200.0 - 2 * quality) / 100
    return F.round(entry * factor)


def output_sample(value: Column, depth: int = 8) -> Column:
    return clamped(F.round(value).cast("int"), 0, (1 << depth) - 1)
