"""Whole images as coded files and back: reversible colours, tiles, wavelet, quantiser, one stream for each
image, container. All but the stream is done by DataFrame functions."""

from __future__ import annotations

from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import coding
from mosaiq.operators import blocks, color, transforms
from mosaiq.sources import containers

#: The dimensions of a coded image, the fastest first.
NAMES = {2: ["x", "y"], 4: ["x", "y", "u", "w"]}
#: More bytes than the longest header has.
_HEAD = 256


def _tiles(names: list[str]) -> list[str]:
    return [f"tile_{n}" for n in names]


def encoded(px: DataFrame, keys: list[str], sizes: dict[str, int], step: dict[str, int], depth: int = 8, discarded: int = 0, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """(keys, data): one coded file for each image of (keys, names of ``sizes``, r, g, b).

    Blocks of ``step`` samples; the last ones along a dimension are filled by the last sample. Coefficients
    lose ``discarded`` low bits; with 0 nothing is lost. The format has one stream for an image, so the
    levels of an image must fit a task; images run side by side. An image with more or fewer
    pixels than its size raises. No images give no files."""
    names, dims = list(sizes), len(sizes)
    if names != NAMES.get(dims):
        raise ValueError("dimensions are x, y or x, y, u, w")
    planes = F.array(*color.rct_forward(F.col("r"), F.col("g"), F.col("b"), depth))
    cells = px.select(*keys, *names, F.posexplode(planes).alias("plane", "value"))
    order = [*keys, "plane", *_tiles(names)]
    there = transforms.dwt53(blocks.tiles(cells, sizes, step), order, step, "value")
    levels = there.select(*order, *names, color.shift_quantised(F.col("value"), discarded).alias("value"))
    head = containers.Header(f"{dims}D", tuple(sizes.values()), tuple(step.values()), depth, discarded, False, shift if dims == 4 else None)
    n = 3 * prod(-(-sizes[k] // step[k]) * step[k] for k in names)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) != n:
            raise ValueError(f"an image has {len(part)} levels, not {n}")
        part = part.sort_values([*reversed(_tiles(names)), "plane", *reversed(names)])
        coder, models = coding.Encoder(), (coding.LevelModel(), coding.LevelModel())
        for plane, level in zip(part["plane"].tolist(), part["value"].tolist(), strict=True):
            models[plane > 0].encode(coder, level)
        return part[keys].head(1).assign(data=containers.packed(head, coder.value()))

    kinds = dict(px.dtypes)
    return levels.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", data binary")


def header_of(files: DataFrame) -> containers.Header | None:
    """The header that all files share, None if there is no file. Raises if they differ or aren't coded images."""

    @F.pandas_udf("binary")
    def head(starts: pd.Series) -> pd.Series:
        return pd.Series([containers.packed(containers.parsed(bytes(d))[0], b"") for d in starts])

    found = files.select(head(F.substring("data", 1, _HEAD)).alias("h")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("coded images differ in their headers")
    return containers.parsed(bytes(found[0]["h"]))[0] if found else None


def decoded(files: DataFrame, keys: list[str], head: containers.Header) -> DataFrame:
    """(keys, names, r, g, b) of files (keys, data) with the header ``head``."""
    if head.predicted:
        raise ValueError("predicted images are not supported")
    names = NAMES[len(head.size)]
    sizes, step = dict(zip(names, head.size, strict=True)), dict(zip(names, head.block, strict=True))
    counts = {f"tile_{k}": -(-sizes[k] // step[k]) for k in names}
    one, n_tiles = prod(step.values()), prod(counts.values())

    @F.pandas_udf("array<int>")
    def levels(data: pd.Series) -> pd.Series:
        out = []
        for file in data:
            coder, models = coding.Decoder(containers.parsed(bytes(file))[1]), (coding.LevelModel(), coding.LevelModel())
            out.append([models[plane > 0].decode(coder) for _ in range(n_tiles) for plane in range(3) for _ in range(one)])
        return pd.Series(out)

    order = [*keys, "plane", *counts]
    cells = files.select(*keys, F.posexplode(levels("data")).alias("p", "value"))
    cells = blocks.shaped(cells, {**step, "plane": 3, **counts}, "p")
    cells = cells.withColumn("value", color.shift_dequantised(F.col("value"), head.discarded_bits))
    back = blocks.joined_tiles(transforms.idwt53(cells, order, step, "value"), sizes, step)
    plane = [F.max(F.when(F.col("plane") == k, F.col("value"))).alias(f"__{k}") for k in range(3)]
    whole = back.groupBy(*keys, *names).agg(*plane)
    return whole.select(*keys, *names, *color.rct_inverse(*(F.col(f"__{k}") for k in range(3)), head.depth_bits))
