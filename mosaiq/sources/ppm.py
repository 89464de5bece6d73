"""Binary PPM images: read by Spark's binary file source, written one file for each image."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.sources.containers import placed

_GAP = rb"(?:\s|#[^\n]*\n)+"
_HEADER = re.compile(rb"P6" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)\s")


def header(content: bytes) -> tuple[int, int, int, int] | None:
    """(width, height, maxval, offset of the samples), or None if it is no such image."""
    found = _HEADER.match(content)
    if not found:
        return None
    w, h, top = map(int, found.groups())
    if w <= 0 or h <= 0 or not 0 < top < 65536 or len(content) <= found.end():
        return None
    return w, h, top, found.end()


def packed(width: int, height: int, maxval: int, samples) -> bytes:
    """One byte for each sample up to 255, else two, the high one first."""
    kind = "u1" if maxval < 256 else ">u2"
    return b"P6\n%d %d\n%d\n" % (width, height, maxval) + np.asarray(samples).astype(kind).tobytes()


def images(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, width, height, maxval, data) of all readable images; others are left out."""

    @F.pandas_udf("width int, height int, maxval int, data binary")
    def parse(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            found = header(bytes(content))
            rows.append((*found[:3], bytes(content[found[3] :])) if found else (None,) * 4)
        return pd.DataFrame(rows, columns=["width", "height", "maxval", "data"])

    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", parse("content").alias("i")).select("path", "i.*").where("width IS NOT NULL")


def checked_uniform(df: DataFrame) -> DataFrame:
    """The images; raises if they differ in size or maximum."""
    shape = F.struct("width", "height", "maxval")
    if df.select(shape.alias("s")).distinct().limit(2).count() > 1:
        raise ValueError("images differ in size or maximum")
    return df


def pixels(df: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b), one row for each pixel."""

    @F.pandas_udf("array<int>")
    def samples(data: pd.Series, maxval: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, dtype="u1" if m < 256 else ">u2").astype("int32") for d, m in zip(data, maxval, strict=True)])

    rows = df.select("path", "width", F.col("height"), samples("data", "maxval").alias("s"))
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p")
    rows = rows.select("path", "width", "s", at)
    part = [F.get("s", 3 * F.col("p") + k).alias(n) for k, n in enumerate("rgb")]
    return rows.select("path", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *part)


def write(px: DataFrame, width: int, height: int, maxval: int, folder: str) -> None:
    """One file for each path, under the path's last part, in a folder of a file system that all
    executors share. A file appears whole or not at all, so that a repeated task does no harm."""

    def put(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        data = packed(width, height, maxval, part[["r", "g", "b"]].to_numpy().ravel())
        return pd.DataFrame({"path": [placed(folder, part["path"].iloc[0], data)]})

    px.groupBy("path").applyInPandas(put, "path string").count()
