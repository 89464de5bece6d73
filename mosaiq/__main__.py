"""``python -m mosaiq compress -i 'in/*.ppm' -o folder [-d bits]`` and ``decompress -i 'in/*.lfif' -o folder``.

Each image becomes one file in a folder that all executors share. Exit codes: 0 done, 1 the input can't
be read, is empty or not uniform, 2 wrong arguments."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import codec
from mosaiq.sources import containers, ppm

BLOCK = {"x": 8, "y": 8}


def _named(df: DataFrame, ending: str) -> DataFrame:
    return df.withColumn("path", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(ending)))


def compress(spark: SparkSession, pattern: str, folder: str, discarded: int) -> None:
    found = ppm.checked_uniform(ppm.images(spark, pattern))
    first = found.select("width", "height", "maxval").first()
    if first is None:
        raise ValueError("no image")
    sizes, depth = {"x": first["width"], "y": first["height"]}, first["maxval"].bit_length()
    containers.write(_named(codec.encoded(ppm.pixels(found), ["path"], sizes, BLOCK, depth, discarded), ".lfif"), folder)


def decompress(spark: SparkSession, pattern: str, folder: str) -> None:
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("data"))
    head = codec.header_of(files)
    if head is None or len(head.size) != 2:
        raise ValueError("no coded image of two dimensions")
    ppm.write(_named(codec.decoded(files, ["path"], head), ".ppm"), *head.size, 2**head.depth_bits - 1, folder)


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="mosaiq")
    parser.add_argument("what", choices=["compress", "decompress"])
    parser.add_argument("-i", required=True, metavar="PATTERN")
    parser.add_argument("-o", required=True, metavar="FOLDER")
    parser.add_argument("-d", type=int, default=0, choices=range(16), metavar="BITS", help="low bits of coefficients to discard")
    try:
        a = parser.parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("mosaiq").getOrCreate()
    try:
        compress(spark, a.i, a.o, a.d) if a.what == "compress" else decompress(spark, a.i, a.o)
    except Exception as e:  # noqa: BLE001
        print(f"mosaiq: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
