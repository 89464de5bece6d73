"""Shards of bounded size by extendible hashing.

A document's place is a 64-bit hash. The directory is indexed by a prefix of its bits; a
bucket whose bytes exceed the limit splits on one more bit, and only such buckets do. The
directory is built from one histogram of bytes by prefix, deep enough for an even spread;
what is still too large there is counted again on further bits, alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

LIMIT = 8 << 20
BITS = 64
#: Bits beyond an even spread that the first histogram has, and bits of each further one.
SLACK, STEP = 3, 8


def bits(*columns: Column) -> Column:
    """64 characters 0 or 1: the first bits of an MD5 over the given columns."""
    joined = F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.lpad(F.conv(F.substring(F.md5(joined), 1, 16), 16, 2), 64, "0")


def _leaves(fine: DataFrame, least: int, depth: int, limit: int) -> DataFrame:
    """From bytes by ``depth``-bit prefix: (p, shard, shard_bytes), the shallowest prefix of at
    least ``least`` bits that fits; shard is null where even ``depth`` bits don't do."""
    every = fine.select("p", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d"), "b")
    sums = every.groupBy(F.substring("p", F.lit(1), F.col("d")).alias("shard")).agg(
        F.sum("b").alias("shard_bytes"), F.collect_list(F.when(F.col("d") == depth, F.col("p"))).alias("own")
    )
    fits = sums.where(F.col("shard_bytes") <= limit).select("shard", "shard_bytes", F.length("shard").alias("d"))
    found = every.withColumn("shard", F.substring("p", F.lit(1), F.col("d"))).join(fits.drop("d"), "shard")
    best = found.groupBy("p").agg(F.min_by(F.struct("shard", "shard_bytes"), "d").alias("m"))
    return fine.select("p").join(best, "p", "left").select("p", "m.shard", "m.shard_bytes")


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``shard`` (the bucket's prefix of bits), ``shard_bytes`` and ``oversize``.

    Bytes are those of the texts in UTF-8; null and empty texts have none. The hash covers key
    and text, so that rows that share a key still split; rows equal in both, and a document
    over the limit, can't be split: such a shard has 64 bits and ``oversize`` is true. One
    shard has the empty prefix if all fits. Further columns pass through.
    """
    sized = docs.withColumn("__bits", bits(F.col(key), F.col(text))).withColumn(
        "__bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    )
    small = sized.select("__bits", "__bytes")
    total = small.agg(F.sum("__bytes")).first()[0] or 0
    depth = min(BITS, math.ceil(math.log2(max(1, total / limit))) + SLACK)
    level = small.groupBy(F.substring("__bits", 1, depth).alias("p")).agg(F.sum("__bytes").alias("b"))
    directory = stash(_leaves(level, 0, depth, limit), "shard-directory")
    parts = [directory.where("shard IS NOT NULL").withColumn("depth", F.lit(depth))]
    open_ = directory.where("shard IS NULL").select("p")
    while depth < BITS and not open_.isEmpty():
        deeper = min(BITS, depth + STEP)
        inside = small.withColumn("p", F.substring("__bits", 1, depth)).join(open_, "p", "left_semi")
        level = inside.groupBy(F.substring("__bits", 1, deeper).alias("p")).agg(F.sum("__bytes").alias("b"))
        directory = stash(_leaves(level, depth + 1, deeper, limit), "shard-directory")
        parts.append(directory.where("shard IS NOT NULL").withColumn("depth", F.lit(deeper)))
        open_, depth = directory.where("shard IS NULL").select("p"), deeper
    last = sized.join(open_.select(F.col("p").alias("__bits")), "__bits", "left_semi") if depth == BITS else None
    out = []
    for part in parts:
        n = part.select("depth").first()
        if n:
            entry = part.select(F.col("p").alias("__p"), "shard", "shard_bytes")
            hit = sized.withColumn("__p", F.substring("__bits", 1, n[0])).join(entry, "__p")
            out.append(hit.drop("__p").withColumn("oversize", F.lit(False)))
    if last is not None:
        whole = last.groupBy("__bits").agg(F.sum("__bytes").alias("shard_bytes"))
        out.append(last.join(whole, "__bits").withColumn("shard", F.col("__bits")).withColumn("oversize", F.lit(True)))
    if not out:
        empty = sized.withColumn("shard", F.lit("")).withColumn("shard_bytes", F.lit(0).cast("long"))
        out = [empty.withColumn("oversize", F.lit(False))]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.drop("__bits", "__bytes")


ORACLE = f"""
WITH b AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n,
                  lpad(to_binary(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(1) || coalesce(text, '')), 1, 8)) AS BIGINT)), 32, '0') AS p
           FROM documents),
e AS (SELECT doc_id, n, d, substr(p, 1, d) AS shard FROM b, range(0, 25) t(d)),
s AS (SELECT shard, sum(n) AS shard_bytes FROM e GROUP BY shard HAVING sum(n) <= {LIMIT}),
f AS (SELECT doc_id, arg_min(e.shard, d) AS shard, arg_min(s.shard_bytes, d) AS shard_bytes
      FROM e JOIN s ON e.shard = s.shard GROUP BY doc_id)
SELECT doc_id, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes, false AS oversize FROM f
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select("doc_id", "shard", "shard_bytes", "oversize")
