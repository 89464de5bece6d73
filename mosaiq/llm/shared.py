"""Places and words that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 5

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a
    temporary one where it is unset and all runs in one local JVM (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mosaiq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` columns, and read it again. This cuts the
    lineage: a lost executor costs nothing that was stashed, and later plans know the real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosaiq/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    for path in {f[: f.index("/", f.rindex("/mosaiq/") + 8)] for f in df.inputFiles()}:
        _forget(df.sparkSession, path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs without the six white-space characters; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, for scans that look past case and punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def held(value: Column) -> Column:
    """``value``, worked out once for each row. The optimizer copies deterministic expressions
    into filters and into the lambdas that use them, where a text would be split again for
    each of its words; it leaves a condition on the partition in place. The value is always the same."""
    return F.when(F.spark_partition_id() >= 0, value)


def with_shingles(df: DataFrame, words_: Column, out: str, size: int = SHINGLE) -> DataFrame:
    """Add the hashes of all ``size``-word windows in order; a shorter sequence is one
    shingle, an empty one has none. Words are hashed once; windows then mix these hashes."""
    base, n = f"__{out}_words", F.size(f"__{out}_words")
    later = lambda i: [F.get(base, i + k) for k in range(1, size)]
    every = F.transform(base, lambda x, i: F.xxhash64(x, *later(i)))
    return (
        df.withColumn(base, held(F.transform(words_, lambda w: F.xxhash64(w))))
        .withColumn(
            out,
            held(
                F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n < size, F.array(F.xxhash64(F.col(base))))
                .otherwise(F.slice(every, F.lit(1), F.greatest(n - (size - 1), F.lit(1))))
            ),
        )
        .drop(base)
    )
