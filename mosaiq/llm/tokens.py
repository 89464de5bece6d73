"""Token counts as an exact length histogram.

Documents are encoded once and counted by encoded length. The histogram has one row for
each length that occurs, so its size follows the longest document, not the corpus; its
running sums answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths are summed in blocks of so many, so that no task sees the whole histogram.
BLOCK = 1024
#: Context limits and shares of documents that the query answers beside every length that occurs.
LIMITS = tuple(1 << k for k in range(7, 21))
FRACTIONS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def token_count(spark, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of a text; null and empty texts have 0. Only the driver reads the
    vocabulary file; executors get its bytes."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    shipped = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Null and empty texts
    count as length 0; long texts are encoded whole; repeated rows count each; only the text is
    read of the columns; an empty table gives no rows. Stashed, so that texts are encoded once."""
    counted = docs.select(token_count(docs.sparkSession, F.col(text), vocabulary).alias("n_tokens"))
    return stash(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "token-histogram")


def with_limits(hist: DataFrame, limits: Iterable[int] = LIMITS) -> DataFrame:
    """The histogram with a row of 0 documents for each limit that no document has. An empty one stays empty."""
    limits = hist.sparkSession.createDataFrame([(int(m), 0) for m in limits], "n_tokens bigint, n_docs bigint")
    every = hist.unionByName(limits).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return every if not hist.isEmpty() else hist


def with_sums(hist: DataFrame) -> DataFrame:
    """Add, for each length L taken as a context limit: docs_within (length <= L), docs_over,
    tokens_within, tokens_over, and truncated_total (the sum of least(length, L))."""
    blocks = hist.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "__tokens", F.col("n_tokens") * F.col("n_docs")
    )
    totals = blocks.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = totals.select(
        "__block",
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__d", "__t")),
        *(F.sum(c).over(every).alias(f"{c}1") for c in ("__d", "__t")),
    )
    upto = Window.partitionBy("__block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(totals, "__block").select(
        "n_tokens",
        "n_docs",
        (F.col("__d0") + F.sum("n_docs").over(upto)).alias("docs_within"),
        (F.col("__t0") + F.sum("__tokens").over(upto)).alias("tokens_within"),
        "__d1",
        "__t1",
    )
    over = F.col("__d1") - F.col("docs_within")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        "tokens_within",
        (F.col("__t1") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + F.col("n_tokens") * over).alias("truncated_total"),
    )


def with_quantiles(sums: DataFrame, fractions: Iterable[float] = FRACTIONS) -> DataFrame:
    """Add ``quantile_of``: the shares of documents for which a length is the smallest within which
    so many lie."""
    total, before = F.col("docs_within") + F.col("docs_over"), F.col("docs_within") - F.col("n_docs")
    reached = lambda f: (F.col("docs_within") >= f * total) & (before < f * total)
    return sums.withColumn("quantile_of", F.filter(F.array(*(F.lit(float(f)) for f in fractions)), reached))


def quantiles(sums: DataFrame, fractions: Iterable[float]) -> DataFrame:
    """(fraction, n_tokens): the smallest length within which that share of documents lies."""
    share = F.col("docs_within") / (F.col("docs_within") + F.col("docs_over"))
    picks = [F.min(F.when(share >= f, F.col("n_tokens"))).alias(str(k)) for k, f in enumerate(fractions)]
    pairs = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.col(str(k)).alias("n_tokens")) for k, f in enumerate(fractions)))
    return sums.agg(*picks).select(F.inline(pairs))


def truncated_totals(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """(limit, total): tokens left when every document is cut to ``limit`` tokens."""
    limits = list(limits)
    within = lambda c, m: F.coalesce(F.sum(F.when(F.col("n_tokens") <= m, F.col(c))), F.lit(0))
    product = F.col("n_tokens") * F.col("n_docs")
    sums = sums.withColumn("__product", product)
    parts = [
        (within("__product", m) + m * (F.coalesce(F.sum("n_docs"), F.lit(0)) - within("n_docs", m))).alias(str(k))
        for k, m in enumerate(limits)
    ]
    pairs = F.array(*(F.struct(F.lit(int(m)).cast("long").alias("limit"), F.col(str(k)).alias("total")) for k, m in enumerate(limits)))
    return sums.agg(*parts).select(F.inline(pairs))


def query(spark, sf_dir: str) -> DataFrame:
    counted = histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    return with_quantiles(with_sums(with_limits(counted)))
