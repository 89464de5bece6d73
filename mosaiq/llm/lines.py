"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash of the line's key, documents that hold it, largest doc_id that holds
it), one row for each key, sorted by hash. Batches are ranges of doc_id, the largest first, so that
the first batch that has a key also has the document that keeps its lines. A new batch becomes a
run of level 0 without the keys that the runs already settle (enough documents have them): a merge
anti-join of sorted runs, after which a line that a third of all documents hold is no longer
counted. When a level has ``FANOUT`` runs, they are compacted into one run of the next level, so
that a store of n batches holds few runs and rewrites each row a logarithmic number of times.
A key's totals are the sum over the runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, drop_stash, stash

LEAST_CHARS, LEAST_DOCS = 40, 5
FANOUT, BATCHES = 3, 4
#: Frequent keys that travel to the workers at most (5 MB, and 50 MB in each); more are joined to the texts.
MOST_KEYS = 200_000
_SPACES = SPACES.encode()
_KEYS = "h1 bigint, h2 bigint"


def line_hash(line: bytes, least: int = LEAST_CHARS) -> tuple[int, int] | None:
    """128 bits of the key of a line: its white space at both ends stripped and A-Z in lower
    case; None if the key has fewer than ``least`` code points."""
    import xxhash

    key = line.strip(_SPACES)
    # Bytes of the form 10xxxxxx continue a code point.
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    h = xxhash.xxh3_128_intdigest(key.lower())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def line_keys(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the distinct keys of each row's lines."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, one, two = [], [], []
            for doc, body in zip(part["__id"], part["__text"], strict=True):
                found = {line_hash(x, least) for x in body.encode().split(b"\n")} if body else set()
                found.discard(None)
                ids += [doc] * len(found)
                one += [h[0] for h in found]
                two += [h[1] for h in found]
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "h1": pd.Series(one, dtype="int64"), "h2": pd.Series(two, dtype="int64")})

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.mapInPandas(batches, f"doc_id bigint, {_KEYS}")


def as_run(keys: DataFrame) -> DataFrame:
    """One row for each key. Rows that share a doc_id are one document. The first aggregation deals
    a key's documents to all tasks, so that a common line is no hot group."""
    once = keys.select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def merged(runs: list[DataFrame]) -> DataFrame:
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    if len(runs) == 1:
        return every
    return every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


@dataclass
class LineRuns:
    """The store: ``levels[k]`` lists the runs of level k, each a sorted table in the shared folder."""

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        """Add a batch's keys (of ``line_keys``) as a run; documents must not come twice, and
        batches come from the largest doc_ids down."""
        run = as_run(keys)
        if self.runs():
            run = run.join(self.settled(least_docs), ["h1", "h2"], "left_anti")
        self._put(0, run)

    def settled(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(h1, h2) of the keys that so many documents of the runs hold."""
        return self.totals().where(F.col("n_docs") >= least_docs).select("h1", "h2")

    def _put(self, k: int, run: DataFrame) -> None:
        while len(self.levels) <= k:
            self.levels.append([])
        self.levels[k].append(stash(run.sortWithinPartitions("h1", "h2"), f"lines-level{k}"))
        if len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            self._put(k + 1, merged(old))
            for run in old:
                drop_stash(run)

    def totals(self) -> DataFrame:
        return merged(self.runs())


def batches_of(docs: DataFrame, n: int, key: str = "doc_id") -> tuple[DataFrame, int]:
    """The table with the number ``batch`` of ``n`` ranges of doc_id, 0 with the largest ones; and
    the number of ranges."""
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        return docs.withColumn("batch", F.lit(0)), 1
    starts = sorted({low + (high - low + 1) * k // n for k in range(1, n)})
    below = [(F.col(key) < x).cast("int") for x in starts]
    return docs.withColumn("batch", sum(below, F.lit(0))), len(starts) + 1


def frequent_keys(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, last_doc) of the keys found in at least ``least_docs`` documents, by way of runs. Texts
    are read and hashed once for all batches."""
    store = LineRuns(docs.sparkSession)
    keys, n = batches_of(line_keys(docs, text), batches) if batches > 1 else (line_keys(docs, text).withColumn("batch", F.lit(0)), 1)
    keys = stash(keys, "lines-keys", "batch")
    for k in range(n):
        store.add(keys.where(F.col("batch") == k).drop("batch"), least_docs)
    drop_stash(keys)
    return store.totals().where(F.col("n_docs") >= least_docs).select("h1", "h2", "last_doc")


def deduplicated(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """Add n_lines, n_dropped and ``kept`` (the text of the lines that stay).

    A frequent key loses all its lines except in the largest doc_id that holds it. A null or
    empty text is one empty line. Rows with a null doc_id neither count nor lose lines; rows
    that share a doc_id are one document and are treated alike. Long texts are split whole. Further
    columns pass through (those of the three names are replaced); an empty table gives an empty one.

    Up to ``MOST_KEYS`` frequent keys go to the workers and no text is shuffled; beyond, the keys
    that each document loses are joined to it.
    """
    spark = docs.sparkSession
    frequent = stash(frequent_keys(docs, text, least_docs, batches), "lines-frequent")
    few = frequent.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    if few:
        found = frequent.toPandas()
        shipped = spark.sparkContext.broadcast([found[c].to_numpy() for c in ("h1", "h2", "last_doc")])
        joined = docs.withColumn("__drop", F.lit(None).cast(f"array<struct<{_KEYS}>>"))
    else:
        shipped = None
        losing = line_keys(docs, text).distinct().join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
        drops = losing.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_list(F.struct("h1", "h2")).alias("__drop"))
        joined = docs.join(drops, docs["doc_id"] == F.col("__of"), "left").drop("__of")

    @F.pandas_udf("n_lines bigint, n_dropped bigint, kept string")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        last = {}
        if shipped is not None:
            h1, h2, doc = (x.tolist() for x in shipped.value)
            last = dict(zip(zip(h1, h2, strict=True), doc, strict=True))
        for ids, named, texts, lists in parts:
            out = []
            for i, has_id, body, dropped in zip(ids, named, texts, lists, strict=True):
                lines = (body or "").split("\n")
                stay = lines
                if dropped is not None and len(dropped):
                    gone = {(x["h1"], x["h2"]) for x in dropped}
                    stay = [x for x in lines if line_hash(x.encode()) not in gone]
                elif last and has_id and body and len(body) >= LEAST_CHARS:
                    stay = [x for x in lines if last.get(line_hash(x.encode()), i) == i]
                out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
            yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    out = joined.withColumn("__out", apply(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNotNull(), F.col(text), F.col("__drop")))
    return out.select(*(F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")), "__out.n_lines", "__out.n_dropped", "__out.kept")


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
