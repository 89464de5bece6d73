"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

A window has as many words as the item it may copy; all starts are windows. The similarity is
the shared part of both weights, so a window that reaches it holds a known share of shingles that
items of its length have. Windows with fewer can't match and are not signed; this loses
nothing. The others and the items get a SimHash of ``WORDS`` times 60 bits over their numbered
shingles. Fingerprints within ``RADIUS`` bits differ in at most ``NEAR`` bits in one of the blocks:
items are filed under all values so near to their own, so that an equi-join on blocks finds every
such pair. It is then decided by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE, held, plain_words, stash, with_shingles

SIMILARITY = 0.75
LANES, WIDTH = 3, 20  # counters for 3 bits in one long
#: Longs of a fingerprint, bits of a block, and the bits that an item's block may differ by.
WORDS, BLOCK, NEAR = 6, 12, 2
BLOCKS = WORDS * LANES * WIDTH // BLOCK
#: Bits that two fingerprints may differ by: one block of all differs in at most NEAR then. At a
#: similarity of 0.75 the cosine of two sets is 6/7 or more, so that 62 of 360 bits differ on
#: average, with a deviation of 7.2: 3.8 deviations more are within the radius.
RADIUS = (NEAR + 1) * BLOCKS - 1
#: Ids of texts with windows that are broadcast at most (16 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000


def _fingerprints(texts: DataFrame, key: str) -> DataFrame:
    """(key, len, f0, f1, ...): the SimHash of each distinct text's numbered shingles ``a``. Bit j is
    set if more than half of the shingles have it; three bits are counted in each sum, which
    holds up to 2^20 shingles."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("seed")
    rows = texts.select(key, "len", F.explode("a").alias("h")).select(key, "len", "h", seeds)
    rows = rows.select(key, "len", "seed", F.xxhash64("seed", "h").alias("h"))
    mask = sum(1 << (WIDTH * k) for k in range(LANES))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(mask))).alias(f"s{j}") for j in range(WIDTH)]
    counted = rows.groupBy(key, "len", "seed").agg(*sums, F.count("*").alias("n"))
    bit = lambda j, k: (2 * F.shiftrightunsigned(f"s{j}", WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) > F.col("n")).cast("long")
    parts = [F.shiftleft(bit(j, k), j + WIDTH * k) for j in range(WIDTH) for k in range(LANES)]
    value = parts[0]
    for x in parts[1:]:
        value = value.bitwiseOR(x)
    every = counted.select(key, "len", "seed", value.alias("fp"))
    return every.groupBy(key, "len").agg(*(F.max(F.when(F.col("seed") == k, F.col("fp"))).alias(f"f{k}") for k in range(WORDS)))


def _parts() -> list[Column]:
    """The blocks of a fingerprint."""
    per = LANES * WIDTH // BLOCK
    return [F.shiftrightunsigned(f"f{k}", BLOCK * j).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int") for k in range(WORDS) for j in range(per)]


def _blocked(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode(F.array(*_parts())).alias("block", "part"))


def _filed(df: DataFrame) -> DataFrame:
    """Each block with all values that differ from its own in at most ``NEAR`` bits."""
    masks = [sum(1 << j for j in bits) for n in range(NEAR + 1) for bits in combinations(range(BLOCK), n)]
    near = _blocked(df).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    return near.withColumn("part", F.col("part").bitwiseXOR(F.col("mask"))).drop("mask")


def _numbered(hashes: Column) -> Column:
    """A multiset as a set: each hash with the number of its occurrence, so that the size of
    an intersection is the sum of the least counts."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda x: x == h))))


def _identity(*columns: str) -> Column:
    """128 bits of the columns' values."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *columns)))


def _short_windows(n: int) -> Column:
    """Hashes of all windows of ``n`` words, each one shingle; null for shorter texts."""
    at = lambda i: F.xxhash64(F.transform(F.slice("w", i, F.lit(n)), lambda x: F.xxhash64(x)))
    return held(F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), at)))


def _starts(similarity: float) -> Column:
    """From the sorted places ``hits`` of shingles that items of ``len`` words have, in a text of ``n``
    words: the starts of all windows with as many of them as the similarity needs. A
    window's first hit is the k-th and it holds the ones up to the needed number from there."""
    own = F.least("len", "n") - (SHINGLE - 1)
    need = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (own + F.col("len") - (SHINGLE - 1)) - 1e-9)).cast("int")
    end = F.greatest(F.col("n") - F.col("len"), F.lit(0))

    def run(x: Column, k: Column) -> Column:
        first = F.greatest(F.coalesce(F.get("hits", k - 1) + 1, F.lit(0)), F.get("hits", k + need - 1) - own + 1, F.lit(0))
        last = F.least(x, end)
        known = F.get("hits", k + need - 1).isNotNull() & (first <= last)
        return F.when(known, F.sequence(F.least(first, last), last))

    return F.flatten(F.filter(F.transform("hits", run), lambda x: x.isNotNull()))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, item_id, start, similarity) of at least ``similarity``, the best window of
    each pair, counted in words from 0; of equal ones the first.

    Words are lower-case runs of letters and digits. A weight is the number of times a shingle
    occurs in the window or item. Items and windows of fewer than five words are one shingle
    of all their words. A text with fewer words than the item is one window. Null and empty
    texts, and items without words, match nothing; rows with a null id are left out. Repeated rows
    of a doc_id or item_id count as one document or item with several texts. Very long texts have
    a window at each word. Only doc_id, item_id and the text are read of the inputs.
    """
    items = items.where(F.col("item_id").isNotNull()).select("item_id", held(plain_words(F.col("text"))).alias("w"))
    items = with_shingles(items.where(F.size("w") > 0), F.col("w"), "hs").select("item_id", F.size("w").alias("len"), "hs")
    items = items.withColumn("iid", _identity("len", "hs")).withColumn("a", _numbered(F.col("hs")))
    items = stash(items.distinct(), "benchmark-items")
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("text")).withColumn("rid", _identity("doc_id", "text"))
    worded = docs.select("rid", held(plain_words(F.col("text"))).alias("w"))
    anchors = items.select("len", F.explode("hs").alias("h")).distinct()
    short = [r["len"] for r in anchors.where(F.col("len") < SHINGLE).select("len").distinct().collect()]
    five = with_shingles(worded, F.col("w"), "hs").select("rid", F.size("w").alias("n"), F.posexplode("hs").alias("i", "h"))
    hits = five.join(anchors.where(F.col("len") >= SHINGLE), "h").where(F.col("n") >= SHINGLE)
    grouped = hits.groupBy("rid", "n", "len").agg(F.sort_array(F.collect_set("i")).alias("hits"))
    windows = grouped.select("rid", "len", F.explode(_starts(similarity)).alias("start"))
    for n in short:
        few = worded.select("rid", F.posexplode(_short_windows(n)).alias("start", "h"))
        windows = windows.unionByName(few.join(anchors.where(F.col("len") == n), "h").select("rid", "len", "start"))
    windows = stash(windows.distinct(), "benchmark-starts")
    ids = stash(windows.select("rid").distinct(), "benchmark-ids")
    # The texts of these ids alone are read again; the ids are broadcast if they are proven few.
    few = ids if ids.limit(MOST_IDS + 1).count() > MOST_IDS else F.broadcast(ids)
    again = docs.join(few, "rid", "left_semi").dropDuplicates(["rid"])
    cut = again.select("doc_id", "rid", held(plain_words(F.col("text"))).alias("w")).join(windows, "rid")
    cut = cut.select("doc_id", "len", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("w"))
    cut = with_shingles(cut, F.col("w"), "hs").withColumn("wid", _identity("len", "hs"))
    cut = stash(cut.select("doc_id", "len", "start", "hs", "wid"), "benchmark-windows")
    one = cut.select("wid", "len", "hs").dropDuplicates(["wid"]).select("wid", "len", _numbered(F.col("hs")).alias("a"))
    one = stash(one, "benchmark-sets")
    other = items.dropDuplicates(["iid"]).select("iid", "len", "a")
    seen, known = _fingerprints(one, "wid"), _fingerprints(other, "iid")
    known = known.select("iid", "len", *(F.col(f"f{k}").alias(f"f{k}") for k in range(WORDS)))
    mine = _filed(known).select("iid", "len", "block", "part", *(F.col(f"f{k}").alias(f"g{k}") for k in range(WORDS)))
    near = _blocked(seen).join(mine, ["len", "block", "part"])
    bits = sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}"))) for k in range(WORDS)), F.lit(0))
    near = near.where(bits <= RADIUS).select("wid", "iid").distinct()
    pairs = near.join(one.select("wid", "a"), "wid").join(other.select("iid", F.col("a").alias("b")), "iid")
    both = F.size(F.array_intersect("a", "b"))
    exact = pairs.select("wid", "iid", (both / (F.size("a") + F.size("b") - both)).alias("similarity"))
    exact = stash(exact.where(F.col("similarity") >= similarity), "benchmark-pairs")
    found = cut.select("doc_id", "start", "wid").join(exact, "wid").join(items.select("item_id", "iid"), "iid")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).cast("int").alias("start"), F.col("m.similarity").alias("similarity"))


def without_matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that copy no item; rows with a null doc_id stay. Ids that are proven few are broadcast,
    so that texts are not shuffled; more are joined."""
    bad = matches(docs, items, similarity=similarity).select(F.col("doc_id").alias("__bad")).distinct()
    bad = stash(bad, "benchmark-copies")
    if bad.limit(MOST_IDS + 1).count() <= MOST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"] == F.col("__bad"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.round("similarity", 6))


# All windows that share a shingle with the item; any other has similarity 0.
ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM documents),
a AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS h FROM i WHERE len(w) >= 5),
c AS (SELECT item_id, n, h, count(*) AS ci FROM a GROUP BY ALL),
f AS (SELECT doc_id, m, p, array_to_string(w[p+1:p+5], ' ') AS h FROM (SELECT doc_id, len(w) AS m, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
t AS (SELECT doc_id, item_id, n, m, p, h, ci, least(m, n) - 4 AS own FROM f JOIN c USING (h)),
s AS (SELECT doc_id, item_id, n, own, h, ci, unnest(range(greatest(p - own + 1, 0), least(p, greatest(m - n, 0)) + 1)) AS start FROM t),
b AS (SELECT doc_id, item_id, n, own, start, h, least(count(*), any_value(ci)) AS k FROM s GROUP BY ALL),
y AS (SELECT doc_id, item_id, start, sum(k) / (own + n - 4 - sum(k)) AS similarity FROM b GROUP BY doc_id, item_id, n, own, start)
SELECT doc_id, item_id, CAST(arg_max(start, similarity - start * 1e-9) AS INTEGER) AS start, round(max(similarity), 6) AS similarity
FROM y WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
