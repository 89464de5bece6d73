"""Toxicity by a linear classifier on character n-grams.

A feature is how densely a character n-gram (hashed to 2^20 places) stands in the text. Features
are scaled by their naive Bayes log-count ratio and a logistic regression is fitted on the scaled
ones. Cross-validation inside the training rows picks the number of features, the penalty and
the bias. The fit sees a bounded sample of labelled rows; scores cover all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (4, 5, 6)
PLACES = 20
#: Bounds of the training sample: rows of each label, and code points of all its texts.
MOST_ROWS = {1: 1500, 0: 2000}
MOST_CHARS = 24_000_000
#: Texts are hashed in pieces of so many code points, which overlap so that no n-gram is lost; each counts
#: where it starts.
PIECE = 1 << 20
SMOOTHING, STEPS, FOLDS = 0.5, 100, 3
#: An n-gram in fewer sampled documents tells nothing. Numbers of features (the most telling ones)
#: and penalties that cross-validation picks from.
LEAST_DOCS, FEATURES, PENALTIES = 4, (1000, 3000), (1e-3, 1e-2)
#: A feature's value is log(1 + occurrences per so many code points); shorter texts than the
#: second number count as that long.
PER_CHARS, LEAST_CHARS = 2000, 200
#: A false alarm rate counts so often as much as a rate of misses where the bias is chosen.
FALSE_ALARM = 3.0


def ngram_places(text: str) -> Iterator[np.ndarray]:
    """For each piece and order: the places of all n-grams of the lower-case text, padded with spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    reach = max(ORDERS) - 1
    for at in range(0, max(1, len(codes) - min(ORDERS) + 1), PIECE):
        piece = codes[at : at + PIECE + reach].astype(np.uint64)
        h = np.zeros(len(piece), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(piece) < n:
                break
            h = h[: len(piece) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + piece[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                start = h[:PIECE]
                yield ((start ^ (start >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PLACES)).astype(np.int32)


def features(text: str, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of a text's n-grams and their values; with ``keep``, only those it marks."""
    found = [p if keep is None else p[keep[p]] for p in ngram_places(text)]
    places, count = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int32), return_counts=True)
    return places, np.log1p(count * (PER_CHARS / max(len(text), LEAST_CHARS)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def margin(self, text: str | None, keep: np.ndarray | None = None) -> float:
        places, values = features(text or "", self.weights != 0 if keep is None else keep)
        return self.bias + float(self.weights[places] @ values)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.margin(text), -35, 35))))


def _regression(owner: np.ndarray, index: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights of ``n`` features and the bias; both labels weigh the same in all."""
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=w[index] * values, minlength=len(y)) + w[n]
        error = share * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.r_[np.bincount(index, weights=error[owner] * values, minlength=n) + penalty * w[:n], error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:n], float(w[n])


def _shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to subtract from out-of-fold margins so that misses and false alarms weigh least: the
    middle of the best gap, the one nearest to 0 of equal ones."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    misses = np.r_[0, np.cumsum(y)] / y.sum()
    alarms = 1 - np.r_[0, np.cumsum(1 - y)] / (1 - y).sum()
    loss = misses + FALSE_ALARM * alarms
    cuts = np.r_[z[0], (z[1:] + z[:-1]) / 2, z[-1]]
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on whole texts. Without rows of both labels, every score is that one label's."""
    weights = np.zeros(1 << PLACES, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(weights, 4.0 if len(labels) and labels[0] == 1 else -4.0)
    y = labels.astype(np.float64)
    fold = np.zeros(len(y), dtype=np.int64)
    for value in (0, 1):
        fold[labels == value] = np.arange((labels == value).sum()) % FOLDS
    sums = np.zeros((FOLDS, 2, 1 << PLACES), dtype=np.float32)
    seen = np.zeros(1 << PLACES, dtype=np.int32)
    for text, label, k in zip(texts, labels, fold, strict=True):
        places, values = features(text)
        sums[k, label, places] += values
        seen[places] += 1
    # For each fold the rest, and last all rows: log-count ratios and the most telling places.
    ratios, chosen = [], []
    for k in range(FOLDS + 1):
        rest = sums.sum(axis=0) - (sums[k] if k < FOLDS else 0)
        n = [max(1, ((labels == c) & (fold != k)).sum()) for c in (0, 1)]
        ratio = np.log((rest[1] + SMOOTHING) / (n[1] + 2 * SMOOTHING)) - np.log((rest[0] + SMOOTHING) / (n[0] + 2 * SMOOTHING))
        strength = np.where(seen >= LEAST_DOCS, np.abs(ratio) * np.sqrt(np.maximum(rest.sum(axis=0), 0)), 0)
        best = np.argsort(-strength, kind="stable")[: max(FEATURES)]
        ratios.append(ratio[best])
        chosen.append(best[strength[best] > 0])
    del sums
    union = np.unique(np.concatenate(chosen))
    keep = np.zeros(1 << PLACES, dtype=bool)
    keep[union] = True
    rows = [features(t, keep) for t in texts]
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    place, value = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])

    def trained(k: int, most: int, penalty: float) -> tuple[np.ndarray, float]:
        """Weights by place and the bias, without fold ``k``."""
        mine = chosen[k][:most]
        column = np.full(1 << PLACES, -1, dtype=np.int32)
        column[mine] = np.arange(len(mine))
        use = (column[place] >= 0) & (fold[owner] != k)
        renumbered = np.cumsum(fold != k) - 1
        index, scale = column[place[use]], ratios[k][: len(mine)]
        w, b = _regression(renumbered[owner[use]], index, value[use] * scale[index], y[fold != k], len(mine), penalty)
        out = np.zeros(1 << PLACES)
        out[mine] = w * scale
        return out, b

    best = (np.inf, FEATURES[0], PENALTIES[-1], 0.0)
    if min((labels == c).sum() for c in (0, 1)) >= 2 * FOLDS:
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for most in FEATURES:
            for penalty in PENALTIES:
                z = np.zeros(len(y))
                for k in range(FOLDS):
                    w, b = trained(k, most, penalty)
                    out = np.bincount(owner, weights=w[place] * value, minlength=len(y)) + b
                    z[fold == k] = out[fold == k]
                loss = float(share @ np.logaddexp(0, np.where(y == 1, -z, z)))
                if loss < best[0]:
                    best = (loss, most, penalty, _shift(z, y))
    w, b = trained(FOLDS, *best[1:3])
    return Model(w.astype(np.float32), b - best[3])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(text, label): labelled documents that aren't held out, at most ``MOST_ROWS`` of each
    label by the order of a hash of doc_id. A doc_id with several labels counts as toxic if one
    says so; null labels and ids are left out."""
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    named = named.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for value, most in MOST_ROWS.items():
        part = named.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most the sum of MOST_ROWS rows of an id and a label; of rows that share an id, one text.
    named = texts.join(F.broadcast(picked), "doc_id").withColumn("__by", F.struct(F.xxhash64("text"), "text"))
    one = named.groupBy("doc_id", "label").agg(F.min("__by").alias("__by"))
    return one.select("doc_id", F.col("__by.text").alias("text"), "label")


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on ``training_rows`` until ``MOST_CHARS`` code points are used, whole texts only."""
    texts, marks, chars = [], [], 0
    rows = training_rows(docs, labels, label).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    for row in rows.toLocalIterator():
        if chars + len(row["text"]) <= MOST_CHARS:
            chars += len(row["text"])
            texts.append(row["text"])
            marks.append(row["label"])
    return fit(texts, np.array(marks, dtype=np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5). Only the text is an input;
    null texts score as empty ones, repeated rows alike, further columns pass through. Very long
    texts are hashed piece by piece and count as a whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shipped.value
        keep = model.weights != 0
        for texts in batches:
            z = np.array([model.margin(t, keep) for t in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    out = docs.withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
