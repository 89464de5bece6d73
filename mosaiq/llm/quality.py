"""Quality rules as a short-circuit cascade.

Every rule is a native expression that says when a document is rejected, and one that says how
many steps it takes (a comparison is one, a regular expression on a line or word several). A
sample of the documents, chosen by a hash, tells what each rule costs and which it rejects; the
rules then stand in one ``CASE``: first the one with most rejections per cost, then the best on
what that one leaves, and so on. A document leaves at the first rule that rejects it. Steps are
counted, not timed, so that the order is the same in every run. It changes the time, never the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, held, with_shingles, words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    steps: Column | None = None  # of one row; one if not given


#: Steps of a regular expression on one line or word.
PATTERN = 8


def default_rules() -> list[Rule]:
    """Rules on the columns that ``measured`` adds. All bounds compare whole numbers."""
    n, lines = F.col("n_words"), F.col("__lines")
    marked = F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("^[-*•]")))
    open_ended = F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$")))
    lettered = F.size(F.filter("__words", lambda x: x.rlike("\\p{L}")))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 3 * F.size(lines)),
        Rule("bullets", 10 * marked > 9 * F.size(lines), 1 + PATTERN * F.size(lines)),
        Rule("ellipses", 10 * open_ended > 3 * F.size(lines), 1 + PATTERN * F.size(lines)),
        Rule("letters", 10 * lettered < 7 * n, 1 + PATTERN * n),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    ``__words``, ``__lines`` and ``__shingles`` stay for the rules; ``judged`` drops them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__words", held(words(F.col(text)))).withColumn(
        "__lines", held(F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    )
    df = with_shingles(df, F.col("__words"), "__shingles")
    # A hash takes part in the count only where it comes again: sort (hash, place), then
    # keep the places whose neighbour has the same hash.
    several = F.size("__shingles") > F.size(F.array_distinct("__shingles"))
    df = df.withColumn(
        "__sorted",
        held(F.when(several, F.sort_array(F.transform("__shingles", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
    )
    same = lambda x, i: (F.get("__sorted", i - 1)["h"] == x["h"]) | (F.get("__sorted", i + 1)["h"] == x["h"])
    starts = F.sort_array(
        F.transform(F.filter("__sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    n = F.col("n_words")
    return (
        df.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    )


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per step on ``sample`` (a bounded table that ``measured`` made), each among
    the rows that the rules before it leave."""
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    steps = [F.coalesce(r.steps if r.steps is not None else F.lit(1), F.lit(1)).cast("double").alias(f"s{k}") for k, r in enumerate(rules)]
    rows = sample.where(~F.col("base_failed")).select(*flags, *steps).collect()
    out, left = [], list(range(len(rules)))
    while left:
        hits = {k: sum(r[f"r{k}"] for r in rows) for k in left}
        cost = {k: 1.0 + sum(r[f"s{k}"] for r in rows) for k in left}
        best = min(left, key=lambda k: (-(hits[k] + 0.5) / cost[k], rules[k].name))
        rows = [r for r in rows if not r[f"r{best}"]]
        left.remove(best)
        out.append(rules[best])
    return out


def sampled(docs: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """The texts of about ``rows`` rows, three times as many at most, chosen by a hash of the text
    over the whole table."""
    total = docs.count()
    part = docs.select(F.col(text))
    if total > rows:
        part = part.where(F.pmod(F.xxhash64(text), F.lit(1 << 40)) < (rows << 40) // total)
    return part.limit(3 * rows)


def judged(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 512) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept``.

    About ``sample_rows`` rows serve to order the rules; the verdict covers all rows and
    whole texts. Null and empty texts have no words and fail the base. Repeated rows are
    judged each for itself, an empty table gives an empty one, further columns pass through
    (columns with the names this adds are replaced).
    """
    rules = default_rules() if rules is None else rules
    df = measured(docs, text)
    if len(rules) > 1:
        rules = ordered(measured(sampled(docs, sample_rows, text), text), rules)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    return df.withColumn("kept", verdict.otherwise(F.lit(True))).drop("__words", "__lines", "__shingles", "__sorted")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i:i+4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, w, l, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * len(l)
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * len(l)
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(l)
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < 7 * n_words) AS kept
FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(*COLUMNS)
