"""License scans: MinHash bands over overlapping text windows, then exact containment.

Windows have the length of the templates they look for and overlap by three quarters. The
signature of a window meets a template's in some band with a probability that the number of
bands guarantees; the pair is then decided by the exact share of the template's shingles in
the text around the window. Only windows that hold a shingle of some template are signed: any
other has nothing to be contained, so nothing is lost. All of it is native expressions on one
row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE, held, plain_words, with_shingles

CONTAINMENT = 0.75
ROWS, SURE = 2, 0.9999

# The templates, opening passages of public licenses and usual notices.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def stride(n_words: int) -> int:
    return max(1, n_words // 4)


def bands_for(n_words: int, containment: float = CONTAINMENT) -> int:
    """Bands with which a passage that reaches ``containment`` meets its template with
    probability ``SURE``, in the window that lies nearest to it."""
    t = max(1, n_words - SHINGLE + 1)
    shared = max(1.0, containment * t - stride(n_words) / 2)
    similar = min(1.0, shared / (2 * t - shared))
    return max(1, math.ceil(math.log(1 - SURE) / math.log(1 - min(0.999999, similar**ROWS))))


def _band_keys(hashes: Column, bands: int) -> Column:
    """Keys of all bands: each mixes the band's number and the minima of its rows."""
    seeds, numbers = F.sequence(F.lit(0), F.lit(bands * ROWS - 1)), F.sequence(F.lit(0), F.lit(bands - 1))
    minima = F.transform(seeds, lambda seed: F.array_min(F.transform(hashes, lambda h: F.xxhash64(seed, h))))
    # The array of one gives the minima a name inside, so that they are worked out once.
    keys = lambda m: F.transform(numbers, lambda b: F.xxhash64(b, *(F.get(m, b * ROWS + r) for r in range(ROWS))))
    return F.get(F.transform(F.array(minima), keys), 0)


def template_table(spark, templates: dict[str, str]) -> list[dict]:
    """Name, word count, distinct shingle hashes and band keys of each template with words."""
    rows = [(name, text) for name, text in templates.items() if re.search(r"\w", text or "")]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "name string, text string").withColumn("w", plain_words(F.col("text")))
    df = with_shingles(df, F.col("w"), "h").withColumn("h", F.array_distinct("h"))
    lengths = sorted({r["n"] for r in df.select(F.size("w").alias("n")).collect()})
    df = df.select("name", F.size("w").alias("n"), "h")
    keys = F.coalesce(*(F.when(F.col("n") == n, _band_keys(F.col("h"), bands_for(n))) for n in lengths))
    return [r.asDict() for r in df.withColumn("keys", keys).collect()]


def _longs(values: list[int]) -> Column:
    """A literal array, which stays one expression however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _windows(t: int, step: int) -> Column:
    """Numbers of the windows with a hit: window k starts at word k * step and has t shingles."""
    last = lambda i: F.floor(i / step).cast("int")
    first = lambda i: F.greatest(F.lit(0), F.floor((i - t + step) / step).cast("int"))
    return F.array_distinct(F.flatten(F.transform("__hits", lambda i: F.sequence(first(i), last(i)))))


def _signed(t: int, step: int, bands: int):
    """For a window's number: its band keys, and the shingles in it and a step around it."""

    def make(k: Column) -> Column:
        keys = _band_keys(F.slice("__h", k * step + 1, F.lit(t)), bands)
        at = F.greatest(k * step - step, F.lit(0))
        return F.struct(at.alias("from"), keys.alias("keys"), F.slice("__h", at + 1, F.lit(t + 2 * step)).alias("near"))

    return make


def _best(out: str, r: dict, least: int) -> Column:
    """The best window of template ``r`` among those that met it in a band; null if none has
    ``least`` of its shingles."""
    own, keys, size = _longs(r["h"]), _longs(r["keys"]), len(r["h"])
    t = max(1, r["n"] - SHINGLE + 1)
    met = F.filter(out, lambda w: F.arrays_overlap(w["keys"], keys))

    def shares(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w["near"])), lambda j: F.array_contains(own, F.element_at(w["near"], j)))
        share = lambda j: F.size(F.array_intersect(F.slice(w["near"], j, F.lit(t)), own))
        return F.transform(starts, lambda j: F.struct(share(j).alias("n"), (1 - j - w["from"]).alias("at")))

    best = F.array_max(F.flatten(F.transform(met, shares)))
    found = F.struct(F.lit(r["name"]).alias("name"), (-best["at"]).cast("int").alias("start"), (best["n"] / size).alias("containment"))
    return F.when(best["n"] >= least, found)


def scanned(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Add ``licenses``: an array of (name, start, containment), start being the first word of
    the best passage, in the order of names; empty where nothing is found.

    Words are lower-case runs of letters and digits. Null and empty texts have no license.
    The templates are a literal table of the plan. Rows are scanned one by one: repeated rows
    and further columns pass through.
    """
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    kind = "array<struct<name:string,start:int,containment:double>>"
    if not table:
        return docs.withColumn("licenses", F.array().cast(kind))
    known = _longs(sorted({h for r in table for h in r["h"]}))
    df = with_shingles(docs, plain_words(F.col(text)), "__h")
    # The part of the row that windows need is null for all texts without a template's shingle.
    df = df.withColumn("__h", held(F.when(F.arrays_overlap("__h", known), F.col("__h"))))
    df = df.withColumn("__hits", held(F.filter(F.transform("__h", lambda h, i: F.when(F.array_contains(known, h), i)), lambda i: i.isNotNull())))
    columns = []
    for n in sorted({r["n"] for r in table}):
        group = [r for r in table if r["n"] == n]
        t, step, out = max(1, n - SHINGLE + 1), stride(n), f"__found{n}"
        windows, signed = _windows(t, step), _signed(t, step, bands_for(n, containment))
        df = df.withColumn(out, held(F.transform(windows, signed)))
        for r in group:
            columns.append((r["name"], out, _best(out, r, math.ceil(containment * len(r["h"]) - 1e-9))))
    every = F.filter(F.array(*(c for _, _, c in sorted(columns, key=lambda x: x[0]))), lambda x: x.isNotNull())
    found = F.when(F.col("__h").isNull(), F.array().cast(kind)).otherwise(every.cast(kind))
    return df.withColumn("licenses", held(found)).drop("__h", "__hits", *{o for _, o, _ in columns})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs).where(F.size("licenses") > 0)
    return found.select("doc_id", F.explode("licenses").alias("l")).select(
        "doc_id", "l.name", "l.start", F.round("l.containment", 6).alias("containment")
    )


def _sql() -> str:
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in TEMPLATES.items())
    return rf"""
WITH t(name, text) AS (VALUES {rows}),
ts AS (SELECT DISTINCT name, s FROM (SELECT name, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS s
       FROM (SELECT name, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM t))),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM documents),
ds AS (SELECT doc_id, i, w[i+1:i+5] AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, name, i, s FROM ds JOIN ts USING (s)),
r AS (SELECT a.doc_id, a.name, a.i, count(DISTINCT b.s) AS c
      FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.name = b.name JOIN tn ON a.name = tn.name
      WHERE b.i BETWEEN a.i AND a.i + tn.n - 1 GROUP BY ALL)
SELECT doc_id, name, CAST(min(i) FILTER (WHERE c = m) AS INTEGER) AS start, round(max(c) / any_value(tn.n), 6) AS containment
FROM (SELECT *, max(c) OVER (PARTITION BY doc_id, name) AS m FROM r) JOIN tn USING (name)
GROUP BY doc_id, name HAVING max(c) >= 0.75 * any_value(tn.n)
"""


ORACLE = _sql()
