"""License scan in SQL functions: MinHash bands over overlapping text windows, then containment.

Texts and templates become hashed shingles of five words. Windows of 1, 4 or 16 shingles (the class
below the template's size), overlapping by half, are reduced to four minima, each a band
of its own; the template's windows are taken at every offset. So a template lying unchanged in a
text shares a whole window with it and is always retrieved, and one whose window has kept a
Jaccard similarity J is retrieved by that window with probability 1 - (1 - J)^4 (0.94 at one half).
Retrieved pairs are verified by the exact share of the template's shingles within text windows
of twice its size, overlapping by half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.functions.frames import evaluated_once
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

SHINGLE = 5
CONTAINED = 0.8
BANDS = 4
#: Shingles a window: templates with at least this many shingles use it.
CLASSES = {1: 1, 4: 6, 16: 24}
#: Bound on the templates' band keys for a broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

# Wording of common license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [(i, license_, text) for i, (license_, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id bigint, license string, text string")


def _every(array: Column, first: int, size: Column, step: int, fn) -> Column:
    """fn(i) for i = first, first + step ... below `size`; an empty list if there is none."""
    return F.when(
        size > first, F.transform(F.sequence(F.lit(first), size - 1, F.lit(step)), fn)
    ).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame) -> DataFrame:
    """Add `__h`: the hashes of all shingles of `text`, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    df = evaluated_once(df, __words=words)
    run = lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(SHINGLE)])
    hashes = _every(F.col("__words"), 0, F.size("__words") - (SHINGLE - 1), 1, run)
    return evaluated_once(df, __h=hashes).drop("__words", "text")


def _permuted(band: int) -> Column:
    return F.col("__h") if band == 0 else F.transform("__h", lambda x: F.xxhash64(x, F.lit(band)))


def _key(least: Column, window: int, band: int) -> Column:
    return F.xxhash64(least, F.lit(window * BANDS + band))


def text_keys(df: DataFrame) -> DataFrame:
    """Explode `__h` into the band keys of all text windows; keys tell class and band by their hash."""
    pairs = {}
    for band in range(BANDS):  # minima of two shingles: every window is made of whole pairs
        p = F.col(f"__p{band}")
        pairs[f"__m{band}"] = _every(p, 0, F.size(p) - 1, 2, lambda i: F.least(F.get(p, i), F.get(p, i + 1)))
    df = evaluated_once(df, **{f"__p{band}": _permuted(band) for band in range(BANDS)})
    df = evaluated_once(df, **pairs)
    keys = [F.transform("__h", lambda x: _key(x, 1, 0))]
    for band in range(BANDS):
        m = F.col(f"__m{band}")
        keys.append(_every(m, 0, F.size(m) - 1, 1, lambda i: _key(F.least(F.get(m, i), F.get(m, i + 1)), 4, band)))
        keys.append(_every(m, 0, F.size(m) - 7, 4, lambda i: _key(F.array_min(F.slice(m, i + 1, 8)), 16, band)))
    keep = [c for c in df.columns if not c.startswith("__")]
    return df.select(*keep, F.explode(F.concat(*keys)).alias("key"))


def template_keys(templates: DataFrame) -> DataFrame:
    """(template_id, key): the band keys of each template's windows at every offset."""
    size, parts = F.size("__h"), []
    least = list(CLASSES.values()) + [1 << 30]
    for (window, low), high in zip(CLASSES.items(), least[1:]):
        some = templates.filter((size >= low) & (size < high))
        for band in range(1 if window == 1 else BANDS):
            p = _permuted(band)
            keys = _every(p, 0, size - (window - 1), 1, lambda i: _key(F.array_min(F.slice(p, i + 1, window)), window, band))
            parts.append(some.select("template_id", F.explode(keys).alias("key")))
    return reduce(DataFrame.unionByName, parts).distinct()


def bounded(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast `df` if it has at most `most` rows, otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template_id, license, n_shared, n_template): templates contained in documents.

    Edge cases: texts of fewer than five words, null and empty ones match nothing, and such templates
    are never found. Of several windows the best counts. Rows with the same or without an id are
    matched each by itself and give one row for each id and template. Empty tables give no row.
    Columns other than doc_id, text and the templates' three are not read.
    """
    own = durable(shingled(templates.select("template_id", "license", "text")), "templates")
    keys = bounded(durable(template_keys(own), "template_keys"))
    texts = docs.select("doc_id", "text")
    candidates = durable(
        text_keys(shingled(texts)).join(keys, "key").select(F.col("doc_id").alias("candidate"), "template_id").distinct(),
        "license_candidates",
    )
    parts = bounded(
        durable(
            own.select("template_id", "license", F.size(F.array_distinct("__h")).alias("n_template"),
                       F.size("__h").alias("length"), F.explode(F.array_distinct("__h")).alias("x")),
            "template_shingles",
        )
    )
    here = texts.join(candidates.select("candidate").distinct(), F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi")
    found = (
        shingled(here.withColumn("__row", F.monotonically_increasing_id()))
        .select("doc_id", "__row", F.posexplode("__h").alias("pos", "x"))
        .join(parts, "x")
        .withColumn("at", F.floor(F.col("pos") / F.col("length")))
        .withColumn("window", F.explode(F.array(F.col("at"), F.col("at") - 1)))
        .groupBy("__row", "doc_id", "template_id", "license", "n_template", "window")
        .agg(F.count_distinct("x").alias("n_shared"))
        .filter(F.col("n_shared") >= CONTAINED * F.col("n_template"))
        .groupBy("doc_id", "template_id", "license", "n_template")
        .agg(F.max("n_shared").alias("n_shared"))
    )
    pair = F.col("doc_id").eqNullSafe(F.col("candidate")) & (F.col("template_id") == F.col("of"))
    return found.join(candidates.withColumnRenamed("template_id", "of"), pair, "left_semi").select(
        "doc_id", "template_id", "license", "n_shared", F.col("n_template").cast("bigint").alias("n_template")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))


@query(
    rf"""
    WITH templates(template_id, license, text) AS (VALUES {_VALUES}),
    doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
    own_words AS (SELECT template_id, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM templates),
    own AS (
        SELECT template_id, license, array_to_string(w[i:i + 4], ' ') AS x, len(w) - 4 AS length
        FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM own_words)
    ),
    parts AS (
        SELECT DISTINCT template_id, license, x, length,
               (SELECT count(DISTINCT o.x) FROM own o WHERE o.template_id = own.template_id) AS n_template
        FROM own
    ),
    doc AS (
        SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS x
        FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM doc_words WHERE len(w) >= 5)
    ),
    hits AS (SELECT doc_id, template_id, license, n_template, x, pos // length AS win FROM doc JOIN parts USING (x)),
    windows AS (
        SELECT doc_id, template_id, license, n_template, x, win FROM hits
        UNION ALL SELECT doc_id, template_id, license, n_template, x, win - 1 FROM hits
    ),
    shared AS (
        SELECT doc_id, template_id, license, n_template, win, count(DISTINCT x) AS n_shared FROM windows GROUP BY ALL
    )
    SELECT doc_id, template_id::BIGINT AS template_id, license, max(n_shared) AS n_shared, n_template
    FROM shared WHERE n_shared >= 0.8 * n_template GROUP BY doc_id, template_id, license, n_template
    """
)
def op3_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan(table(spark, root, "documents"), default_templates(spark))
