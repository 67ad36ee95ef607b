"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies them.

A text is lower-cased and cut at all that is no letter or digit. A template of m shingles of five words
belongs to a class with windows of WINDOW_FACTOR times the class's size that start every half window, so
that some window holds any run of that size. The 64-bit hashes of a window fall into bins by their first
bits; the smallest hash of each bin is one band. A template is retrieved where a band of the window
equals a band of the template. In a window of w shingles, a shared shingle is not the smallest of its bin
with a probability of at most w / (2 * bins). With 2 ** BIN_BITS bins that is 0.00012 for the smallest
class (w = 16), so even a template of a single shingle is retrieved almost surely, and one of m shingles is
missed with the m-th power of a number that stays below 0.01 up to windows of 1,000 shingles.

Retrieved templates are verified exactly: the share of their shingles that the text around the window
holds. All is column expressions; only windows that retrieved something leave their row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.llm.text import SHINGLE_WORDS
from alertline.session import stored

MIN_CONTAINMENT = 0.8
WINDOW_FACTOR = 2
SMALLEST_CLASS = 8
BIN_BITS = 16

# Notices as they stand in texts, by the licence they name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the hashes of all shingles in order of their place; too short a text has none."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    w, h = f"{name}_words", f"{name}_hashes"
    df = df.withColumn(w, F.array_remove(F.split(clean, " "), ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    first = F.slice(h, 1, F.greatest(F.size(h) - (SHINGLE_WORDS - 1), F.lit(0)))
    rolled = F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(F.col(h), i + j) for j in range(1, SHINGLE_WORDS))))
    return df.withColumn(name, rolled).drop(w, h)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _bands(ascending: Column) -> Column:
    """The smallest hash of each bin, of ascending hashes."""
    return F.filter(
        ascending, lambda x, i: (i == 0) | (_bin(x) != F.coalesce(_bin(F.get(ascending, i - 1)), _bin(x)))
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row for each template: license, shingles (distinct), class (window size), bands.

    A template needs at least five words.
    """
    short = [k for k, t in templates.items() if len(re.findall(r"[^\W_]+", t)) < SHINGLE_WORDS]
    if short:
        raise ValueError(f"templates need at least {SHINGLE_WORDS} words: {short}")
    df = spark.createDataFrame(sorted(templates.items()), "license string, template string").coalesce(1)
    df = _shingles(df, F.col("template"), "shingles")
    df = df.withColumn("places", F.size("shingles")).withColumn("shingles", F.array_sort(F.array_distinct("shingles")))
    level = F.ceil(F.log2(F.greatest(F.col("places") / SMALLEST_CLASS, F.lit(1.0))))
    size = (F.lit(SMALLEST_CLASS * WINDOW_FACTOR) * F.pow(F.lit(2.0), level)).cast("int")
    return df.withColumn("window", size).withColumn("bands", _bands(F.col("shingles"))).drop("template")


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT
) -> DataFrame:
    """The templates that documents hold: doc_id, license, containment, first_word, n_windows.

    Reads ``doc_id`` and ``text``, whole. ``containment`` is the largest share of the template's shingles
    found around one window, ``first_word`` where the first window that verified begins, ``n_windows`` how many
    did. Null, empty and short texts hold nothing and have no row. Rows that repeat a doc_id, or have none,
    count as one document. Other columns are ignored; an empty table gives an empty result.

    The templates are a given list; their bands become literals.
    """
    spark = docs.sparkSession
    known = stored(template_table(spark, templates or TEMPLATES), "templates")
    bands = known.select("window", F.explode("bands").alias("band")).distinct().collect()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = _shingles(docs, F.col("text"), "shingles").drop("text")
    found = []
    for window in sorted({b["window"] for b in bands}):
        wanted = sorted(b["band"] for b in bands if b["window"] == window)
        found.append(_windows(window, wanted))
    docs = docs.withColumn("windows", F.concat(*found))
    # the outer form: else the optimizer works the windows out twice, to drop empty arrays early
    docs = docs.select("doc_id", "shingles", F.explode_outer("windows").alias("w")).filter("w IS NOT NULL")
    docs = docs.select("doc_id", "w.start", "w.window", F.explode("w.bands").alias("band"), _around().alias("around"))
    known = known.select("license", F.col("shingles").alias("template"), "window", F.explode("bands").alias("band"))
    hits = docs.join(F.broadcast(known), ["window", "band"])
    shared = F.size(F.array_intersect("template", "around")) / F.size("template")
    hits = hits.select("doc_id", "license", "start", shared.alias("share")).filter(F.col("share") >= min_containment)
    return hits.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"),
        F.min("start").cast("long").alias("first_word"),
        F.count_distinct("start").alias("n_windows"),
    )


def _windows(window: int, wanted: list[int]) -> Column:
    """The windows of one size that share a band with a template: start, window, bands."""
    step = window // 2
    shingles = F.col("shingles")
    starts = F.when(F.size(shingles) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1 - step, F.lit(0)), F.lit(step))
    )

    def look(start: Column) -> Column:
        part = F.transform(
            F.array(F.sort_array(F.slice(shingles, start + 1, window))),
            lambda s: F.filter(_bands(s), lambda x: x.isin(wanted)),
        )
        return F.struct(start.alias("start"), F.lit(window).alias("window"), F.get(part, F.lit(0)).alias("bands"))

    return F.filter(F.transform(starts, look), lambda w: F.size(w["bands"]) > 0)


def _around() -> Column:
    """The shingles of a window and of half a window on either side."""
    start, window = F.col("w.start"), F.col("w.window")
    first = F.greatest(start - F.floor(window / 2).cast("int"), F.lit(0))
    return F.array_distinct(F.slice("shingles", first + 1, window * 2))
