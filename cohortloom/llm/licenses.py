"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Everything runs as DataFrame functions. Texts and templates are lower-cased and cut into runs of letters and digits; a shingle is two
consecutive words. Each scale (words of a window, its step) has `bands` bands of one MinHash value:

* 8 words every 4: a template of 5 words lies whole in some window (similarity 4/7 or more), longer ones are cut into windows of 8
  words at every offset, one of which equals some window of the text. 8 bands: found with probability 1 - (3/7)**8 > 0.998.
* 4 words every 2, for templates of fewer than 5 words: 3 words lie whole in some window (2/3 or more). 6 bands: > 0.998.

Two windows agree in a band only if they share the shingle that has the smallest value, so a window without any shingle of a template can't
be retrieved; only windows that hold one are hashed. A retrieved template is verified on the words around the window: the share of its distinct
shingles that occur there is its containment, and it is reported from `least` up.

Null or empty texts and texts of one word have no shingles and no licenses. Rows that repeat a doc_id are scanned together. Very long texts are scanned whole, window by window. Of windows
with the same containment the first is told. Other columns of the documents aren't read. Empty tables, or no templates, give no rows. Hot
licenses are no hot groups: windows are joined with the few templates by broadcast (a fixed table), and hits are aggregated by document and license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices in the wording that their licenses recommend.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Words of a window, its step, bands, and the lengths of templates (least, below) that the scale serves.
SCALES = ((8, 4, 8, 5, 1 << 30), (4, 2, 6, 2, 5))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    # No lambda refers to a whole array: the optimizer may copy such expressions, and each element would compute them anew.
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0)))


def _bands(shingles: Column, bands: int) -> Column:
    def least(j: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(j))))

    return F.array(*(F.struct(F.lit(j).alias("band"), least(j).alias("least")) for j in range(bands)))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(texts.items()), "license string, template string")
    return rows.select("license", _words(F.col("template")).alias("tw")).withColumn("ts", _shingles(F.col("tw"))).withColumn("length", F.size("tw")).withColumn("distinct", F.array_distinct("ts")).where("length >= 2")


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, first_word, windows): licenses in each document, the best containment, the
    word where its first window starts and the number of windows that retrieve it."""
    known = templates(docs.sparkSession, TEMPLATES if texts is None else texts)
    wanted = sorted({s for r in known.select("distinct").collect() for s in r[0]})
    longest = max((r[0] for r in known.select("length").collect()), default=0)
    words = docs.select("doc_id", _words(F.col("text")).alias("w"))
    # A column that isn't deterministic keeps filters above from being pushed down, which would hash the words again.
    hashed = words.select("doc_id", F.monotonically_increasing_id().alias("row"), _shingles(F.col("w")).alias("s"))
    places = F.filter(F.transform("s", lambda s, i: F.when(s.isin(wanted), i)), lambda i: i.isNotNull())
    at = hashed.select("doc_id", "row", "s", places.alias("at")).where(F.size("at") > 0)
    found = None
    for width, step, bands, low, high in SCALES:
        of = known.where((F.col("length") >= low) & (F.col("length") < high))
        cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("length") - width))
        marks = of.select("license", "distinct", F.explode(F.transform(cuts, lambda i: F.slice("ts", i + 1, width - 1))).alias("ws")).select("license", "distinct", F.explode(_bands(F.col("ws"), bands)).alias("b")).select("license", "distinct", "b.*").distinct()
        # The windows start at multiples of step; those that hold the shingle at i.
        starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-width // step))), lambda d: (F.floor(i / step) - d) * step), lambda x: (x >= 0) & (x + (width - 2) >= i)))))
        windows = at.select("doc_id", "row", "s", F.explode(starts.cast("array<int>")).alias("start"))
        reach = longest + width
        around = F.slice("s", F.greatest(F.lit(1), F.col("start") + 1 - reach), F.lit(2 * reach + width))
        keyed = windows.select("doc_id", "row", "start", around.alias("around"), F.explode(_bands(F.slice("s", F.col("start") + 1, F.lit(width - 1)), bands)).alias("b")).select("doc_id", "row", "start", "around", "b.*")
        hits = keyed.join(F.broadcast(marks), ["band", "least"])
        checked = hits.select("doc_id", "row", "license", "start", (F.size(F.array_intersect("around", "distinct")) / F.size("distinct")).alias("containment")).where(F.col("containment") >= least)
        found = checked if found is None else found.unionByName(checked)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("row", "start").alias("windows"))
