"""Finds license texts in documents by MinHash bands over word windows.

A template is a run of words; its shingles are its runs of `shingle` words. Each template is sought in windows of
its own size class (m is the next power of two): `WINDOW * m` shingles, `m` apart. They hold every run of 2 * m + 1
shingles whole, so a template's text may have m + 1 words inserted, as many as it has shingles and one, wherever
it is in the document; what is spread over more may be lost. If a window holds `least` of a template's shingles, their Jaccard
similarity is at least least * n / (WINDOW * m + (1 - least) * n) for a template of n shingles. With one minimum a band, as many
bands as give a collision with chance `recall` at that similarity (see `bands`) retrieve the template from the
window. Then exact containment is computed on the words themselves.

All steps are DataFrame operations. A text that lacks certain words cannot hold `least` of a template (see
`required`), nor can one without any shingle of a template; such documents, which are most, are left out
before windows are made. Templates are given values, so all that
depends on them is bounded: `most` shingles at the most.

Words are what a text has between anything but letters, digits and points, in lower case; points at the end go.
Null, empty and short texts have no window and are no row of the result; null and repeated ids are taken as
they are, equal rows count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wordings by which texts state a license.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

SHINGLE = 3
#: The length of a window, in steps from one window to the next.
WINDOW = 3


def words(text: str) -> list[str]:
    """The words of a template, as `word_array` gives those of a column."""
    return [w for x in re.split(r"[^a-z0-9.]+", text.lower()) if (w := x.rstrip("."))]


def word_array(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"\.*[^a-z0-9.]+|\.+$")
    return F.filter(parts, lambda x: x.rlike("[^.]"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(parts: Column) -> Column:
    run = lambda k: F.concat_ws(" ", *[F.get(parts, k + j) for j in range(SHINGLE)])
    return F.when(F.size(parts) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(parts) - SHINGLE), run)).otherwise(F.array().cast("array<string>"))


def minimum(hashes: Column, band: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def size_class(shingles: int) -> int:
    return 1 << max(0, shingles - 1).bit_length()


def bands(shingles: int, least: float, recall: float) -> int:
    """Bands of one minimum each, so that a window with `least` of a template collides with chance `recall`."""
    similar = least * shingles / (WINDOW * size_class(shingles) + (1 - least) * shingles)
    return math.ceil(math.log(1 - recall) / math.log(1 - similar))


def required(shingles: list[str], least: float) -> list[str]:
    """Words, long ones first, of which a text with `least` of the shingles has at least one: they are in more
    shingles than may be missing."""
    may_miss = len(shingles) - math.ceil(least * len(shingles) - 1e-9)
    chosen: list[str] = []
    for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        if sum(any(w in s.split() for w in chosen) for s in shingles) > may_miss:
            break
        chosen.append(word)
    return chosen


def scan(spark: SparkSession, documents: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, recall: float = 0.999, most: int = 20_000) -> DataFrame:
    """A row per document and template found: its id, license, containment (the best), first_word (of the first
    window that has it) and windows (how many have it)."""
    cut = {name: [" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)] for name, text in (templates or TEMPLATES).items() if (w := words(text))}
    rows = [(name, size_class(len(set(x))), sorted(set(x)), bands(len(set(x)), least, recall)) for name, x in cut.items() if x]
    if sum(len(r[2]) for r in rows) > most:
        raise ValueError(f"the templates have over {most} shingles")
    wanted = spark.createDataFrame(rows, "license string, m int, known array<string>, bands int")
    hashed = F.transform("known", lambda x: F.xxhash64(x))
    sought = wanted.select("license", "m", "known", F.explode(F.sequence(F.lit(1), "bands")).alias("band"), hashed.alias("hashes"))
    sought = sought.select("license", "m", "known", "band", minimum(F.col("hashes"), F.col("band")).alias("low"))
    classes = {m: max(r[3] for r in rows if r[1] == m) for m in sorted({r[1] for r in rows})}

    told = F.array(*[F.lit(x) for x in sorted({x for r in rows for x in r[2]})])
    runs = bound(word_array(F.col(text_col).cast("string")), _runs)
    # as rows of a generator the runs are computed once, and a document without a known one has no row
    told_words = sorted({w for r in rows for w in required(r[2], least)})
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    documents = documents.filter(bound(text, lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in told_words], F.lit(False))))
    held = documents.select(F.col(id_col).alias("__id"), F.explode(F.filter(F.array(runs), lambda r: F.arrays_overlap(r, told))).alias("__runs"))
    # the windows of all size classes, in one pass
    of_class = lambda m, count: lambda k: F.struct(k.alias("first_word"), F.lit(m).alias("m"), F.lit(count).alias("count"))
    each = [F.transform(F.sequence(F.lit(0), F.size("__runs") - 1, F.lit(m)), of_class(m, count)) for m, count in classes.items()]
    windows = held.select("__id", "__runs", F.inline(F.flatten(F.array(*each))))
    windows = windows.select("__id", "first_word", "m", "count", F.slice("__runs", F.col("first_word") + 1, WINDOW * F.col("m")).alias("runs"))
    lows = bound(F.transform("runs", lambda x: F.xxhash64(x)), lambda hashes: F.transform(F.sequence(F.lit(1), "count"), lambda band: minimum(hashes, band)))
    keys = windows.select("__id", "first_word", "m", "runs", F.posexplode(lows).alias("at", "low")).withColumn("band", F.col("at") + 1)
    met = keys.join(F.broadcast(sought), ["m", "band", "low"])  # given templates, bounded by `most`
    share = F.size(F.array_intersect("known", "runs")) / F.size("known")
    sure = met.select("__id", "license", "first_word", share.alias("share")).filter(F.col("share") >= least).distinct()
    found = sure.groupBy("__id", "license").agg(F.max("share").alias("containment"), F.min("first_word").alias("first_word"), F.count("*").alias("windows"))
    return found.withColumnRenamed("__id", id_col)
