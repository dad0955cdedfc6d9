"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies; DataFrame functions only.

Words are lower-cased runs of letters and digits, shingles five words. Templates are dealt into classes of similar length; a
class has windows of W words, one starting at every S-th word, so that every occurrence lies whole in some window. Of such a
window and a template with a share tau (0.8) of its shingles the Jaccard similarity is at least j, known from the lengths,
and the class takes as many bands as find a pair of similarity j with probability 0.999 (bands_for). A window that has none
of the anchor words can't hold enough of any template: the anchors are words of the templates that hit more than 1 - tau of
the shingles of each, so leaving such windows out loses nothing. Candidates are verified by the exact containment of their
shingles, and the best window of each (document, template) is reported.

Cases: a null text or one without words has no windows; a text shorter than a window is one window; a template shorter than
a shingle is one shingle of all its words, found in windows by runs of as many words, and one without words is never found;
rows with one id and different texts are told apart, fully equal rows give one result; a null id is returned as null; empty
tables give an empty result; extra columns are ignored. Ties for the best window go to the first. The templates are a small
table by nature; the documents are never collected nor broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SHINGLE = 5
#: Templates of a class with no more words than this in all are broadcast, some tens of MB at most.
BROADCAST_WORDS = 50_000
WORDS = r"[\p{L}\p{N}]+"

#: Customary notices, as their owners publish them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def word_shingles(found: list[str], n: int) -> list[str]:
    return list(dict.fromkeys(" ".join(found[k : k + n]) for k in range(len(found) - n + 1)))


def anchors(templates: dict[str, list[str]], n: int, containment: float) -> list[str]:
    """Words without one of which a text has less than the containment of every template: chosen greedily, longest first."""
    shingles = {name: word_shingles(w, min(n, len(w))) for name, w in templates.items()}
    bare, chosen = {name: set(range(len(s))) for name, s in shingles.items()}, []
    hits = lambda word, name: {k for k in bare[name] if word in shingles[name][k].split(" ")}
    while open_ := [name for name in bare if len(bare[name]) >= containment * len(shingles[name])]:
        offered = sorted({w for name in open_ for k in bare[name] for w in shingles[name][k].split(" ")})
        best = max(offered, key=lambda w: (sum(bool(hits(w, name)) for name in open_) * min(len(w), 8), len(w)))
        chosen.append(best)
        for name in bare:
            bare[name] -= hits(best, name)
    return chosen


def bands_for(similarity: float, probability: float, rows: int = 1) -> int:
    """The fewest bands of so many rows that find a pair of the similarity with the probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < probability:
        bands += 1
    return bands


def size_classes(lengths: dict[str, int], ratio: float = 1.6) -> list[list[str]]:
    """Names by length, in classes whose longest is at most ratio times their shortest."""
    classes: list[list[str]] = []
    for name in sorted(lengths, key=lengths.get):
        if classes and lengths[name] <= ratio * lengths[classes[-1][0]]:
            classes[-1].append(name)
        else:
            classes.append([name])
    return classes


def _shingled(found: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda k: F.array_join(F.slice(found, k, n), " "))
    return F.when(F.size(found) >= n, F.array_distinct(runs)).otherwise(F.array(F.array_join(found, " ")))


def _bands(shingles: Column, bands: int, rows: int) -> Column:
    """Keys of the bands: minima of hash ^ constant, each constant an order of its own."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def least(k: int) -> Column:
        constant = 0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)
        return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(constant - (1 << 64) if constant >> 63 else constant))))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)]) for b in range(bands)])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, probability: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment, at_word, windows): for each license found in a row of docs, the share of its shingles in
    the best window, the number of words before that window, and how many windows hold the license."""
    spark = docs.sparkSession
    found = {name: w for name, text in (templates or TEMPLATES).items() if (w := words(text))}
    out = []
    known = anchors(found, SHINGLE, containment)
    low = F.lower(F.col(text_col))
    any_anchor = reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(w)) for w in known], F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), low.alias("low")).where(any_anchor)
    rows = rows.select("_id", F.xxhash64("low").alias("_tk"), F.regexp_extract_all("low", F.lit(WORDS), F.lit(0)).alias("w"))
    rows = stage(rows, "license-texts")  # read once for each class of templates
    by_size = lambda n: {k: w for k, w in found.items() if min(len(w), SHINGLE) == n}
    for n in sorted({min(len(w), SHINGLE) for w in found.values()}):
        same = by_size(n)
        for names in size_classes({k: len(w) for k, w in same.items()}):
            least, most = min(len(same[k]) for k in names), max(len(same[k]) for k in names)
            step = max(1, most // 4)
            width = most + step - 1 + most // 5  # room for words put in
            inside = containment * max(1, least - n + 1)
            j = inside / (max(width - n + 1, 1) + max(1, least - n + 1) - inside)
            bands, band_rows = bands_for(j, probability), 1
            own = F.array(*[F.lit(a) for a in known])
            starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)) + (step - 1), F.lit(step))
            starts = F.filter(starts, lambda s: F.arrays_overlap(F.slice("w", s + 1, width), own))  # noqa: B023
            windows = rows.where(F.size("w") > 0).select("_id", "_tk", F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, width).alias("w")))).alias("x"))  # noqa: B023
            windows = windows.select("_id", "_tk", F.col("x.at").alias("at"), _shingled(F.col("x.w"), n).alias("s"))
            keyed = windows.select("*", F.explode(_bands(F.col("s"), bands, band_rows)).alias("band"))
            forms = spark.createDataFrame([(k, word_shingles(same[k], n)) for k in names], "license string, t array<string>")
            posted = forms.select("*", F.explode(_bands(F.col("t"), bands, band_rows)).alias("band"))
            if sum(len(same[k]) for k in names) <= BROADCAST_WORDS:
                posted = F.broadcast(posted)
            hits = keyed.join(posted, "band").select("_id", "_tk", "at", "license", (F.size(F.array_intersect("s", "t")) / F.size("t")).alias("c"))
            out.append(hits.where(F.col("c") >= containment).groupBy("_id", "_tk", "at", "license").agg(F.max("c").alias("c")))
    if not out:
        return docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("at_word"), F.lit(0).cast("long").alias("windows")).where("false")
    hits = reduce(DataFrame.union, out).groupBy("_id", "_tk", "license").agg(F.max(F.struct("c", (-F.col("at")).alias("at"))).alias("b"), F.count("*").alias("windows"))
    return hits.select(F.col("_id").alias(id_col), "license", F.col("b.c").alias("containment"), (-F.col("b.at")).alias("at_word"), "windows")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
