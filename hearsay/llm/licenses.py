"""License scans: TF-IDF cosine of notices to templates, then inheritance down directories.

A file is a path and a text. Its blocks (lines and HTML elements, and paragraphs of
joined lines) are compared with license templates as sparse TF-IDF vectors; the best
block above the threshold whose deciding terms agree (name, version, NC, SA, ND)
declares the file's license. A licence file is one named LICENSE, LICENCE, COPYING
or NOTICE, or the index page of a directory (its path ends in a slash); what it
declares holds for its directory. A file that declares nothing takes the license
of the nearest directory above it that has one, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import spread_join
from ..session import cut

# Customary wording of the notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
            'to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   'with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                "later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
THRESHOLD = 0.7

_WORD = re.compile(r"[a-z0-9]+")
_BREAK = re.compile(r"(?:<[^>]*>|\n)+")
_PARAGRAPH = re.compile(
    r"\n[^\w\n<>]*\n|</?(?:p|div|li|h[1-6]|td|th|tr|br|pre|section|article|header|footer|ul|ol|table|html|body|nav|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_DENIED = re.compile(r"\b(?:not|never)\b[^.\n]{0,40}\blicensed\b|\bno licen[sc]e\b", re.I)
_LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks_of(text: str) -> Iterator[str]:
    """Lines and elements, then paragraphs that join several of them."""
    yield from _BREAK.split(text)
    for paragraph in _PARAGRAPH.split(text):
        if "\n" in paragraph.strip() or "<" in paragraph:
            yield _TAG.sub(" ", paragraph)


def agrees(name: str, w: set[str]) -> bool:
    """Whether the words of a block hold the terms that decide for a license and none that decide against it."""
    named = not w.isdisjoint(("license", "licence", "licensed", "licences", "licenses"))
    if name == "MIT":
        return "mit" in w and named or {"permission", "granted", "charge", "sublicense"} <= w
    if name == "Apache-2.0":
        return named and {"apache", "2"} <= w
    if name == "BSD-3-Clause":
        return {"redistribution", "source", "binary"} <= w or named and {"bsd", "3"} <= w
    if name == "GPL-3.0":
        gpl = "gpl" in w or {"gnu", "general", "public"} <= w
        return gpl and "3" in w and w.isdisjoint(("lesser", "affero", "library"))
    if name == "MPL-2.0":
        return not w.isdisjoint(("mozilla", "mpl")) and "2" in w
    if name in ("CC-BY-4.0", "CC-BY-NC-4.0"):
        by = {"cc", "by"} <= w or {"creative", "commons", "attribution"} <= w
        free = w.isdisjoint(("sa", "nd", "sharealike", "noderivatives", "noderivs"))
        paid = not w.isdisjoint(("nc", "noncommercial")) or {"non", "commercial"} <= w
        return by and free and "4" in w and paid == (name == "CC-BY-NC-4.0")
    return True


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text in templates for w in words_of(text)})


def term_weights(files: DataFrame, terms: list[str]) -> dict[str, float]:
    """Smoothed inverse document frequency of the templates' terms over all files; '' stands for any other term.

    Only the templates' own terms are counted, so what comes back is as large as the vocabulary.
    """
    known = F.array(*[F.lit(t) for t in terms])
    found = F.array_intersect(F.split(F.lower(F.coalesce("_text", F.lit(""))), "[^a-z0-9]+"), known)
    counts = {r["t"]: r["n"] for r in files.select(F.explode(found).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    weigh = lambda df: math.log((1 + n) / (1 + df)) + 1.0
    return {t: weigh(counts.get(t, 0)) for t in terms} | {"": weigh(0)}


class Matcher:
    """text -> (license, cosine) of its best block."""

    def __init__(self, weights: dict[str, float], templates=TEMPLATES):
        self.weights, self.other = weights, weights[""]
        self.known = frozenset(weights) - {""}
        self.names = {name for name, _ in templates}
        self.templates = []
        for name, text in templates:
            vector = {w: c * weights[w] for w, c in Counter(words_of(text)).items()}
            length = math.sqrt(sum(v * v for v in vector.values()))
            self.templates.append((name, {w: v / length for w, v in vector.items()}))

    def cosines(self, block: str) -> list[tuple[float, str]]:
        counts = Counter(words_of(block))
        if self.known.isdisjoint(counts):
            return []
        held = set(counts)
        names = {name for name in self.names if agrees(name, held)}
        if not names or _DENIED.search(block):
            return []
        vector = {w: c * self.weights.get(w, self.other) for w, c in counts.items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        return [(sum(vector.get(w, 0.0) * v for w, v in t.items()) / length, name) for name, t in self.templates if name in names] if length else []

    def best(self, text: str, threshold: float) -> tuple[str | None, float | None]:
        top: tuple[float, str] | None = None
        for block in blocks_of(text):
            for score, name in self.cosines(block):
                if score >= threshold and (top is None or (-score, name) < (-top[0], top[1])):
                    top = (score, name)
        return (top[1], top[0]) if top else (None, None)


def directories(path: Column) -> Column:
    """All directories above a path, the nearest last: 'a/b/c' -> ['a', 'a/b']; 'a/b/' lies in itself."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/+")
    depth = F.size(parts) - F.when(path.endswith("/"), 0).otherwise(1)
    return F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(
    files: DataFrame, id: str = "page_id", path: str = "path", text: str = "text",
    templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: id, path, license, similarity, basis ('own', 'inherited' or null) and license_dir.

    A null or empty text declares nothing and may inherit; a row of a null path stands
    outside all directories. Of several licence files of a directory the most similar
    counts, then the license first by name. Repeated rows come out repeated.
    """
    rows = files.select(
        F.col(id).cast("bigint").alias("_id"), F.col(path).cast("string").alias("_path"), F.col(text).cast("string").alias("_text"))
    shared = files.sparkSession.sparkContext.broadcast((term_weights(rows, vocabulary(templates)), templates))

    schema = pa.schema([("_id", pa.int64()), ("_path", pa.string()), ("own", pa.string()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            found = [matcher.best(t, threshold) if t else (None, None) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_path").cast(pa.string()),
                 pa.array([name for name, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema=schema)

    scanned = rows.mapInArrow(run, "_id bigint, _path string, own string, similarity double")
    above = directories(F.col("_path"))
    scanned = cut(scanned.withColumn("_dirs", F.when(F.col("_path").isNotNull(), above)).withColumn(
        "_dir", F.element_at("_dirs", -1)))
    declared = (
        scanned.where(F.col("own").isNotNull() & (F.col("_path").endswith("/") | F.col("_path").rlike(_LICENSE_FILE)))
        .groupBy(F.col("_dir").alias("_holder"))
        .agg(F.min_by("own", F.struct(-F.col("similarity"), F.col("own"))).alias("_license"))
    )
    # Directories, not files, climb: one row per directory and level.
    counts = cut(scanned.where("_dir is not null").groupBy("_dir").agg(F.count(F.lit(1)).alias("n"), F.first("_dirs").alias("_dirs")))
    climbing = counts.select("_dir", F.posexplode("_dirs").alias("_level", "_holder"))
    reach = cut(climbing.groupBy("_holder").agg(F.count(F.lit(1)).alias("n")))
    met = spread_join(climbing, declared, "_holder", F.xxhash64("_dir"), reach)
    nearest = met.groupBy("_dir").agg(F.max_by(F.struct("_license", "_holder"), "_level").alias("_found"))
    given = cut(nearest.select("_dir", F.col("_found._license").alias("_license"), F.col("_found._holder").alias("_holder")))
    joined = spread_join(scanned.drop("_dirs"), given, "_dir", F.xxhash64("_id", "_path"), counts.select("_dir", "n"), how="left")
    own = F.col("own").isNotNull()
    return joined.select(
        F.col("_id").alias(id), F.col("_path").alias("path"), F.coalesce("own", "_license").alias("license"), "similarity",
        F.when(own, "own").when(F.col("_license").isNotNull(), "inherited").alias("basis"),
        F.when(~own, F.col("_holder")).alias("license_dir"),
    )


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
