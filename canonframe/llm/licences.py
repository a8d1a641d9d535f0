"""Operator 2, licence scans.

Every line of every whole text (a licence file is many lines, a header may stand anywhere) is a sparse TF-IDF vector and
is compared by cosine with the templates.  Words weigh by their rarity among the corpus' lines; only the templates' words
need counts, so what is broadcast is bounded by the templates, and a word no template has weighs as the rarest does.  A
line is scored whole; one without a telling template word cannot reach the threshold and is passed over unscored.

Files without a licence of their own inherit that of the nearest ancestor directory with a licence file: every path is
joined with the licensed directories on each of its ancestors, and the deepest one is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, plain_words, slices

THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"

# Usual short notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


class Templates:
    """Template vectors and word weights for given line counts."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n_lines: int, counts: dict[bytes, int], threshold: float = THRESHOLD):
        words = {w for notices in templates.values() for t in notices for w in plain_words(t)}
        self.weight = {w: math.log((n_lines + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}
        self.unknown = math.log(n_lines + 1) + 1
        self.postings: dict[bytes, list[tuple[int, float]]] = {w: [] for w in words}
        self.names: list[str] = []
        for name, notices in sorted(templates.items()):
            for notice in notices:
                vector = {w: n * self.weight[w] for w, n in Counter(plain_words(notice)).items()}
                norm = math.sqrt(sum(x * x for x in vector.values()))
                for w, x in vector.items():
                    self.postings[w].append((len(self.names), x / norm))
                self.names.append(name)
        self.telling = self._telling(threshold)

    def _telling(self, threshold: float) -> frozenset[bytes]:
        """Words of which a line above the threshold has at least one (Cauchy-Schwarz on the rest of each template)."""
        out = set()
        for t in range(len(self.names)):
            mine = sorted(((x, w) for w, p in self.postings.items() for n, x in p if n == t), reverse=True)
            left = 1.0
            for x, w in mine:
                out.add(w)
                left -= x * x
                if left < threshold ** 2:
                    break
        return frozenset(out)

    def best(self, words: list[bytes]) -> tuple[float, str | None]:
        """The greatest cosine and its licence; equal ones go to the licence first by name."""
        square, scores = 0.0, [0.0] * len(self.names)
        for w, n in Counter(words).items():
            x = n * self.weight.get(w, self.unknown)
            square += x * x
            for t, y in self.postings.get(w, ()):
                scores[t] += x * y
        if not square:
            return 0.0, None
        top = max(range(len(scores)), key=lambda t: (round(scores[t], 12), -t))
        return min(1.0, scores[top] / math.sqrt(square)), self.names[top]


def line_counts(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[int, dict[bytes, int]]:
    """How many lines there are, and in how many of them each template word occurs."""
    words = frozenset(w for notices in templates.values() for t in notices for w in plain_words(t))

    def run(batches: Iterator[pa.RecordBatch]):
        lines, tally = 0, Counter()
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                for line in (t or "").split("\n"):
                    lines += 1
                    tally.update(words.intersection(plain_words(line)))
        tally[b""] = lines
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
    rows = files.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()      # one row per template word
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, file_id, licence, score): the best line of each file; null and zero when none reaches the threshold."""
    files = files.select("file_id", "path", F.col("text").cast("string").alias("text"))
    n_lines, counts = line_counts(files, templates)
    shared = files.sparkSession.sparkContext.broadcast(Templates(templates, n_lines, counts, threshold))

    def run(batches: Iterator[pa.RecordBatch]):
        t = shared.value
        for b in slices(batches):
            names, scores = [], []
            for text in b.column("text").to_pylist():
                found = (0.0, None)
                for line in (text or "").split("\n"):
                    words = plain_words(line)
                    if not t.telling.isdisjoint(words):
                        score, name = t.best(words)
                        if score >= threshold and (-score, name) < (-found[0], found[1] or ""):
                            found = (score, name)
                names.append(found[1])
                scores.append(found[0])
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["file_id", "path", "licence", "score"])
    return files.mapInArrow(run, "file_id bigint, path string, licence string, score double")


def ancestors(path: str) -> Column:
    """All directories above a path, nearest first, ending in the root ``''``; null paths have none."""
    parts = F.split(F.col(path), "/")
    depth = F.size(parts)
    return F.transform(F.sequence(depth - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, licence, score, origin, directory) per row of ``files`` (file_id, path, text).

    ``origin`` is ``own`` (a line of the file), ``inherited`` (with the directory it comes from) or ``none``.  Of several
    licence files in a directory the best score counts, then the licence first by name.  Null and empty texts have no
    licence of their own; null paths inherit nothing; repeated rows stay.  Only distinct directories are joined, so a
    directory with most of the files is one row of the join, not a hot key.
    """
    own = cut_lineage(own_licences(files, templates, threshold)
                      .withColumn("parent", F.regexp_replace(F.col("path"), "/?[^/]*$", "")))
    licensed = (own.where(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
                .groupBy(F.col("parent").alias("directory"))
                .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
                .select("directory", F.col("best.licence").alias("inherited")))
    folders = own.where("licence is null and parent is not null").select("parent").distinct()
    above = (folders.select("parent", F.posexplode(F.concat(F.array("parent"), F.when(F.col("parent") == "", F.array().cast("array<string>"))
                                                            .otherwise(ancestors("parent")))).alias("distance", "directory")))
    nearest = (above.join(licensed, "directory").groupBy("parent")
               .agg(F.min(F.struct("distance", "directory", "inherited")).alias("n"))
               .select("parent", F.col("n.directory").alias("directory"), F.col("n.inherited").alias("inherited")))
    out = own.join(nearest, "parent", "left")
    alone = F.col("licence").isNotNull()
    return out.select("file_id", "path", F.coalesce("licence", "inherited").alias("licence"), "score",
                      F.when(alone, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(~alone, F.col("directory")).alias("directory"))
