"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is a sequence of words, wherever its lines end. Every run of as many consecutive words as a template has (the whole
text, where it is shorter) is compared with that template: both are vectors of word counts times inverse document frequency,
where the frequencies of the templates' words (a bounded list) are counted over all files and any other word weighs as one
that occurs once. The best cosine of ``least`` or more is the file's own licence.

Nothing is compared in vain, and nothing that could reach ``least`` is left out: a run's cosine with a template is at most the
share of the template's norm that its words carry (Cauchy-Schwarz). So a text whose words carry less has no such run, and a
run that has none of a template's heaviest words, chosen so that the others carry less than ``least``, isn't one either.

A licence file (by its name) with a licence names it for its directory; a file without one takes the licence of the nearest
directory on its path that has one. Directories are resolved once each, by equality joins of their ancestors' paths with the
licensed directories.

Null and empty texts hold no licence. A text of any length is scanned whole. Of equal best scores, to six digits, the first
name in order counts. A null path has no directory, so nothing is inherited. Of a directory's licence files the one with the
best score counts, then the smallest path. Repeated rows each get their row; an empty table gives none. A column named in
``keep`` that is also one of the result's gives way to the result's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_schema, kept_columns, map_rows, slices, written

#: Public licence notices, titles and texts by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
LEAST = 0.8
#: Below what differences of cosines are rounding.
TINY = 1e-9
#: Words that a worker remembers; the memory starts again when it is full, which costs time and changes nothing.
MOST_KNOWN = 400_000

OWN = "path string, own_license string, own_score double"


def tokens(text: str) -> list[str]:
    """The lower-cased words; none crosses white space."""
    return TOKEN.findall(text.lower())


def vocabulary(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in tokens(t)})


class Sieve:
    """Which of a bounded list of words a text has, looking at each distinct run without white space once."""

    def __init__(self, words: list[str]):
        self.known = {w: i for i, w in enumerate(words)}
        self.empty: set[str] = set()
        self.held: dict[str, frozenset[int]] = {}

    def of(self, text: str) -> set[int]:
        runs = set(text.lower().split())
        runs -= self.empty
        found: set[int] = set()
        for run in runs:
            own = self.held.get(run)
            if own is None:
                own = frozenset(self.known[w] for w in TOKEN.findall(run) if w in self.known)
                if len(self.empty) + len(self.held) >= MOST_KNOWN:
                    self.empty.clear()
                    self.held.clear()
                if own:
                    self.held[run] = own
                else:
                    self.empty.add(run)
            found |= own
        return found


def document_frequencies(files: DataFrame, words: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each of ``words``, over all files; a row of counts leaves each task."""
    schema = arrow_schema("word int, n long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        sieve = Sieve(words)
        for batch in slices(batches, "text"):
            for one in batch.column(0).to_pylist():
                seen[-1] += 1
                if one:
                    seen.update(sieve.of(one))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    got = {r["word"]: r["n"] for r in map_rows(files.select(F.col(text).cast("string").alias("text")), "word int, n long", counted).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), {w: got.get(i, 0) for i, w in enumerate(words)}


class Matcher:
    """Templates as vectors, and a text's runs of words compared with them."""

    def __init__(self, n_files: int, frequencies: dict[str, int], templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.n, self.least = max(1, n_files), least
        self.idf = {w: math.log((1 + self.n) / (1 + n)) + 1 for w, n in frequencies.items()}
        self.other = math.log((1 + self.n) / 2) + 1
        self.words = vocabulary(templates)
        number = {w: i for i, w in enumerate(self.words)}
        self.templates = []
        for name, t in templates:
            counts = Counter(tokens(t))
            vector = {w: n * self.weight(w) for w, n in counts.items()}
            whole = sum(x * x for x in vector.values())
            # The heaviest words, until those left carry too little of the norm for any run without the others.
            heavy, left = set(), whole
            for w in sorted(vector, key=lambda w: (-self.weight(w), w)):
                if left < (least * least - TINY) * whole:
                    break
                heavy.add(w)
                left -= vector[w] ** 2
            share = {number[w]: x * x / whole for w, x in vector.items()}
            self.templates.append((name, vector, math.sqrt(whole), sum(counts.values()), heavy, share))

    def weight(self, word: str) -> float:
        return self.idf.get(word, self.other)

    def cosine(self, words: list[str], vector: dict[str, float], length: float) -> float:
        own = {w: n * self.weight(w) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in own.values()))
        return sum(x * vector[w] for w, x in own.items() if w in vector) / (size * length) if size else 0.0

    def possible(self, present: set[int]) -> list[tuple]:
        """The templates that a text with these words of the vocabulary can match."""
        need = self.least * self.least - TINY
        return [t for t in self.templates if sum(x for w, x in t[5].items() if w in present) >= need]

    def best_run(self, words: list[str], vector: dict[str, float], length: float, n: int, heavy: set[str]) -> float:
        """The best cosine of the runs of ``n`` words that have a heavy one; sums move along with the run."""
        n = min(n, len(words))
        best, until = 0.0, 0
        hits = [i for i, w in enumerate(words) if w in heavy]
        weight = {w: self.weight(w) for w in set(words)}
        at = 0
        while at < len(hits):
            # Runs that begin in [first, last] hold some hit of a chain of near ones.
            first = max(0, hits[at] - n + 1, until)
            last = hits[at]
            while at + 1 < len(hits) and hits[at + 1] - n + 1 <= last + 1:
                at += 1
                last = hits[at]
            last = min(last, len(words) - n)
            at += 1
            if first > last:
                continue
            until = last + 1
            counts = Counter(words[first : first + n])
            norm = sum((c * weight[w]) ** 2 for w, c in counts.items())
            dot = sum(c * weight[w] * vector[w] for w, c in counts.items() if w in vector)
            for start in range(first, last + 1):
                if start > first:
                    gone, new = words[start - 1], words[start + n - 1]
                    if gone != new:
                        c = counts[gone]
                        norm -= (2 * c - 1) * weight[gone] ** 2
                        counts[gone] = c - 1
                        dot -= weight[gone] * vector.get(gone, 0.0)
                        c = counts[new]
                        norm += (2 * c + 1) * weight[new] ** 2
                        counts[new] = c + 1
                        dot += weight[new] * vector.get(new, 0.0)
                near = dot / (math.sqrt(norm) * length) if norm > 0 else 0.0
                if near > best + TINY and near >= self.least - 1e-6:
                    best = max(best, self.cosine(words[start : start + n], vector, length))
        return best

    def scan(self, text: str, present: set[int] | None = None) -> tuple[str | None, float]:
        """The best licence of the text's runs, if its cosine is ``least`` or more."""
        possible = self.possible(Sieve(self.words).of(text) if present is None else present)
        if not possible:
            return None, 0.0
        words = tokens(text)
        found: tuple[float, str] | None = None
        for name, vector, length, n, heavy, _ in possible:
            score = self.best_run(words, vector, length, n, heavy)
            if score >= self.least and (found is None or (-round(score, 6), name) < found):
                found = (-round(score, 6), name)
        return (found[1], -found[0]) if found else (None, 0.0)


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def own_licences(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), least: float = LEAST, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Rows ``(keep..., path, own_license, own_score)`` for every file, over its whole text."""
    n, frequencies = document_frequencies(files, vocabulary(templates), text)
    matcher = Matcher(n, frequencies, templates, least)
    keep = kept_columns(keep, ("path", "own_license", "own_score", "license", "license_from", "levels"))
    kept = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    ddl = f"{kept}{OWN}"
    schema = arrow_schema(ddl)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(matcher.words)
        for batch in slices(batches, "__quire_text"):
            found = [matcher.scan(x, sieve.of(x)) if x else (None, 0.0) for x in batch.column(len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=schema)

    return map_rows(files.select(*keep, F.col(path).cast("string").alias("__quire_path"), F.col(text).cast("string").alias("__quire_text")), ddl, scanned)


def inherited(own: DataFrame) -> DataFrame:
    """``own`` with ``license`` (own, or the nearest ancestor directory's), ``license_from`` (that directory) and ``levels`` up.

    What is joined to files and to chains of directories is written first, so that adaptive execution can split the files of
    one huge directory: an aggregate in the join's own stage would forbid that.
    """
    table, _ = written(own.withColumn("__quire_dir", directory(F.col("path"))), "licences")
    name = F.regexp_extract("path", "[^/]*$", 0)
    named = table.where(name.rlike(LICENCE_FILE) & F.col("own_license").isNotNull() & F.col("__quire_dir").isNotNull())
    licensed = named.groupBy(F.col("__quire_dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("best")).select("above", F.col("best.own_license").alias("given"))
    licensed, _ = written(licensed, "licensed")
    dirs = table.where("__quire_dir is not null").select("__quire_dir").distinct()
    parts = F.split("__quire_dir", "/")
    chain = dirs.select("__quire_dir", F.explode(F.when(F.col("__quire_dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    chain = chain.select("__quire_dir", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("__quire_dir", "/"), 1, F.greatest("depth", F.lit(1))), "/")).alias("above"))
    nearest = chain.join(licensed, "above").groupBy("__quire_dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    size = F.when(F.col("__quire_dir") == "", 0).otherwise(F.size(F.split("__quire_dir", "/")))
    nearest, _ = written(nearest.select(F.col("__quire_dir"), F.col("near.given").alias("given"), F.col("near.above").alias("above"), (size - F.col("near.depth")).cast("int").alias("up")), "nearest")
    return table.join(nearest, "__quire_dir", "left").select(
        *own.columns,
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("license_from"),
        F.when(F.col("own_license").isNull(), F.col("up")).alias("levels"),
    )


def licence_scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), least: float = LEAST) -> DataFrame:
    """Every file's own and effective licence."""
    return inherited(own_licences(files, path, text, keep, least))
