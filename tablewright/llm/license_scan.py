"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of a file, and every block of neighbouring lines that use template words, is a sparse vector; its cosine to
the vectors of a table of templates (short notices and headers of public licences) decides what the file declares.
Term weights come from the whole corpus: one pass counts in how many files each template word stands. The vocabulary is
that of the templates, so what travels is bounded by them and not by the corpus.

The nearest template is not reported if its terms contradict the text: the numbers of a template (versions, clauses) must
all stand in the text, of the words that tell the licences of a family apart (``VARIANTS``) the text must have the
template's and no others, and a statement that something is *not* licensed is none. What tells two licences of equal
wording apart elsewhere in the file is in ``ELSEWHERE``.

A file named like a licence file also declares for its directory. Files that declare nothing inherit from the nearest
ancestor directory that does. This is a join of directories with their own ancestors; every directory is joined once,
however many files it holds, and one of very many files is dealt out over several tasks. Where files have no names
(``named=False``), one declares for its directory if its statement makes up nearly all of its words (``WHOLLY``); if such
files of a directory declare different licences, which of them holds is not known, and nothing is handed down there.

Defined results: null and empty texts declare nothing; texts may be of any length; of equal scores the licence first in
the alphabet wins, of two licence files in a directory the better match, then the smaller path; a null path inherits
nothing; repeated rows are judged alike; an empty table gives an empty result; extra columns pass through, names of the
results (in any case) are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import skewed_join
from .common import checkpointed, extended, free_name, others, text_steps

#: Notices by SPDX identifier (fixed values: how these public licences are commonly stated).
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    "GPL-2.0-only": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation.",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.",
    ),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
}
#: Words that tell the licences of a family apart.
VARIANTS = frozenset(
    "lesser library affero sa nc nd sharealike noncommercial noderivatives noderivs later boost eclipse mozilla isc "
    "apache mit bsd".split()
)
#: Licences of equal wording: a word that must or must not stand elsewhere in the file.
ELSEWHERE = {"BSD-3-Clause": ("endorse", True), "BSD-2-Clause": ("endorse", False)}
#: A licence that is denied.
DENIED = re.compile(
    r"\b(?:not|never|no longer|nor|isn't|aren't|isn’t|aren’t)\s+(?:\w+\s+)?(?:licen[cs]ed|released|distributed|available|covered)\b",
    re.I,
)
#: Words of the templates too common to be evidence; they count for a vector's length only.
COMMON = frozenset("a an and are as at be by can either for in is it may not of on or the this to with you under".split())
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LICENSE_FILE = re.compile(r"(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$", re.I)
#: The least cosine that counts.
LEAST = 0.6
#: The share of a file's words that its statement makes up at least if the file, without a name, is a licence file.
WHOLLY = 0.8


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


def numbers(words) -> frozenset[str]:
    """Versions and counts, 2.0 being 2."""
    return frozenset(re.sub(r"(?:\.0)+$", "", w) for w in words if w[0].isdigit())


VOCABULARY = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms(x)) - COMMON


class Model:
    """Weights from document frequencies over ``n`` files, and the templates' unit vectors."""

    def __init__(self, frequency: dict[str, int], n: int):
        self.idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for t in VOCABULARY}
        self.rest = math.log(1 + n) + 1  # of words that no template has
        self.templates = []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                vector, norm = self.vector(terms(text))
                words = frozenset(terms(text))
                unit = {t: w / norm for t, w in vector.items()}
                self.templates.append((name, unit, numbers(words), words & VARIANTS))

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        counts = Counter(words)
        known = {t: k * self.idf[t] for t, k in counts.items() if t in self.idf}
        others = sum(k * k for t, k in counts.items() if t not in self.idf and t not in COMMON)
        return known, math.sqrt(sum(w * w for w in known.values()) + others * self.rest**2)

    def best(self, words: list[str], whole: frozenset[str] = frozenset()) -> tuple[float, str] | None:
        """The highest cosine among the templates that the words do not contradict, and its licence; ``whole`` are the
        words of the whole file."""
        vector, norm = self.vector(words)
        if not vector:
            return None
        own, has, variants, scores = frozenset(words), None, None, []
        for name, unit, wanted, family in self.templates:
            score = sum(w * unit[t] for t, w in vector.items() if t in unit) / norm
            if score < LEAST:
                continue
            if has is None:
                has, variants = numbers(own), own & VARIANTS
            if not wanted <= has or not family <= variants or (variants - family and not self.harmless(variants - family, name)):
                continue
            if name in ELSEWHERE and not wanted and (ELSEWHERE[name][0] in whole) != ELSEWHERE[name][1]:
                continue
            scores.append((score, name))
        return min(scores, key=lambda s: (-round(s[0], 9), s[1])) if scores else None

    @staticmethod
    def harmless(more: frozenset[str], name: str) -> bool:
        """Whether the words that a text has beyond the template's fit its licence all the same."""
        return more <= {"later", "library"} and not name.startswith("GPL-2.0-only") or more <= {w.lower() for w in name.split("-")}

    def scan(self, text: str | None) -> tuple[str | None, float | None]:
        """The licence that a text declares, and its score."""
        return self.statement(text)[:2]

    def statement(self, text: str | None) -> tuple[str | None, float | None, float]:
        """The licence that a text declares, its score, and the share of the text's words that state it."""
        raw = [line for line in (text or "").split("\n") if TERM.search(line.lower())]
        lines = [terms(line) for line in raw]
        hit = [any(t in VOCABULARY for t in words) for words in lines]
        if not any(hit):
            return None, None, 0.0
        whole = frozenset(t for words in lines for t in words)
        best, said_in, at = None, 0, 0
        while at < len(lines):
            if not hit[at]:
                at += 1
                continue
            end = at
            while end < len(lines) and hit[end]:
                end += 1
            units = [(raw[i], lines[i]) for i in range(at, end)]
            if len(units) > 1:
                units.append((" ".join(raw[at:end]), [t for words in lines[at:end] for t in words]))
            for said, words in units:
                found = self.best(words, whole)
                if found and not DENIED.search(said) and (best is None or (-found[0], found[1]) < (-best[0], best[1])):
                    best, said_in = found, len(words)
            at = end
        return (best[1], round(best[0], 6), said_in / sum(map(len, lines))) if best else (None, None, 0.0)


def corpus_model(files: DataFrame, text: str = "text") -> Model:
    """Document frequencies of the template words over all files; at most one row for each of them comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                if text := x.as_py():
                    counts.update(VOCABULARY.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
        )

    counted = files.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "term string, n long")
    frequency = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return Model(frequency, files.count())


def declared(
    files: DataFrame, model: Model, path: str = "path", text: str = "text", named: bool = True
) -> DataFrame:
    """files without their texts, with ``license``, ``score`` and ``is_license_file``: by its name, or if the paths do
    not name files, by what it holds."""
    new = ("license", "score", "is_license_file")
    names = others(files, text, *new)
    columns = [F.col(f"`{c}`") for c in names]
    schema = extended(files.select(*columns), ("license", "string"), ("score", "double"), ("is_license_file", "boolean"))
    at_path = names.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, len(names)):
                found = [model.statement(t) for t in part.column(len(names)).to_pylist()]
                if named:
                    files_of = [bool(p and LICENSE_FILE.search(p)) for p in part.column(at_path).to_pylist()]
                else:
                    files_of = [share >= WHOLLY for _, _, share in found]
                more = [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] is not None and n for f, n in zip(found, files_of)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*names, *new])

    return files.select(*columns, F.col(f"`{text}`").alias(free_name(files, "__text"))).mapInArrow(run, schema)


def inherit(found: DataFrame, path: str = "path", named: bool = True) -> DataFrame:
    """Adds ``inherited_license`` and ``inherited_from`` (a directory, "" being the root) to rows of ``declared``."""
    own = others(found, "inherited_license", "inherited_from")
    own_path = F.col(f"`{path}`")
    folder = F.when(own_path.contains("/"), F.regexp_replace(own_path, "/[^/]*$", "")).otherwise(
        F.when(own_path.isNotNull(), F.lit(""))
    )
    # the caller's columns stand in a struct: whatever their names, they meet none of those used here
    rows = found.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("kept"), folder.alias("dir"))
    # hashed apart first: of a directory with very many files only a few rows come together
    better = F.struct((-F.col("kept.score")).alias("s"), F.col("kept")[path].alias("p"), F.col("kept.license").alias("license"))
    agree = F.lit(True) if named else F.min("kept.license") == F.max("kept.license")
    owners = rows.where("kept.is_license_file").groupBy("dir").agg(F.min(better).alias("o"), agree.alias("agree")).select(
        F.col("dir").alias("owner"), F.when(F.col("agree"), F.col("o.license")).alias("inherited_license")
    )
    folders = checkpointed(rows.where("dir IS NOT NULL").groupBy("dir").count())
    steps = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(F.split("dir", "/"))))
    ancestors = folders.select("dir", F.explode(steps).alias("depth")).withColumn(
        "owner", F.expr("substring_index(dir, '/', depth)")
    )
    nearest = ancestors.join(owners, "owner").groupBy("dir").agg(
        F.max_by(F.struct("inherited_license", F.col("owner").alias("inherited_from")), "depth").alias("n")
    ).where("n.inherited_license IS NOT NULL")
    return skewed_join(rows, nearest, ["dir"], "left", folders).select("kept.*", "n.inherited_license", "n.inherited_from")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", named: bool = True) -> DataFrame:
    """What every file declares and inherits; ``effective_license`` is its own, else the inherited one. ``named`` says
    whether the last part of a path is the name of a file, which can tell a licence file."""
    out = inherit(checkpointed(declared(files, corpus_model(files, text), path, text, named)), path, named)
    return out.withColumn("effective_license", F.coalesce("license", "inherited_license"))
