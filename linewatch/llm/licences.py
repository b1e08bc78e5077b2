"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of every file (notices may stand anywhere, so whole texts are read), every sentence in
a line, and windows of several lines near a line with distinctive words are compared with notices, titles and
standard headers; files named like a licence file are also compared as a whole with these and with
full licence texts (``licence_texts``). A tag SPDX-License-Identifier gives the first known licence it names. Vectors
have a binary term frequency and the inverse document frequency over all files, of all words.
A file's licence is its best match at ``LEAST`` or more: a named licence before a reservation of all rights (which
stands above many a BSD or Apache notice), then a match of the whole file before one of some lines, then the higher score. A line, sentence or
window that holds a word of denial which the notice lacks ("not licensed under ...") does not match it.
A file without a licence inherits from the
nearest directory above it whose licence file has one: directories are joined by path, and the deepest wins.

Built-in functions only. Lines that lack every distinctive word of the short templates are passed
over; that is proven per run: words count as common only while a unit of common words alone
stays below ``LEAST`` for each short template. Windows start up to two lines before a distinctive line.
Equal word sets are scored once, in two steps. First with the weights of template words and of the ``FREQUENT`` most frequent words, which are
broadcast: every other word weighs at least as much as the rarest of these, so that gives a score no set exceeds, and sets
below ``LEAST`` for all templates are done. Those left get the true weights of all their words, joined by word.

Nulls and odd rows: null and empty texts have no licence of their own; null paths
inherit nothing; rows that repeat a path are files of their own (told apart by a hash of path and text, so null and repeated
ids do no harm), and of several licence files in one
directory the best match counts, ties by licence name; other columns are passed on, those named like a result are replaced;
an empty table gives an empty result; very long lines are one line and its sentences.
"""

from __future__ import annotations

import math
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored

LEAST = 0.6
# Notices by which licences are named in files
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
#: Titles and usual headers, and a word a match must have: without it the rest says nothing of the licence.
HEADERS = [
    ("Apache-2.0", "apache", "Apache License, Version 2.0, January 2004"),
    ("Apache-2.0", "apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "mit", "MIT License"), ("MIT", "mit", "The MIT License (MIT)"), ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "mit", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."),
    *((name, must, _GNU.format(kind, version)) for name, must, kind, version in [
        ("GPL-2.0", "gnu", "General Public", "2"), ("GPL-3.0", "gnu", "General Public", "3"), ("LGPL-2.1", "lesser", "Lesser General Public", "2.1"),
        ("LGPL-3.0", "lesser", "Lesser General Public", "3"), ("AGPL-3.0", "affero", "Affero General Public", "3")]),
    ("GPL-2.0", "gnu", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "gnu", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "lesser", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "lesser", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "affero", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GPL-2.0", "gnu", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "lesser", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-4.0", "attribution", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "sharealike", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "noncommercial", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "cc0", "Creative Commons CC0 1.0 Universal"),
    ("MPL-2.0", "mozilla", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "bsd", "BSD 3-Clause License"),
]
#: First sentences of full texts, which often stand in files without their title.
OPENINGS = [
    ("MIT", "charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]
HEADERS += OPENINGS
#: Words that deny what follows.
DENIALS = ("not", "never", "neither", "isn", "aren", "wasn")
#: Words whose weights are broadcast for the first step.
FREQUENT = 2000
#: Lines of a window.
WINDOWS = (2, 3, 4, 6, 9, 12, 16)
LICENCE_FILE = r"(?i)^(un)?licen[sc]e([._-].*)?$|^copying([._-].*)?$|^copyright([._-].*)?$|^notice([._-].*)?$"
_SPLIT = r"[^a-z0-9]+"
_RESULT = ["own_licence", "own_score", "own_line", "licence", "inherited_from"]


def _words(text: str) -> list[str]:
    import re
    return sorted({w for w in re.split(_SPLIT, text.lower()) if w})


@cache
def _templates() -> list[tuple[str, str | None, frozenset[str]]]:
    """Licence, the word a match must have, and the words; full texts come last."""
    texts = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [*((name, None, frozenset(_words(t))) for name, t in TEMPLATES.items()), *((name, must, frozenset(_words(t))) for name, must, t in HEADERS),
            *((p.stem, None, frozenset(_words(p.read_text(encoding="utf-8")))) for p in texts)]


def _short() -> list[frozenset[str]]:
    return [words for _, _, words in _templates()[:len(TEMPLATES) + len(HEADERS)]]


def _tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _SPLIT)), lambda w: w != "")


def counted(files: DataFrame) -> DataFrame:
    """In how many files each word is: word, df."""
    return files.select(F.explode(_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def frequencies(files: DataFrame, counts: DataFrame | None = None) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each template word is."""
    known = sorted(frozenset().union(*(words for _, _, words in _templates())))
    spark = files.sparkSession
    counts = counted(files) if counts is None else counts
    found = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in known], "word string")), "word", "left_semi")
    found = {r["word"]: r["df"] for r in found.collect()}
    return files.count(), {w: found.get(w, 0) for w in known}


def _weights(n: int, seen: dict[str, int]) -> dict[str, float]:
    return {w: math.log((1 + n) / (1 + df)) + 1 for w, df in seen.items()}


def distinctive(weights: dict[str, float]) -> list[str]:
    """Words of short templates at least one of which a match must have."""
    short, common = _short(), set()
    known = frozenset().union(*short)
    norms = [sum(weights[w] ** 2 for w in t) for t in short]
    for word in sorted(known, key=lambda w: (weights[w], w)):
        more = common | {word}
        # a text with only these words in common has at most this squared cosine
        if all(sum(weights[w] ** 2 for w in t & more) < LEAST ** 2 * norm for t, norm in zip(short, norms, strict=True)):
            common = more
    return sorted(known - common)


def _tag(line: Column) -> Column:
    """The first known licence in an SPDX tag, or null."""
    listed = F.regexp_extract(line, r"(?i)spdx-license-identifier:\s*(.*)", 1)
    ids = F.transform(F.split(F.lower(listed), r"[^a-z0-9.-]+"), lambda c: F.regexp_replace(c, "-(only|or-later)$", ""))
    names = sorted({name for name, _, _ in _templates()} - {"Proprietary"})
    known = F.create_map(*[F.lit(x) for name in names for x in (name.lower(), name)])
    return F.get(F.filter(F.transform(ids, lambda c: F.try_element_at(known, c)), lambda c: c.isNotNull()), F.lit(0))


def _better(line: int | None = None) -> Column:
    """Matches in order, the best one least."""
    at = F.col("line") if line is None else F.lit(line)
    return F.struct((F.col("name") == "Proprietary").alias("reserved"), (at >= 0).alias("part"), (-F.col("score")).alias("score"), at.alias("line"), "name")


def matched(files: DataFrame, n: int, seen: dict[str, int], counts: DataFrame | None = None) -> DataFrame:
    """``files``: key, path, text; rows of one key are equal. Best match of each key that has one: key, own_licence, own_score,
    own_line (from 0, the first of a window; -1: the whole file)."""
    weights, templates = _weights(n, seen), _templates()
    spark = files.sparkSession
    counts = counted(files) if counts is None else counts
    rare = F.array(*map(F.lit, distinctive(weights)))
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.split("text", "\n")
    split = files.select("key", F.posexplode(lines).alias("line", "unit"))
    tags = split.where(F.lower("unit").contains("spdx-license-identifier")).select(
        "key", F.lit(1.0).alias("score"), "line", _tag(F.col("unit")).alias("name")).where("name is not null")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.arrays_overlap(_tokens(x), rare).alias("hit")))
    hits = F.transform(F.filter(numbered, lambda x: x["hit"]), lambda x: x["i"])
    near = files.select("key", "text", hits.alias("hits")).where(F.size("hits") > 0)
    each = near.select("key", F.explode("hits").alias("line"), lines.alias("lines"))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(*[F.greatest(i - k, F.lit(0)) for k in range(3)]))))
    singly = each.select("key", "line", F.explode(F.array_union(F.array(F.col("lines")[F.col("line")]), F.split(
        F.col("lines")[F.col("line")], r"(?<=[.!?;])\s+"))).alias("unit"))
    wide = near.select("key", F.explode(starts).alias("line"), lines.alias("lines")).select("key", "line", F.explode(F.array_distinct(F.array(*[
        F.array_join(F.slice("lines", F.col("line") + 1, w), " ") for w in WINDOWS]))).alias("unit"))
    whole = files.where(name.rlike(LICENCE_FILE)).select("key", F.lit(-1).alias("line"), F.col("text").alias("unit"))
    words = F.array_sort(_tokens(F.col("unit")))
    part = singly.unionByName(wide).select("key", "line", words.alias("words")).where(F.arrays_overlap("words", rare))
    units = part.unionByName(whole.select("key", "line", words.alias("words")).where(F.size("words") > 0))
    text = F.array_join("words", " ")
    units = stored(units.withColumn("set", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.reverse(text)).alias("b"))), "licence_units")
    sets = units.select("set", "words").dropDuplicates(["set"])
    denied = [any(d in t for d in DENIALS) for _, _, t in templates]
    vocabulary = spark.createDataFrame(
        [(w, [(k, w == must) for k, (_, must, t) in enumerate(templates) if w in t]) for w in sorted(seen)],
        "word string, parts array<struct<template:int,must:boolean>>")
    common = counts.orderBy(F.desc("df"), "word").limit(FREQUENT)
    rest = common.agg(F.min("df"), F.count("*")).first()
    square = F.pow(F.log((1.0 + n) / (1 + F.col("df"))) + 1, 2)
    # with fewer words in all than FREQUENT each one is known
    least = (math.log((1.0 + n) / (1 + rest[0])) + 1) ** 2 if rest[1] else 0.0
    known = stored(common.unionByName(counts.join(F.broadcast(vocabulary.select("word")), "word", "left_semi")).distinct()
                   .join(F.broadcast(vocabulary), "word", "left").select("word", square.alias("square"), "parts"), "licence_weights")
    itself = F.array(F.struct(F.lit(-1).alias("template"), F.lit(False).alias("must")))
    none = F.array().cast("array<struct<template:int,must:boolean>>")
    denies = F.arrays_overlap("words", F.array(*map(F.lit, DENIALS)))
    sums = stored(sets.select("set", denies.alias("denies"), F.explode("words").alias("word")).join(F.broadcast(known), "word", "left").select(
        "set", "denies", F.coalesce("square", F.lit(least)).alias("square"), F.explode(F.concat(itself, F.coalesce("parts", none))).alias("p"))
        .groupBy("set", F.col("p.template").alias("template")).agg(
            F.sum("square").alias("dot"), F.max("p.must").alias("must"), F.max("denies").alias("denies")), "licence_sums")
    norms = spark.createDataFrame([(k, name, must is not None, sum(weights[w] ** 2 for w in t), denied[k])
                                   for k, (name, must, t) in enumerate(templates)], "template int, name string, needs boolean, norm double, may boolean")
    atmost = sums.where("template = -1").select("set", F.col("dot").alias("least"))
    likely = stored(sums.join(F.broadcast(norms), "template").where("(must or not needs) and (may or not denies)").join(atmost, "set")
                    .where(F.col("dot") >= (LEAST - 1e-6) * F.sqrt("least") * F.sqrt("norm")).select("set", "name", "dot", "norm"), "licence_likely")
    words_of = sets.join(likely.select("set").distinct(), "set", "left_semi").select("set", F.explode("words").alias("word"))
    own = words_of.join(counts, "word").groupBy("set").agg(F.sum(square).alias("square"))
    scored = likely.join(own, "set").select(
        "set", "name", F.round(F.col("dot") / F.sqrt("square") / F.sqrt("norm"), 9).alias("score")).where(F.col("score") >= LEAST)
    tops = stored(scored.groupBy("set").agg(F.min(_better(-1)).alias("m")), "licence_sets")
    found = units.join(tops, "set").select("key", (-F.col("m.score")).alias("score"), "line", F.col("m.name").alias("name")).unionByName(tags)
    best = found.groupBy("key").agg(F.min(_better()).alias("m"))
    return best.select("key", F.col("m.name").alias("own_licence"), (-F.col("m.score")).alias("own_score"), F.col("m.line").alias("own_line"))


def scanned(files: DataFrame) -> DataFrame:
    """``files``: path, text and what else. Adds own_licence, own_score, own_line, licence
    and inherited_from (a directory; null if the licence is the file's own)."""
    key = F.struct(F.xxhash64("path", "text").alias("a"), F.xxhash64("text", "path").alias("b"))
    files = files.drop(*_RESULT).withColumn("_key", key)
    counts = stored(counted(files), "words")
    n, seen = frequencies(files, counts)
    own = stored(matched(files.select(F.col("_key").alias("key"), "path", "text"), n, seen, counts), "licences") \
        .withColumnRenamed("key", "_key")
    cut = F.regexp_replace("path", "/?[^/]*$", "")
    slim = files.drop("text").join(own, "_key", "left").drop("_key").withColumn("_dir", cut)
    slim = stored(slim, "files")
    givers = slim.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & F.col("own_licence").isNotNull()) \
        .groupBy(F.col("_dir").alias("_above")).agg(
            F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("name"))).alias("given")) \
        .select("_above", F.col("given.name").alias("given"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    steps = slim.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_above"))
    nearest = stored(steps.join(givers, "_above").groupBy("_dir").agg(
        F.max(F.struct(F.length("_above").alias("n"), "_above", "given")).alias("near")).select("_dir", "near"), "nearest")  # so that a hot directory's join can be split
    found = slim.join(nearest, "_dir", "left")
    return found.withColumn("licence", F.coalesce("own_licence", "near.given")).withColumn(
        "inherited_from", F.when(F.col("own_licence").isNull(), F.col("near._above"))).drop("_dir", "near")
