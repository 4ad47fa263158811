"""Operator 1: license scans. DataFrame functions only.

Texts and templates are words of letters and digits in lower case, and sets of five-word shingles. Templates fall into
classes of similar length; for each class a text is cut into windows that overlap so far that any passage as long as a
template of the class lies whole in one of them. MinHash bands (of one value each) of the windows meet those of the
templates in a join; the number of bands follows from the least Jaccard similarity of a template and a window that holds
enough of it, so that they collide with probability ``PROBABILITY`` at least. Matches are then verified: the share of the
template's shingles found in the window must be ``containment`` or more.

Only texts with an anchor word are cut into windows. Anchors are computed so that a window without any of a template's
anchors cannot reach the wanted containment, so this loses nothing.

Cases: null and empty texts match nothing; a null id is kept; rows that repeat an id give one row per license; a template
of fewer than five words is refused; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .common import public_columns

N = 5
CONTAINMENT = 0.8
PROBABILITY = 0.9999
#: Templates of a class differ in length by this factor at most.
CLASS_RATIO = 1.5

# Public license notices.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingle_set(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + N]) for k in range(len(words) - N + 1)}


def anchors(words: list[str], containment: float = CONTAINMENT) -> set[str]:
    """Words such that less than ``containment`` of the shingles have none of them; the most covering, long ones first."""
    left = shingle_set(words)
    allowed = math.ceil(containment * len(left)) - 1
    chosen: set[str] = set()
    while len(left) > allowed:
        cover = Counter(w for s in left for w in set(s.split()))
        word = max(cover, key=lambda w: (len(w) >= 6, cover[w], len(w), w))
        chosen.add(word)
        left = {s for s in left if word not in s.split()}
    return chosen


class Window:
    """Windows of a class of templates: ``length`` words every ``stride`` words, ``bands`` MinHash values."""

    def __init__(self, shortest: int, longest: int, containment: float, probability: float):
        self.stride = max(1, shortest // 4)
        self.length = longest + self.stride - 1
        inside = self.length - N + 1
        least = shortest - N + 1
        common = math.ceil(containment * least)
        jaccard = common / (inside + least - common)
        self.bands = math.ceil(math.log(1 - probability) / math.log(1 - jaccard)) if jaccard < 1 else 1


def window_classes(lengths: list[int], containment: float = CONTAINMENT, probability: float = PROBABILITY) -> dict[int, Window]:
    """A window for each class, by the shortest length of the class."""
    groups: dict[int, list[int]] = {}
    for n in sorted(set(lengths)):
        start = next((s for s in groups if n <= s * CLASS_RATIO), n)
        groups.setdefault(start, []).append(n)
    return {s: Window(s, max(g), containment, probability) for s, g in groups.items()}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """64-bit hashes of the shingles in order; none for fewer than five words."""
    at = F.sequence(F.lit(0), F.size(words) - N)
    # by element, as a slice reads its whole array
    hashed = F.transform(F.array(words), lambda w: F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(N)])))
    return F.when(F.size(words) >= N, F.flatten(hashed)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _window(at: Column, inside: int) -> Column:
    held = F.transform(F.sequence(F.lit(0), F.lit(inside - 1)), lambda k: F.get("shingles", at + k))
    return F.struct(at.alias("at"), F.filter(held, lambda h: h.isNotNull()).alias("held"))


def _minhashes(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, probability: float = PROBABILITY,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): the best window of each license in a document."""
    spark = docs.sparkSession
    split = {name: words_of(t) for name, t in templates.items()}
    if short := [name for name, w in split.items() if len(w) < N]:
        raise ValueError(f"templates of fewer than {N} words: {short}")
    classes = window_classes([len(w) for w in split.values()], containment, probability)
    of_class = lambda n: max(s for s in classes if s <= n)
    known = _templates(spark, split)
    marks = sorted(set().union(*(anchors(w, containment) for w in split.values())))
    rows = public_columns(docs, doc_id=doc_id, text=text).filter(F.col("text").rlike(r"(?i)(?<![a-z0-9])(?:" + "|".join(marks) + r")(?![a-z0-9])"))
    rows = rows.select("doc_id", _shingles(_words(F.col("text"))).alias("shingles")).filter(F.size("shingles") > 0)
    found = []
    for start, w in classes.items():
        names = [name for name, words in split.items() if of_class(len(words)) == start]
        bands = known.filter(F.col("license").isin(names)).select("license", "wanted", F.posexplode(_minhashes(F.col("wanted"), w.bands)).alias("band", "value"))
        inside = w.length - N + 1
        starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - inside + w.stride - 1, F.lit(0)), F.lit(w.stride))
        windows = rows.select("doc_id", F.explode(F.transform(starts, lambda i: _window(i, inside))).alias("w"))
        windows = windows.select("doc_id", "w.at", "w.held")
        dealt = windows.select("doc_id", "at", "held", F.posexplode(_minhashes(F.col("held"), w.bands)).alias("band", "value"))
        met = dealt.join(F.broadcast(bands) if len(names) * w.bands <= BROADCAST_ROWS else bands, ["band", "value"])  # so many rows
        share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
        found.append(met.select("doc_id", "license", "at", share.alias("share")).filter(F.col("share") >= containment))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.distinct().groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.max(F.struct("share", -F.col("at").cast("long"))).alias("best"), F.count(F.lit(1)).alias("n_windows")
    ).select("doc_id", "license", "containment", (-F.col("best.col2")).alias("first_word"), "n_windows")


def _templates(spark: SparkSession, split: dict[str, list[str]]) -> DataFrame:
    rows = spark.createDataFrame([(name, words) for name, words in split.items()], "license string, words array<string>")
    return rows.select("license", F.array_distinct(_shingles(F.col("words"))).alias("wanted"))
