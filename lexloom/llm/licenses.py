"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Units of a text are its lines, their sentences, its blocks of lines and the text itself; and, wherever a key word of a template stands, the
words around it that this template would take up. A unit is held against each template by the cosine of TF-IDF vectors of words and
word pairs; inverse document frequencies come from all documents, for the terms that templates have, and any other term weighs as the
rarest. A file's licence is its best unit's, if that reaches the threshold and stands out from the next licence by the margin.

Only units with a key word are held against templates. The key words follow from the threshold: what a template weighs without the terms
that they are part of is less than the threshold, and by Cauchy and Schwarz so is the cosine of any unit that has none of them.
A file named as a licence file, or that is nothing but a licence, speaks for its directory; the licence of a file without one
of its own is that of the nearest directory above it that has one, found by joins of paths, one level at a time.

Defined results: null and empty texts have no licence of their own; a null path inherits nothing; of equal units the first in the order
above counts; a notice that is as near to two licences (a family without its version) is none; of several licence files in a directory the
best score wins, then the name that sorts first; repeated rows come out as often as they go in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import per_row, written

#: Licence notices and the first sentences of licence texts, as published.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication"],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}
WORD = re.compile(r"[a-z0-9]+")
SENTENCE_END = re.compile(r"(?<=[.!?;])\s+")
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
MANY = 2000  # words that are counted in numbers instead of strings


def terms(words: list[str]) -> Counter:
    return Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))])


def units(text: str, own: frozenset | set):
    """The words of each line, each sentence in it and each block of lines between blank ones, if a word of own is among them."""
    block: list[str] = []
    n = 0
    for line in [*text.lower().split("\n"), ""]:
        words = WORD.findall(line)
        hit = not own.isdisjoint(words)
        if hit:
            yield words
            sentences = SENTENCE_END.split(line)
            for part in map(WORD.findall, sentences if len(sentences) > 1 else ()):
                if not own.isdisjoint(part):
                    yield part
        if words:
            block += words
            n += 1
        elif not line.strip():
            if n > 1 and not own.isdisjoint(block):
                yield block
            block, n = [], 0


TERMS = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms(WORD.findall(x.lower())))
SINGLE = frozenset(t for t in TERMS if " " not in t)


def frequencies(docs: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """In how many documents each term of the templates occurs, and how many documents there are: summed in each task first."""
    def run(batches):
        df: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for text in b.column(0).slice(at, 1000).to_pylist():
                    df[""] += 1
                    words = WORD.findall((text or "").lower())
                    hits = SINGLE.intersection(words)
                    df.update(hits)
                    if len(hits) > 1:
                        df.update(TERMS.intersection(map(" ".join, [p for p in zip(words, words[1:], strict=False) if p[0] in hits and p[1] in hits])))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])

    found = {r[0]: r[1] for r in docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}  # TERMS rows at most
    return found, found.pop("", 0)


class Scanner:
    def __init__(self, df: dict[str, int], n: int, threshold: float, margin: float = 0.01):
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in TERMS}
        self.rarest, self.threshold, self.margin = math.log(1 + n) + 1, threshold, margin
        said = [(name, WORD.findall(x.lower())) for name, texts in sorted(TEMPLATES.items()) for x in texts]
        self.templates = [(name, self.vector(words)) for name, words in said]
        self.index: dict[str, list[tuple[int, float]]] = {}  # term -> the templates that have it, and its weight there
        self.places: dict[str, list[tuple[int, int, int]]] = {}  # key word -> its place in a template, the template's length and number
        for k, (_, have) in enumerate(self.templates):
            for t, x in have.items():
                self.index.setdefault(t, []).append((k, x))
            keys = self.key_words(have, df)
            for at, w in enumerate(said[k][1]):
                if w in keys:
                    self.places.setdefault(w, []).append((at, len(said[k][1]), k))
        self.keys = frozenset(self.places)

    def key_words(self, have: dict[str, float], df: dict[str, int]) -> set[str]:
        """Words of a template so that its other terms weigh less than the threshold together; those that weigh much for the documents that they are in come first."""
        left, keys = dict(have), set()
        while math.fsum(x * x for x in left.values()) >= self.threshold**2 - 1e-6:
            gain: dict[str, float] = {}
            for t, x in left.items():
                for w in set(t.split()):
                    gain[w] = gain.get(w, 0.0) + x * x
            best = max(sorted(gain), key=lambda w: gain[w] / (1 + df.get(w, 0)))
            keys.add(best)
            left = {t: x for t, x in left.items() if best not in t.split()}
        return keys

    def vector(self, words: list[str]) -> dict[str, float]:
        """The weights of the terms that templates have; the length is that of all terms."""
        if len(words) > MANY:
            seen: dict[str, int] = {}
            a = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
            pairs, times = np.unique(a[:-1] * len(seen) + a[1:], return_counts=True)
            names = list(seen)
            mine = np.array([w in SINGLE for w in names])
            found = {names[i]: k for i, k in enumerate(np.bincount(a, minlength=len(seen)).tolist()) if mine[i]}
            for i in np.flatnonzero(mine[pairs // len(seen)] & mine[pairs % len(seen)]):
                t = f"{names[pairs[i] // len(seen)]} {names[pairs[i] % len(seen)]}"
                if t in TERMS:
                    found[t] = int(times[i])
            every = (1 + np.log(np.concatenate([np.bincount(a, minlength=len(seen)), times]))) ** 2
            v = {t: (1 + math.log(k)) * self.idf[t] for t, k in found.items()}
            rest = float(every.sum()) - math.fsum((1 + math.log(k)) ** 2 for k in found.values())
            norm = math.sqrt(max(rest, 0.0) * self.rarest**2 + math.fsum(x * x for x in v.values()))
            return {t: x / norm for t, x in v.items()}
        v = {t: (1 + math.log(k)) * self.idf.get(t, self.rarest) for t, k in terms(words).items()}
        norm = math.sqrt(math.fsum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items() if t in TERMS}

    def best(self, words: list[str]) -> tuple[float, str, float]:
        """The best template's cosine and licence, and how far the next licence is behind."""
        scores = [0.0] * len(self.templates)
        for t, x in self.vector(words).items():
            for k, y in self.index[t]:
                scores[k] += x * y
        score, name, second = 0.0, "", 0.0
        for s, (own, _) in zip(scores, self.templates, strict=True):
            s = round(s, 9)
            if own == name:
                score = max(score, s)
            elif s > score:
                score, name, second = s, own, score
            else:
                second = max(second, s)
        return score, name, score - second

    def around(self, words: list[str]):
        """The stretches of a template's length that hold a key word where the template does."""
        seen = set()
        for i, w in enumerate(words):
            for at, n, _ in self.places.get(w, ()):
                if (i - at, n) not in seen:
                    seen.add((i - at, n))
                    yield words[max(0, i - at) : max(0, i - at + n)]

    def __call__(self, text: str | None) -> tuple[str | None, float, float, bool]:
        """Licence, score, margin, and whether the text is nothing else."""
        words = WORD.findall((text or "").lower())
        if self.keys.isdisjoint(words):
            return None, 0.0, 0.0, False
        whole = self.best(words)
        found = (0.0, "", 0.0)
        for unit in chain(units(text, self.keys), self.around(words)):
            found = max(found, self.best(unit), key=lambda f: f[0])
        found = max(found, whole, key=lambda f: f[0])
        score, name, margin = found
        known = score >= self.threshold and margin >= self.margin
        return name if known else None, score, margin, known and whole[0] >= self.threshold


def directory(path: Column) -> Column:
    """Up to and without the last slash; null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def scanned(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, margin: float = 0.01) -> DataFrame:
    """id, path, own_license, score, margin (to the next licence), license, inherited_from (a directory, null if the licence is its own or there is none)."""
    df, n = frequencies(docs, text_col)
    files = docs.select(F.col(id_col), path.alias("path"), F.col(text_col))
    found = written(per_row(files, [text_col], [id_col, "path"], "own_license string, score double, margin double, alone boolean", lambda: Scanner(df, n, threshold, margin)))
    speaks = F.col("own_license").isNotNull() & (F.col("alone") | F.col("path").rlike(FILE_NAME))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license")))
    dirs = written(found.filter(speaks).select(directory(F.col("path")).alias("dir"), "score", "own_license").filter("dir IS NOT NULL").groupBy("dir").agg(best.alias("b")).select("dir", F.col("b.own_license").alias("dir_license")))
    # the directories of files without a licence are few beside files: they climb, one join a level, until they meet one that has one or the top
    todo = written(found.filter("own_license IS NULL").select(directory(F.col("path")).alias("of")).filter("of IS NOT NULL").distinct()).withColumn("at", F.col("of"))
    reached = None
    while True:
        met = todo.join(dirs, todo["at"] == dirs["dir"], "left").select("of", "at", "dir_license")
        met = written(met)
        got = met.filter("dir_license IS NOT NULL")
        reached = got if reached is None else reached.unionByName(got)
        todo = met.filter("dir_license IS NULL").select("of", directory(F.col("at")).alias("at")).filter("at IS NOT NULL")
        if todo.isEmpty():
            break
    out = found.withColumn("of", F.when(F.col("own_license").isNull(), directory(F.col("path"))))
    out = out.join(reached.withColumnRenamed("at", "inherited_from"), "of", "left")
    return out.select(id_col, "path", "own_license", "score", "margin", F.coalesce("own_license", "dir_license").alias("license"), "inherited_from")
