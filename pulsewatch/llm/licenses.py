"""Licence scan: sparse TF-IDF cosine of a file to licence templates, then
inheritance from the nearest ancestor directory with a licence file.

Document frequencies of the templates' terms are counted over all files; a term
outside them weighs as the rarest.  A file is compared in this order, and the
first step whose best cosine reaches ``least`` names its licence:

1. a licence file (LICENSE, COPYING, ...): its whole text to the full texts;
2. the header block (leading comment, lines joined) as a whole to the source
   headers and full texts, and every window of a template's length anywhere in
   the file to the source headers and short full texts;
3. every line, and every window of a notice's length, to the one-line notices
   (after the others: a notice may be a sentence that several licences share).

Windows run over the terms of the text, so they span line ends and comment
marks.  A file without a licence takes that of the nearest directory above it
that holds a licence file, found by joins on directory paths.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, ship, staged, whole_text

# FIXED VALUES: notices by SPDX id.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_GNU_REST = (" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of "
             "the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>.")
_GNU_KINDS = (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
              ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
              ("AGPL-3.0", "program", "Affero General Public License", "3"))
# FIXED VALUES: source headers by SPDX id.
HEADERS: tuple[tuple[str, str], ...] = (
    *[(spdx, form.format(what=what, name=name, version=version)) for spdx, what, name, version in _GNU_KINDS for form in (_GNU, _GNU + _GNU_REST)],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
     "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-].*)?$"
COMMENT_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("{-", "-}"), ("(*", "*)"))
COMMENT_MARK = re.compile(r"#|//|--|;|%|\*|!|\.\.|dnl\b|rem\b", re.I)


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


def full_texts() -> tuple[tuple[str, str], ...]:
    """Full licence texts by SPDX id.  The AGPL's is the GPL's with its name in place."""
    out = []
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as f:
            out.append((name.removesuffix(".txt"), f.read()))
    gpl = dict(out)["GPL-3.0"]
    return (*out, ("AGPL-3.0", re.sub(r"(?i)(GNU) (General Public)", r"\1 Affero \2", gpl)))


def header_block(text: str) -> str:
    """The leading comment without its marks, lines joined; empty if there is none."""
    out, close = [], None
    for line in text.splitlines():
        rest = line.strip().lstrip("\ufeff")
        if close is None:
            opened = next(((a, b) for a, b in COMMENT_BLOCKS if rest.startswith(a)), None)
            mark = COMMENT_MARK.match(rest)
            if opened:
                rest, close = rest[len(opened[0]):], opened[1]
            elif mark:
                out.append(rest[mark.end():])
                continue
            elif rest:
                break
            else:
                continue
        at = rest.find(close)
        out.append(rest if at < 0 else rest[:at])
        if at >= 0:
            close = None
    return " ".join(out)


class Matcher:
    def __init__(self, frequency: dict[str, int], files: int, least: float, notices=NOTICES, headers=HEADERS, texts=None):
        texts = full_texts() if texts is None else texts
        counted = [[(name, Counter(terms(t))) for name, t in group] for group in (notices, headers, texts)]
        self.idf = {t: math.log((files + 1) / (frequency.get(t, 0) + 1)) + 1 for group in counted for _, n in group for t in n}
        self.rarest = math.log(files + 1) + 1
        self.least = least
        self.notices, self.headers, self.texts = ([(name, self.unit(n)) for name, n in group] for group in counted)
        self.ids = {t: i for i, t in enumerate(self.idf)}
        self.weight = np.array([*self.idf.values(), self.rarest])
        self.vocabulary = frozenset(self.idf)
        self.notice_size, header_size, text_size = ([sum(n.values()) for _, n in group] for group in counted)
        self.inside = self.headers + self.texts
        self.inside_size = header_size + text_size
        self.gain = {id(w): self.dense(w) for _, w in self.notices + self.inside}
        self.all = [id(w) for _, w in self.notices + self.headers + self.texts]
        self.square = np.zeros((len(self.ids), len(self.all)))
        for k, (_, w) in enumerate(self.notices + self.headers + self.texts):
            for t, x in w.items():
                self.square[self.ids[t], k] = x * x

    def dense(self, template: dict[str, float]) -> np.ndarray:
        """What one occurrence of each term adds to the product with a template."""
        out = np.zeros(len(self.ids) + 1)
        for t, w in template.items():
            out[self.ids[t]] = w * self.idf[t]
        return out

    def unit(self, counts: Counter) -> dict[str, float]:
        w = {t: n * self.idf.get(t, self.rarest) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    def cosine(self, words: list[str], template: dict[str, float]) -> float:
        weights = self.unit(Counter(words))
        return sum([w * weights[t] for t, w in template.items() if t in weights])

    def near(self, present: frozenset[str]) -> set[int]:
        """The templates that a part of a text with these terms can come near:
        a cosine is at most the template's weight on them."""
        mass = self.square[[self.ids[t] for t in present]].sum(0)
        return {self.all[k] for k in np.flatnonzero(mass >= self.least ** 2 - 1e-9)}

    def whole(self, words: list[str], templates) -> list[tuple[float, int, int, str]]:
        weights = self.unit(Counter(words))
        return [(sum([w * weights[t] for t, w in template.items() if t in weights]), 0, k, name)
                for k, (name, template) in enumerate(templates)]

    def window(self, words: list[str], ids: np.ndarray, template: dict[str, float], size: int) -> tuple[float, int] | None:
        """(cosine, place) of the nearest window of ``size`` terms, if one
        reaches ``least``; ties to the earlier one."""
        size = min(size, len(ids))
        dot = np.concatenate([[0.0], np.cumsum(self.gain[id(template)][ids])])
        dot = dot[size:] - dot[:-size]
        square = np.concatenate([[0.0], np.cumsum(self.weight[ids] ** 2)])
        # the norm is at least that of a window without repeats
        near = np.flatnonzero(dot >= (self.least - 1e-6) * np.sqrt(np.maximum(square[size:] - square[:-size], 0.0)))
        if not len(near):
            return None
        lo, hi = int(near[0]), int(near[-1])
        held = Counter(words[lo:lo + size])
        own = [self.idf.get(t, self.rarest) ** 2 for t in words[lo:hi + size]]
        now = sum(n * n * self.idf.get(t, self.rarest) ** 2 for t, n in held.items())
        norm = np.empty(hi - lo + 1)
        norm[0] = now
        for s in range(lo, hi):
            t = words[s]
            now -= own[s - lo] * (2 * held[t] - 1)
            held[t] -= 1
            t = words[s + size]
            now += own[s + size - lo] * (2 * held[t] + 1)
            held[t] += 1
            norm[s + 1 - lo] = now
        at = lo + int(np.round(dot[lo:hi + 1] / np.sqrt(norm), 9).argmax())
        cosine = self.cosine(words[at:at + size], template)
        return (cosine, at) if cosine >= self.least else None

    def windows(self, words: list[str], near: set[int], templates, sizes: list[int]) -> list[tuple[float, int, int, str]]:
        out, ids = [], None
        for k, ((name, template), size) in enumerate(zip(templates, sizes)):
            if id(template) in near:
                if ids is None:
                    ids = np.fromiter((self.ids.get(t, len(self.ids)) for t in words), np.int64, len(words))
                got = self.window(words, ids, template, size)
                if got:
                    out.append((*got, k, name))
        return out

    def lines(self, text: str, near: set[int]) -> list[tuple[float, int, int, str]]:
        notices = [(k, name, notice) for k, (name, notice) in enumerate(self.notices) if id(notice) in near]
        out, at = [], 0
        for line in text.splitlines() if notices else ():
            words = terms(line)
            for k, name, notice in notices:
                if sum([notice[t] ** 2 for t in notice.keys() & set(words)]) >= self.least ** 2 - 1e-9:
                    out.append((self.cosine(words, notice), at, k, name))
            at += len(words)
        return out

    def best(self, text: str, licence_file: bool = False) -> tuple[str | None, float]:
        """(licence, cosine) of the first step that reaches ``least``; ties in
        it to the earlier place, then to the earlier template."""
        words = terms(text)
        near = self.near(self.vocabulary.intersection(words))
        if not near:
            return None, 0.0

        def steps():
            if licence_file:
                yield self.whole(words, self.texts)
            yield self.whole(terms(header_block(text)), self.headers + self.texts) + self.windows(words, near, self.inside, self.inside_size)
            yield self.lines(text, near) + self.windows(words, near, self.notices, self.notice_size)

        for found in steps():
            reached = [(-round(c, 9), at, k, name, c) for c, at, k, name in found if c >= self.least]
            if reached:
                *_, name, cosine = min(reached)
                return name, min(cosine, 1.0)
        return None, 0.0


def frequencies(files: DataFrame, text_col: str, texts: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], int]:
    """In how many files each template term occurs, and the files."""
    vocabulary = frozenset(t for _, n in (*NOTICES, *HEADERS, *texts) for t in terms(n))

    def count(batches: Iterator[pd.DataFrame]):
        df, n = Counter(), 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf["text"]:
                df.update(vocabulary.intersection(terms(text)))
        yield pd.DataFrame({"term": [*df, ""], "n": [*df.values(), n]})

    rows = files.select(whole_text(text_col).alias("text")).mapInPandas(count, "term string, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row for each template term
    got = {r["term"]: r["n"] for r in rows}
    return got, got.pop("", 0)


def own_licences(files: DataFrame, text_col: str = "text", least: float = 0.7, path_col: str | None = None) -> DataFrame:
    """Add ``own`` (SPDX id or null) and ``own_score``.  The text column is
    dropped.  ``path_col``: where the names of licence files are looked up."""
    spark = files.sparkSession
    ship(spark)
    texts = full_texts()
    df, n = frequencies(files, text_col, texts)
    shared = spark.sparkContext.broadcast((df, n, least, texts))
    outputs = [T.StructField("own", T.StringType()), T.StructField("own_score", T.DoubleType())]
    # the text with a leading mark of licence files
    named = F.lit("-") if path_col is None else F.when(is_licence_file(path_col), F.lit("+")).otherwise(F.lit("-"))

    def start():
        df, n, least, texts = shared.value
        match = Matcher(df, n, least, texts=texts)
        return lambda marked: list(zip(*[match.best(t[1:], t[0] == "+") for t in marked]))

    return map_texts(files.withColumn(text_col, F.concat(named, whole_text(text_col))), text_col, outputs, start)


def is_licence_file(path_col: str) -> Column:
    return F.coalesce(F.regexp_extract(path_col, "([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))


def scan(files: DataFrame, keep: tuple[str, ...] = (), path_col: str = "path", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``keep``, path, own, own_score, licence, inherited_from of every file.

    ``licence`` is the file's own or that of the nearest directory at or above
    its own that holds a licence file (several: the best score, then the
    smaller id).  Null text is the empty text; a file with a null path has
    only its own licence.  Repeated rows stay repeated; an empty table gives
    no rows; other columns are not read.
    """
    src = files.select(*[F.col(f"`{c}`") for c in keep], F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    known = own_licences(src, "text", least, "path").withColumn("dir", F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1))
    known = staged(known.withColumn("dir", F.when(F.col("path").isNull(), F.lit(None)).otherwise(F.col("dir"))), "licences")
    holders = known.where("own IS NOT NULL AND path IS NOT NULL") \
        .where(is_licence_file("path")) \
        .groupBy(F.col("dir").alias("above")).agg(F.max(F.struct(F.col("own_score"), F.col("own"))).alias("best")) \
        .select("above", F.col("best.own").alias("dir_licence"))
    dirs = known.select("dir").where("dir IS NOT NULL").distinct()
    # each directory once with all directories at or above it ('' is the root)
    parts = F.split("dir", "/")
    chain = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))) \
        .withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = chain.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("n")) \
        .select("dir", F.col("n.above").alias("above"), F.col("n.dir_licence").alias("dir_licence"))
    joined = known.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("dir_licence").isNotNull()
    return joined.select(*[F.col(f"`{c}`") for c in keep], "path", "own", "own_score",
                         F.coalesce("own", "dir_licence").alias("licence"), F.when(inherits, F.col("above")).alias("inherited_from"))
