"""Licence scans: sparse TF-IDF cosine of spans to templates, then folder inheritance.

Spans of a file are compared with the forms of each licence as TF-IDF vectors. Spans are
lines, runs of paragraphs (lines that hold words, comment marks aside) and the whole file;
forms are short statements, usual headers and the texts of licence files. An SPDX tag names
its licence by itself. Document frequencies of all words are counted over all lines by a
groupBy. The scan knows those of the template words and of the common words, whose number
is bounded; it drops spans that cannot reach the threshold whatever their other words weigh,
and the other words of what is left get their frequencies by a join. A file without a
statement of its own takes the licence of the nearest folder above it in which a licence
file or a README has one; folders are matched by joins on their paths.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from importlib.resources import files as packaged
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.scratch import stored

# Short statements that stand for a licence: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}
# Names of licences and sentences around them. Licences beyond those above keep their near
# relations from being taken for them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3 license", "AGPL-3.0 license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2", "ASL 2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause Simplified License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-style license", "Modified BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2 license", "GPL-2.0 license"],
    "GPL-3.0": [
        "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3",
        "GNU GPL v3", "GNU GPL version 3", "GPLv3 license", "GPL-3.0 license",
    ],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3 license", "LGPL-3.0 license"],
    "MIT": ["MIT License", "MIT License (MIT)", "MIT-style license"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0 license"],
}
CREATIVE = {
    "CC-BY-4.0": "Attribution", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
}
for _name, _long in CREATIVE.items():
    _short = _name.removesuffix("-4.0").replace("CC-", "CC ")
    NAMES[_name] = [
        f"{_short} 4.0", f"{_short} 4.0 license", f"Creative Commons {_long} 4.0 International License", f"{_long} 4.0 International",
        f"Creative Commons {_long} 4.0 International Public License", f"Creative Commons {_long} 4.0 License",
    ]
SENTENCES = (
    "{}", "The {}", "{} or later", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.",
    "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This file is licensed under the {}.", "This code is released under the {}.", "The code is released under the {}.",
    "This project is licensed under the {}.", "This software is released under the {}.",
    "This project is licensed under the terms of the {}.", "Distributed under the {}. See LICENSE for more information.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "Use of this source code is governed by a {} that can be found in the LICENSE file.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {}.",
)
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of
the {name} as published by the Free Software Foundation, either version {version} of the License, or (at
your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the {name} for more details. You should have received a copy of the {name} along with this {what}. If not,
see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License", "3", "19 November 2007"),
    "GPL-2.0": ("GNU General Public License", "2", "June 1991"),
    "GPL-3.0": ("GNU General Public License", "3", "29 June 2007"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3", "29 June 2007"),
}
HEADERS = {
    name: [f"{title} Version {version}, {date}", *(_GNU.format(what=w, name=title, version=version) for w in ("program", "library"))]
    for name, (title, version, date) in _GNU_NAMES.items()
}
HEADERS["Apache-2.0"] = [
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.""",
]
HEADERS["MPL-2.0"] = [
    "Mozilla Public License Version 2.0",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
]
TEXTS = "Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0".split()
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|readme)([.\-].*)?$"
THRESHOLD = 0.8
COMMON = 1000  # a word in more than one of so many lines is common
PARAGRAPHS = 12  # most paragraphs of a span that is not the whole file
WORDS_HELD = 200_000  # counted words a task holds before it hands them on

_WORD = re.compile("[a-z0-9]+")
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:\s*([^\n]*)")
_COPYRIGHT = re.compile(r"(?i)^\W*(copyright\W*(\(c\)|©|<year>|[0-9]{4})|\(c\)\W*[0-9]{4}|©|all rights reserved\W*$)")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _plain(text: str) -> str:
    return "\n".join(line for line in text.split("\n") if not _COPYRIGHT.match(line))


def forms() -> dict[str, list[str]]:
    """Everything a licence is known by: statements, names in sentences, headers, full texts."""
    out = {name: [body] for name, body in TEMPLATES.items()}
    for name, known in NAMES.items():
        out.setdefault(name, []).extend(s.format(k) for k in known for s in SENTENCES)
    for name, known in HEADERS.items():
        out[name].extend(known)
    for name in TEXTS:
        body = _plain((packaged("gridpulse.llm") / "licence_texts" / f"{name}.txt").read_text("utf-8"))
        out[name].append(body)
        if name == "MIT":  # its permission stands without the rest in some files
            out[name].extend(p for p in body.split("\n\n") if p.startswith("Permission"))
    return out


class _Templates:
    """Vectors of all forms, and what a span needs to reach the threshold with one of them."""

    def __init__(self, known: dict[str, list[str]], idf, threshold: float):
        self.names = sorted(known)
        self.spdx = {n.lower(): i for i, n in enumerate(self.names)}
        bags = {
            (i, tuple(sorted(Counter(_words(body)).items())))
            for i, n in enumerate(self.names) for body in known[n]
        }
        self.of, self.needed = [], set()
        entries: dict[str, tuple[list, list]] = {}
        self.idf = {w: idf(w) for _, bag in bags for w, _ in bag}
        for i, bag in sorted(bags):
            masses = sorted((self.idf[w] ** 2 * tf * tf, w, tf) for w, tf in bag)
            whole = sum(m for m, _, _ in masses)
            if not whole:
                continue
            # A span without any of these words misses too much of the form.
            missing, rare = 0.0, sorted(masses, key=lambda e: (-self.idf[e[1]], e[1]))
            for m, w, _ in rare:
                missing += m
                self.needed.add(w)
                if missing > (1 - threshold**2) * whole:
                    break
            for _, w, tf in masses:
                at, by = entries.setdefault(w, ([], []))
                at.append(len(self.of))
                by.append(tf * self.idf[w] ** 2 / sqrt(whole))
            self.of.append(i)
        self.entries = {w: (np.array(at), np.array(by)) for w, (at, by) in entries.items()}
        self.of = np.array(self.of, np.int64)

    def dots(self, counts: Counter) -> np.ndarray:
        out = np.zeros(len(self.of))
        for w, tf in counts.items():
            if w in self.entries:
                at, by = self.entries[w]
                out[at] += tf * by
        return out


def _candidates(text: str, known: _Templates, common: dict[str, float], least: float, threshold: float) -> dict:
    """(place, words, counts, mass): best dot, of spans that may reach the threshold.

    ``words`` have no idf yet and weigh ``least`` or more; ``mass`` is that of the others.
    """
    lines = text.split("\n")
    found: dict = {}

    def mass(w, tf, before=0):
        idf = known.idf.get(w)
        idf = common.get(w, least) if idf is None else idf
        return ((tf + before) ** 2 - before * before) * idf * idf

    def judge(counts, dots, bound):
        if not len(dots) or bound <= 0:
            return
        near = np.flatnonzero(dots >= (threshold - 1e-6) * sqrt(bound))
        if not len(near):
            return
        open_words = sorted((w, tf) for w, tf in counts.items() if w not in known.idf and w not in common)
        held = sum(mass(w, tf) for w, tf in counts.items() if w in known.idf or w in common)
        words, tfs = tuple(w for w, _ in open_words), tuple(tf for _, tf in open_words)
        for i in near.tolist():
            key = (int(known.of[i]), words, tfs, held)
            found[key] = max(found.get(key, 0.0), float(dots[i]))

    def whole(counts):
        judge(counts, known.dots(counts), sum(mass(w, tf) for w, tf in counts.items()))

    paragraphs, current = [], []
    for line in lines:
        words = _words(line)
        tag = _SPDX.search(line) if "spdx" in words else None
        if tag:
            for one in re.findall(r"[\w.+\-]+", tag.group(1)):
                one = re.sub(r"(-only|-or-later|\+)$", "", one.lower())
                if one in known.spdx:
                    found[known.spdx[one], (), (), 1.0] = 1.0
        if words and not known.needed.isdisjoint(words):
            whole(Counter(words))
        if not words:
            paragraphs.append(current)
            current = []
        elif not _COPYRIGHT.match(line):
            current.append(words)
    paragraphs = [Counter(w for words in p for w in words) for p in [*paragraphs, current] if p]
    marked = [not known.needed.isdisjoint(p) for p in paragraphs]
    if not any(marked):
        return found
    dots: dict[int, np.ndarray] = {}
    for i in range(len(paragraphs)):
        upto = min(len(paragraphs), i + PARAGRAPHS)
        if not any(marked[i:upto]):
            continue
        counts, sums, bound, seen = Counter(), np.zeros(len(known.of)), 0.0, False
        for j in range(i, upto):
            if j not in dots:
                dots[j] = known.dots(paragraphs[j])
            sums = sums + dots[j]
            for w, tf in paragraphs[j].items():
                bound += mass(w, tf, counts[w])
                counts[w] += tf
            seen = seen or marked[j]
            if seen:
                judge(counts, sums, bound)
        dots.pop(i, None)
    if len(paragraphs) > PARAGRAPHS:
        whole(sum(paragraphs, Counter()))
    return found


def statements(
    files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """path, licence, cosine: the best licence of each file that has one at ``threshold``.

    ``files`` has path and text; null paths and texts find nothing, ties go to the licence
    first in order. ``templates`` replace all forms by one each. An SPDX tag counts as 1, of
    several licences in it the first in order is taken. Paragraphs leave copyright lines out.
    Idf is ln(lines + 1) - ln(lines with the word).
    """
    known = {n: [body] for n, body in templates.items()} if templates else forms()
    files = files.filter("path is not null and text is not null").select("path", "text")

    def count(batches):
        held, lines = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in text.split("\n"):
                    words = set(_words(line))
                    held.update(words)
                    lines += bool(words)
                if len(held) > WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()))], names=["word", "df"])
                    held = Counter()
        held[""] = lines  # no word is empty
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()))], names=["word", "df"])

    counted = files.select("text").mapInArrow(count, "word string, df long")
    counted = stored(counted.groupBy("word").agg(F.sum("df").alias("df")), "words")
    total = counted.filter("word = ''").agg(F.sum("df")).first()[0] or 0
    vocabulary = {w for bodies in known.values() for body in bodies for w in _words(body)}
    wanted = files.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "word string")
    dfs = {r["word"]: r["df"] for r in counted.join(F.broadcast(wanted), "word").collect()}
    top = log(total + 1)
    limit = max(1, total // COMMON)  # so common words are at most COMMON times the words of a line
    frequent = counted.filter((F.col("df") > limit) & (F.col("word") != "")).collect()
    common = {r["word"]: top - log(r["df"]) for r in frequent}
    least = top - log(limit)
    vectors = _Templates(known, lambda w: top - log(dfs.get(w, 1)), threshold)

    def scan(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vectors.needed.isdisjoint(_words(text)) and "spdx" not in text.lower():
                    continue
                for (place, words, tfs, mass), dot in _candidates(text, vectors, common, least, threshold).items():
                    span = hashlib.sha256(repr((words, tfs)).encode()).hexdigest() if words else None
                    out.append((path, place, dot, mass, span, words, tfs))
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "path string, place int, dot double, mass double, span string, words array<string>, tfs array<int>"
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
    near = stored(files.mapInArrow(scan, schema), "spans")
    spans = near.filter("span is not null").groupBy("span").agg(F.first("words").alias("words"), F.first("tfs").alias("tfs"))
    parts = spans.select("span", F.explode(F.arrays_zip("words", "tfs")).alias("w"))
    parts = parts.select("span", F.col("w.words").alias("word"), F.col("w.tfs").alias("tf"))
    part = F.pow(F.col("tf") * (F.lit(top) - F.log("df")), F.lit(2.0))
    rest = parts.join(counted, "word").groupBy("span").agg(F.sum(part).alias("rest"))
    scored = near.filter("span is null").select("path", "place", "dot", "mass").unionByName(
        near.join(rest, "span").select("path", "place", "dot", (F.col("mass") + F.col("rest")).alias("mass"))
    )
    cosine = F.round(F.col("dot") / F.sqrt("mass"), 6).alias("cosine")
    best = scored.select("path", F.struct(cosine, (-F.col("place")).alias("place")).alias("top"))
    best = best.filter(F.col("top.cosine") >= threshold).groupBy("path").agg(F.max("top").alias("top"))
    ordered = F.array(*[F.lit(n) for n in vectors.names])
    return best.select(
        "path", F.element_at(ordered, 1 - F.col("top.place")).alias("licence"), "top.cosine"
    )


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licences(files: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """path, licence, cosine, origin ('own', 'inherited', null), licence_from per distinct path.

    ``licence_from`` is the file that states it. In one folder the licence file first in
    order speaks. Files with no statement in or above their folder get nulls. Rows of one
    path are one file with the lines of all. Null paths are left out.
    """
    paths = files.filter("path is not null").select("path").distinct()
    own = statements(files, templates)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    speakers = own.filter(name.rlike(LICENCE_FILE)).withColumn("folder", _folder(F.col("path")))
    spoken = speakers.groupBy("folder").agg(F.min(F.struct("path", "licence")).alias("s"))
    folders = paths.select(_folder(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = folders.select(
        "home",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
        )).alias("folder"),
    ).distinct()
    nearest = (
        above.join(spoken, "folder").groupBy("home")
        .agg(F.max(F.struct(F.length("folder"), "folder", "s")).alias("n"))
        .select("home", F.col("n.s.path").alias("_from"), F.col("n.s.licence").alias("_licence"))
    )
    stated = paths.join(own, "path", "left").withColumn("home", _folder(F.col("path")))
    return stated.join(nearest, "home", "left").select(
        "path",
        F.coalesce("licence", "_licence").alias("licence"),
        "cosine",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("_licence").isNotNull(), "inherited")
        .alias("origin"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("_from")).alias("licence_from"),
    )
