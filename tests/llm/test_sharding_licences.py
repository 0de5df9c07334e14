import math
import re
import zlib
from collections import Counter
from importlib.resources import files as packaged

from gridpulse.llm import licences, sharding
from tests.llm.conftest import CLASHING


def test_shards_match_the_mixture(spark, docs):
    rows = [(i, "é" * (i % 9), None, "hot" if i % 3 else f"s{i % 7}") for i in range(1500)]
    rows += [(2000 + i, None, None, None) for i in range(50)]
    got = sharding.interleaved_shards(docs(rows, CLASHING), 24).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    sources = Counter(r[3] for r in rows)
    for (shard, source), n in Counter((r.shard, r.source) for r in got).items():
        assert abs(n - sources[source] / 24) < 2
    again = sharding.interleaved_shards(docs(rows), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shard_edges(spark, docs):
    rows = [(1, "a"), (1, "a"), (None, None), (None, "b")]
    got = sharding.interleaved_shards(docs(rows), 24).collect()
    assert len(got) == 4 and len({r.shard for r in got}) == 4 and {r.slot for r in got} == {0}
    assert sharding.interleaved_shards(docs(rows).limit(0)).count() == 0


def test_many_small_sources_and_missing_ids(spark, docs):
    """Ranks equal one plain sort, also where all fractions or all keys are the same."""
    import hashlib

    rows = [(i, "t" * (i % 5), None, f"s{i:03}") for i in range(200)]
    rows += [(None, "x" * i, None, "n") for i in range(150)] + [(7, "y" * i, None, None) for i in range(60)]

    def entry(d, t, source):
        data = t.encode()
        key = hashlib.md5(f"8:{'null' if d is None else d}".encode()).hexdigest()
        stratum = "n" if source is None else "s" + source
        return stratum, key, (d is not None, d or 0), len(data) + 8, zlib.crc32(data)

    entries = sorted(entry(r[0], r[1], r[3]) for r in rows)
    totals, seen, placed = Counter(e[0] for e in entries), Counter(), []
    for e in entries:
        seen[e[0]] += 1
        placed.append(((2 * seen[e[0]] - 1) / (2 * totals[e[0]]), e))
    want = []
    for rank, (_, e) in enumerate(sorted(placed)):
        shard = rank * 24 // len(rows)
        want.append((e[2][1] if e[2][0] else None, e[3], e[4], shard, rank - -(-shard * len(rows) // 24)))
    got = sharding.interleaved_shards(docs(rows), 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == Counter(want)


def test_files_of_documents(spark, docs):
    from gridpulse.llm.queries import document_files

    rows = [(0, "a"), (16, "b"), (17, "c"), (None, "d"), (None, "d"), (None, None)]
    got = document_files(docs(rows)).collect()
    paths = [r.path for r in got]
    assert len(got) == 6 and None not in paths and len(set(paths)) == 5
    assert {"0/README.md", "0/1/README.md", "0/1/17.txt"} <= set(paths)


def brute(files):
    def words(line):
        return [w for w in re.split("[^a-z0-9]+", line.lower()) if w]

    lines = [(p, words(l)) for p, t in files for l in (t or "").split("\n") if t is not None and words(l)]
    templates = {k: Counter(words(v)) for k, v in licences.TEMPLATES.items()}
    vocabulary = {w for t in templates.values() for w in t}
    df = Counter(w for _, ws in lines for w in set(ws) if w in vocabulary)
    top = math.log(len(lines) + 1)
    idf = {w: top - math.log(df.get(w, 1)) for w in vocabulary}
    best = {}
    for path, ws in lines:
        tf = Counter(ws)
        norm = math.sqrt(sum((n * idf.get(w, top)) ** 2 for w, n in tf.items()))
        for name, template in sorted(templates.items()):
            length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in template.items()))
            dot = sum(tf[w] * n * idf[w] ** 2 for w, n in template.items())
            cosine = round(dot / (norm * length), 6) if norm and length else 0
            if cosine >= licences.THRESHOLD and cosine > best.get(path, ("", 0))[1]:
                best[path] = name, cosine
    paths = {p for p, _ in files}
    out = {}
    for path in paths:
        if path in best:
            out[path] = best[path][0], "own", path
            continue
        out[path] = None, None, None
        folder = path
        while folder:
            folder = folder.rpartition("/")[0]
            names = sorted(p for p in best if p.rpartition("/")[0] == folder
                           and re.match(licences.LICENCE_FILE, p.rpartition("/")[2]))
            if names:
                out[path] = best[names[0]][0], "inherited", names[0]
                break
    return out


def test_licences_equal_brute_force(spark):
    t = licences.TEMPLATES
    filler = [(f"z/{i}.txt", "some the words\nof a work under a plain sky") for i in range(20)]
    files = [
        ("LICENSE", t["MIT"]), ("a.py", "x\n" + t["GPL-3.0"] + "\ny"), ("b.py", "nothing here"),
        ("lib/README.md", "Intro\nreleased under the mit license"), ("lib/c.py", None), ("lib/deep/er/d.py", "the"),
        ("lib/deep/COPYING", t["Apache-2.0"]), ("lib/deep/e.py", ""), ("lib/other.txt", t["MPL-2.0"]),
        ("q/NOTICE", t["CC-BY-4.0"] + " and much more text that follows here"), ("q/x", "a"), *filler, ("b.py", "nothing here"),
    ]
    df = spark.createDataFrame([*files, (None, t["MIT"])], "path string, text string")
    df = df.selectExpr("*", "1 AS line", "2 AS words", "3 AS home", "4 AS licence")
    got = {r.path: (r.licence, r.origin, r.licence_from) for r in licences.licences(df).collect()}
    assert got == brute(files)
    assert got["lib/deep/er/d.py"] == ("Apache-2.0", "inherited", "lib/deep/COPYING")
    assert got["b.py"][0] == "MIT" and got["a.py"][:2] == ("GPL-3.0", "own")
    assert licences.licences(df.limit(0)).count() == 0


def test_licences_beyond_the_short_statements(spark):
    def text(name):
        return (packaged("gridpulse.llm") / "licence_texts" / f"{name}.txt").read_text()

    mit = text("MIT").replace("<year> <copyright holders>", "2019 Jane Roe and others").replace(", ", ",\n * ")
    apache = "\n".join(" * " + line for line in text("Apache-2.0").split("\n")[-13:])
    files = {
        "a/LICENSE": (mit.split("\n\n", 2)[2], "MIT"),  # neither title nor copyright line
        "b/x.c": ("/*\n * Copyright 2020 Roe\n *\n" + apache + "\n */\nint main() { return 0; }", "Apache-2.0"),
        "c/COPYING": (text("GPL-3.0"), "GPL-3.0"), "d/COPYING": (text("GPL-2.0"), "GPL-2.0"),
        "e/COPYING": (text("LGPL-3.0"), "LGPL-3.0"), "f/LICENSE": (text("BSD-3-Clause"), "BSD-3-Clause"),
        "g/x.py": ("#!/bin/x\n# SPDX-License-Identifier: GPL-3.0-or-later\nprint(1)", "GPL-3.0"),
        "h/x.py": ("// SPDX-License-Identifier: MIT", "MIT"), "i/x.py": ("# SPDX-License-Identifier: AAL", None),
        "j/x": ("# This file is licensed under the MIT License.", "MIT"), "k/x": ("MIT License", "MIT"),
        "l/x": ("The code here is released under the MIT License.", "MIT"),
        "m/README.md": ("# Name\n\nSome words.\n\n## License\n\nMIT\n", "MIT"),
        "n/x": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "CC-BY-NC-4.0"),
        "o/x": ("the licence of the driver is under review and that is that", None),
    }
    rows = [(p, t) for p, (t, _) in files.items()]
    rows += [(f"z/{i}", f"the words of here {i} and a plain line\nof a work that is in the sky") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.licence for r in licences.statements(df).collect()}
    assert {p: got.get(p) for p in files} == {p: n for p, (_, n) in files.items()}
    assert not any(p.startswith("z/") for p in got)
