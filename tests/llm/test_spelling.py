"""Spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

import pytest

from checks.compare import connect, differences
from gridpulse.llm import spelling
from gridpulse.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.conftest import CLASHING


def counted(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for word in n:
        best = min(near[word], key=lambda v: (-n[v], v), default=None)
        form[word] = best if best is not None and n[best] >= 5 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n[word], len(near[word]), n.get(form[word])))
    return sorted(out, key=str)


def texts(seed, size=120):
    """Words over few letters, so that vectors collide and edits abound; counts of all sizes."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeÉé÷z") for _ in range(rng.randint(5, 8))) for _ in range(12)]
    rows = []
    for i in range(size):
        out = []
        for _ in range(60):
            word = stems[min(int(rng.expovariate(0.5)), len(stems) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(word))
                word = word[:k] + rng.choice(["", "a", "B", "é"]) + word[k + rng.randint(0, 1) :]
            out.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i if rng.random() < 0.9 else None, rng.choice([" ", "1", "\n", "ŁĀ"]).join(out), None, None))
    return rows


@pytest.mark.parametrize("shard", [spelling.WORDS_A_SHARD, 2])
def test_variants_equal_brute_force(docs, shard):
    """With shards of two words every depth of prefixes, and salts of whole vectors, are used."""
    rows = texts(1) + [(900, None), (901, ""), (902, "aaaaaaaa " * 9), (902, "aaaaaaaa " * 9)]
    rows += [(903, ("x" * 40000 + " ") * 5 + ("x" * 39999 + "y ") * 30)]
    got = spelling.variants(docs(rows, CLASHING), words_a_shard=shard).collect()
    expected = brute(rows)
    assert len(expected) > 100 and any(r[1] for r in expected) and len({r[2] for r in expected if r[1] != r[2]}) > 1
    assert sorted((tuple(r) for r in got), key=str) == expected


def test_anagrams_share_a_vector(spark):
    """Words of one vector stand in salted shards; each pair is found once, from both sides."""
    words = sorted({"".join(random.Random(i).sample("abcdef", 6)) for i in range(300)} | {"abcdeg", "abcdefg"})
    table = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n long")
    for shard in (1, 50):
        got = Counter(tuple(r) for r in spelling.near_words(table, shard).collect())
        n = {w: i + 5 for i, w in enumerate(words)}
        expected = Counter((a, b, n[b]) for a in words for b in words if one_edit(a, b))
        assert got == expected


def test_chains_end(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(19)] + [(f"v{i}", "w3") for i in range(5)]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r["root"] for r in got} == {"w19"} and len(got) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "ab 12 abcdef")]])
def test_no_words(docs, rows):
    assert spelling.variants(docs(rows)).collect() == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op12_spelling_variants"
    assert differences(spark, connect(folder), folder, name, LLM_QUERIES, LLM_ORACLES) is None
