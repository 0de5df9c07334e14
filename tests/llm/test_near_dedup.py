import random

import pytest
from pyspark.sql import functions as F

from gridpulse.llm import near_dedup
from gridpulse.llm.components import connected
from tests.llm.conftest import CLASHING


def shingle_set(text, words):
    tokens = [t for t in "".join(c.lower() if c.isascii() else c for c in text or "").split()]
    if len(tokens) >= words:
        return {tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)}
    return {tuple(tokens)} if tokens else set()


def brute(rows, words, percent=80):
    """Component of each document from all pairs."""
    sets = {d: shingle_set(t, words) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def varied(rng, base, edits, vocabulary):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return " ".join(words)


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_brute_force(spark, docs, words):
    """A group of near copies around the threshold, some linked only through others."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(4):
        base = [rng.choice(vocabulary) for _ in range(150)]
        rows += [(len(rows) + i, varied(rng, base, rng.choice([0, 1, 3, 6, 8, 10]), vocabulary)) for i in range(60)]
    rows += [(1000 + i, varied(rng, [rng.choice(vocabulary) for _ in range(80)], 0, vocabulary)) for i in range(30)]
    rows += [(2000, "One"), (2001, "oNE"), (2002, ""), (2003, None), (2004, " \t"), (2005, "one two")]
    got = near_dedup.near_groups(docs(rows), words).collect()
    want = brute(rows, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_lose_nothing(spark, docs, monkeypatch):
    """Strays of a bucket dealt over many blocks."""
    monkeypatch.setattr(near_dedup, "STRAY_SHINGLES", 300)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(i, varied(rng, base, rng.choice([6, 8, 10, 12, 14]), vocabulary)) for i in range(120)]
    got = near_dedup.near_groups(docs(rows), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_one_doc_id_at_several_texts(spark, docs):
    """Each text keeps its links, and the doc_id ties them together, in any order of rows."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(100)] for _ in range(12)]
    rows = [(i, varied(rng, bases[i % 12], 2, vocabulary)) for i in range(48)]
    # 100 joins the groups of 0 and 1, 101 those of 2, 3 and 4; 102 repeats both texts of 100.
    rows += [(100, rows[0][1]), (100, rows[1][1]), (100, None)]
    rows += [(101, varied(rng, bases[k], 1, vocabulary)) for k in (2, 3, 4)]
    rows += [(102, rows[0][1]), (102, rows[1][1]), (5, " ".join(bases[6])), (7, "")]
    # A doc_id that is the first of two sets, each with copies of its own.
    rows += [(-3, "p q r s"), (-3, "t u v w"), (200, "P Q r s"), (201, "t u v W"), (202, "x y")]
    one_each = {(i, d): t for i, (d, t) in enumerate(rows)}
    sets = {key: shingle_set(t, 2) for key, t in one_each.items()}
    parent = {d: d for _, d in one_each}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    keys = list(sets)
    for a in keys:
        for b in keys:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a[1]), root(b[1])))
                parent[y] = x
    want = sorted((d, len(sets[i, d]), root(d)) for i, d in keys)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = near_dedup.near_groups(docs(rows, CLASHING), 2).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_rows(spark, docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "A B C D"), (4, None), (5, "é É")]
    df = docs(rows, CLASHING)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_groups(df, 2).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True), (5, 5, True)]
    assert near_dedup.near_groups(df.limit(0), 2).count() == 0


def test_likelihood_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for similarity in (0.3, 0.8, 0.95):
        size = int(3000 * 2 * similarity / (1 + similarity) / 2)
        shared, rest = pool[:size], pool[size:]
        half = (3000 - size) // 2
        one, two = np.concatenate([shared, rest[:half]]), np.concatenate([shared, rest[half : 2 * half]])
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        guess = near_dedup.likeliest(near_dedup.registers(one), near_dedup.registers(two), len(one), len(two))
        assert abs(guess - true) < 0.12
        merged = np.maximum(near_dedup.registers(one), near_dedup.registers(two))
        assert (merged == near_dedup.registers(np.union1d(one, two))).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    parts = found.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("node").alias("d"))
    assert {(r.component, r.n, r.d) for r in parts.collect()} == {(1, 60, 60), (100, 60, 60)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
