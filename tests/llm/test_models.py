import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridpulse.llm import language_id, quality, scratch
from gridpulse.llm.queries import op3_quality_classifier, op6_language_id
from tests.llm.conftest import CLASHING

DATA = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op6_language_id(spark, DATA).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    rows = [(i, f"the cat and dog number {i}", "en", None) for i in range(30)]
    rows += [(100 + i, f"der hund und die katze {i}", "de", None) for i in range(30)]
    model = language_id.fit([(r[1], r[2]) for r in rows])
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "der hund"), (4, "der hund"), (None, "the cat"), (5, "z" * 300_000)]
    found = language_id.identified(docs(odd, CLASHING), model).collect()
    got = sorted((r.doc_id or -1, r.lang_pred) for r in found if r.doc_id != 5)
    assert got == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert all(r.rejected and r.score == 0 for r in found if r.lang_pred == "und")
    kept = language_id.accepted(docs(odd, CLASHING), model)
    assert kept.columns == docs(odd, CLASHING).columns
    assert sorted(r.doc_id or -1 for r in kept.collect() if r.doc_id != 5) == [-1, 4, 4]
    nothing = language_id.identified(docs(odd), language_id.fit([])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identified(docs(odd).limit(0), model).count() == 0


def test_scores_follow_a_subword_by_subword_mean():
    model = language_id.fit([("abc abd", "x"), ("xyz xyw", "y")] * 10)
    text = "abc Éxy"
    padded = [32, *[b + 32 if 65 <= b <= 90 else b for b in text.encode()], 32]
    letters = [b if b != 32 else 32 for b in padded]
    buckets = []
    for n in (2, 3, 4):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            inner = gram[1:-1]
            if 32 in inner or (n == 2 and gram == [32, 32]):
                continue
            key = gram[0]
            chain = key
            for step in range(1, n):
                chain = (chain * 0x01000193 + gram[step]) % 2**32
            buckets.append(((chain ^ n) * 0x9E3779B1 % 2**32) >> 16)
    want = model.table[buckets].astype(float).mean(axis=0) + model.bias
    assert np.allclose(model.logits(pa.array([text]))[0], want, atol=1e-5)


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = op3_quality_classifier(spark, DATA).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    bad = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_quality_edges(spark, docs):
    rows = [("plain words here and there", 1), ("BUY!! NOW!! CHEAP!!", 0)] * 20
    model = quality.fit(rows)
    odd = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "BUY!! CHEAP!!"), (4, "a " * 200_000)]
    got = quality.scored(docs(odd, CLASHING), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1] == by[2] and by[3][0] == by[3][1] and by[3][0] > by[None][0]
    assert quality.scored(docs(odd).limit(0), model).count() == 0
    assert quality.fit([]).scores(pa.array(["a", None])).tolist() == [0.5, 0.5]
    kept = quality.accepted(docs(odd, CLASHING), model, 0.5)
    assert kept.columns == docs(odd, CLASHING).columns


def test_score_is_the_sparse_dot_product():
    model = quality.fit([("some Words 12 here!", 1), ("BAD!! BAD!!", 0)] * 5)
    for text in ("some Words, here! 12 ÉÉ", "one", "!!"):
        at, value = quality._sparse(text)
        want = 1 / (1 + np.exp(-(model.weights[at] @ value + model.bias)))
        assert abs(model.scores(pa.array([text]))[0] - want) < 1e-9


def test_language_sample_is_the_smallest_hashes(spark, docs, monkeypatch):
    """The sample does not depend on partitions, and no language has more than its bound."""
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANGUAGE", 7)
    rows = [(i, f"text {i}", "aa" if i % 3 else "bb") for i in range(400)]
    rows += [(1000, "x", "cc"), (1000, "x", "cc"), (None, "y", "cc"), (1001, None, "cc"), (1002, "z", None)]
    want = []
    for lang in ("aa", "bb"):
        of = docs(rows).filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id")).limit(7)
        want += [(r.text, r.lang) for r in of.collect()]
    want += [("x", "cc"), ("x", "cc")]
    for parts in (1, 9):
        got = language_id.training_rows(docs(rows).repartition(parts), F.lit(True))
        assert sorted(got) == sorted(want)
    assert language_id.training_rows(docs(rows).limit(0), F.lit(True)) == []


def test_freed_memory_goes_back_to_the_system():
    def held():
        with open("/proc/self/smaps_rollup") as rollup:
            return next(int(line.split()[1]) for line in rollup if line.startswith("Pss_Anon"))

    parts = [bytes(10_000) for _ in range(20_000)]
    parts = parts[::100]  # what stays lies between what is freed
    before = held()
    scratch.give_back()
    assert before - held() > 100_000 and len(parts) == 200
