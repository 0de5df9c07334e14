import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, differences
from gridpulse.llm import language_id
from gridpulse.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm import test_near_dedup, test_substring_dedup

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, name):
    small = "/root/testdata/sf0.001"
    assert differences(spark, connect(small), small, name, LLM_QUERIES, LLM_ORACLES) is None


def test_stages_equal_brute_force(spark):
    import pyarrow as pa

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts
        kept = corpus_pipeline.stored(stage(spark, kept, DATA), name)
        assert kept.columns == columns
        texts = {r.doc_id: r.text for r in kept.collect()}
        ids = sorted(before)
        if name == "language_id":
            model = language_id.fit(language_id.training_rows(docs, corpus_pipeline.F.lit(True)))
            sure = model.probabilities(model.logits(pa.array([before[i] for i in ids]))).max(axis=1)
            want = {i: before[i] for i, s in zip(ids, sure) if s >= model.threshold}
            assert texts == want and len(texts) > 0.99 * len(before)
        elif name == "quality":
            assert set(texts) < set(before) and all(texts[i] == before[i] for i in texts)
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert np.mean([i in texts for i in before if labels.get(i) == 0]) < 0.2
            clean = [i for i in before if labels.get(i) == 1]
            assert np.mean([i in texts for i in clean]) > 0.99
        elif name == "near_dedup":
            groups = test_near_dedup.brute(list(before.items()), 5)
            assert set(texts) == {i for i, (_, root) in groups.items() if root == i}
        elif name == "substring_dedup":
            want = test_substring_dedup.brute(list(before.items()), 50)
            assert texts == {i: (w[3] if w[1] else before[i]) for i, w in want.items()}
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(pieces[doc_id]):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


def test_last_stage_hands_out_sequences(spark, docs):
    rows = [(i, f"words of document {i} " * (i % 40)) for i in range(60)]
    windows = defaultdict(dict)
    for r in corpus_pipeline.packing_stage(spark, docs(rows), DATA).collect():
        windows[r.sequence_id][r.offset] = r
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = defaultdict(list)
    for pieces in windows.values():
        sequence = b"".join(pieces[at].ids for at in sorted(pieces))
        for at, r in pieces.items():
            parts[r.doc_id].append((r.start, sequence[4 * at : 4 * (at + r.length)]))
    for doc_id, text in rows:
        want = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(piece for _, piece in sorted(parts[doc_id])) == want
