import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpulse.llm import bpe_codec, packing
from tests.llm.conftest import CLASHING

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
byte_library, word_library = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n\nb", "it's  \n\n x", "中文 text テスト", "a\xa0b c",
    "x <|endoftext|> y<|startoftext|>z", "<|ENDOFTEXT|>", "12½ ² Ⅷ", "ΣΑΣ Σ", "\x1ca\x1fb", "İstanbul ǅ ß ẞ", "é é",
    "aaaa" * 700, "_a_b--c__", "ª º", "ﬁ ①", "😀👍🏽", "x\x00y\x7f", "ÀÉ'S don'T I'LL", "​zero  wide",
]
SOME = st.text(alphabet=st.sampled_from("ab é'sS\n\t 12!<|>ßÀ中́"), max_size=40)


def same_as_library(text):
    ids = np.array(byte_library.encode(text, add_special_tokens=False).ids, "<u4")
    assert packing.text_encoder(BYTES).encode(text) == ids.tobytes()
    ids = word_library.encode(text, add_special_tokens=False).ids
    coded, decoded = bpe_codec.codec(WORDS).coded(text)
    assert coded == np.array(ids, "<u4").tobytes()
    assert decoded == word_library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    same_as_library(text)


@settings(max_examples=150)
@given(SOME)
def test_any_ids_equal_the_library(text):
    same_as_library(text)


@given(st.lists(st.integers(0, 3), max_size=40), st.dictionaries(
    st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(4, 6), max_size=20))
def test_segment_tree_merges_leftmost_lowest_rank(symbols, merges):
    pairs = {pair: (rank, merged) for rank, (pair, merged) in enumerate(sorted(merges.items()))}
    want = list(symbols)
    while True:
        ranked = [(pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs]
        if not ranked:
            break
        i = min(ranked)[1]
        want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
    assert bpe_codec.merged(symbols, pairs) == want


def test_codec_rows(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (98, None), (99, "a b"), (99, "a b")]
    got = bpe_codec.round_trip(docs(rows, CLASHING), WORDS, keep=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids = word_library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = word_library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_codec.round_trip(docs(rows).limit(0), WORDS).count() == 0


def test_packed_pieces_hold_every_id_once(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word", "thing", "é", "x\n"][j] for j in rng.integers(0, 4, n)))
            for i, n in enumerate([0, 1, 2047, 2048, 9000, *rng.integers(1, 1500, 120).tolist()])]
    rows += [(500, None), (501, "same"), (501, "same"), (None, "nameless")]
    got = packing.packed(docs(rows, CLASHING), BYTES, keep_ids=True).collect()
    ids = {d: [*byte_library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        values = np.frombuffer(r.ids, "<u4").tolist()
        assert len(values) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        assert values == ids[r.doc_id][r.start : r.start + r.length]
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, found in pieces.items():
        copies = 2 if doc_id == 501 else 1
        assert sorted(s for s, n in found for s in range(s, s + n)) == sorted(list(range(len(ids[doc_id]))) * copies)
    assert set(pieces) == set(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(r.length for r in got)
    assert 1 - total / (len(sequences) * packing.WINDOW) < 0.05
    assert packing.packed(docs(rows).limit(0), BYTES).count() == 0
