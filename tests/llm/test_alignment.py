"""Token alignment against a naive version over whole texts."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpulse.llm import alignment
from gridpulse.llm.queries import op11_token_alignment
from tests.llm.conftest import CLASHING

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = {c: i for i, c in enumerate(
    [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)]
) if c}
BYTES |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in BYTES)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(libraries, text):
    """Groups of a whole text by the lengths of decoded tokens alone."""
    a, b = libraries
    if not text:
        return []
    raw = (" " + text).encode()
    sides = []
    for ids, pieces in (
        (lambda e: (e.ids, [bytes(BYTES[c] for c in t) for t in e.tokens]))(a.encode(" " + text, add_special_tokens=False)),
        (lambda ids: (ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                            else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))(b.encode(text)),
    ):
        if b"".join(pieces) != raw:
            return []
        ends, at = [], 0
        for piece in pieces:
            at += len(piece)
            ends.append(at)
        sides.append(list(zip(ids, ends)))
    groups, common = [], {e for _, e in sides[0]} & {e for _, e in sides[1]}
    last = 0
    for end in sorted(common):
        groups.append(tuple([i for i, e in side if last < e <= end] for side in sides))
        last = end
    return groups


def brute(libraries, rows):
    groups = [whole(libraries, text) for _, text, *_ in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return Counter(
        (
            row[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
            sum(n for (x, y), n in found.items() if count[x, y] == most[x]),
            sum(n * count[pair] for pair, n in found.items()),
            ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g),
        )
        for row, g, found in zip(rows, groups, links)
    )


ODD = [
    "plain words, and more words", "  two  spaces\tand\n tabs  x", "trailing  ", " ", "\n", "naïve café 日本語 🎉🎉x",
    "ﬁ é ▁ literal", "▁", "<|endoftext|> and <s> <unk> </s> <0x41>", "It's we'll 12345 x1y2", "\x00\x1c\x85 a\x1f b",
    "　wide   space", "🏳️‍🌈 family 👨‍👩‍👧", "don't\n\n  stop " * 40, "ḀΩж",
]
ROWS = [
    *[(i, text) for i, text in enumerate(ODD)], (50, None), (51, ""), (None, "no name"),
    *[(60, "the same row the same")] * 3, (61, "long word " * 4000), (62, "x" * 5000),
]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 40])
def test_alignment_equals_brute_force(docs, libraries, block):
    """Small blocks share pairs, so counts must come from all of them."""
    out = alignment.aligned(docs(ROWS, CLASHING), A, B, block).collect()
    assert Counter(map(tuple, out)) == brute(libraries, ROWS)


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.é日🎉ab1▁ \x1c"), st.characters(codec="utf-8")), max_size=40))
def test_units_join_to_the_whole(libraries, text):
    work = alignment.aligner(A, B)
    assert work.by_units
    (own,) = work.numbers([text])
    groups = whole(libraries, text)
    assert ";".join(work.groups().of(own).texts()) == ";".join(
        ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups
    )


def test_offsets_refined_inside_characters(libraries):
    a, _ = libraries
    text = " é🎉日ḀΩж"
    found = a.encode(text, add_special_tokens=False)
    decoded = [bytes(BYTES[c] for c in t) for t in found.tokens]
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = alignment.cuts(found.offsets, np.array([len(d) for d in decoded]), raw)
    assert ends.tolist() == [sum(map(len, decoded[: i + 1])) for i in range(len(decoded))]


def test_forgetting_units_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_UNITS", 8)
    work = alignment.Aligner(A, B)
    for text in [t for t in ODD if t] * 2:
        own = work.numbers([text])
        groups = whole(libraries, text)
        expected = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert ";".join(work.groups().of(own[0]).texts()) == expected
        work.keep_frequent(own)
        assert work.met <= 8


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    assert alignment._large(alignment._small(np.array(values, np.int64))).tolist() == values


def test_empty_table(docs):
    assert alignment.aligned(docs([]), A, B).collect() == []


def test_query_equals_brute_force(spark, libraries):
    import hashlib

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = Counter()
    for row, n in brute(libraries, rows).items():
        expected[(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")] += n
    assert Counter(map(tuple, op11_token_alignment(spark, folder).collect())) == expected
