import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridpulse.llm import fingerprints as fp
from tests.llm.conftest import CLASHING

TEXT = st.text(alphabet="abé😀", max_size=80)


@given(TEXT, TEXT)
def test_extensions_and_spans(one, two):
    a, b = fp.PrefixHashes(one), fp.PrefixHashes(two)
    for i in range(0, len(one), 7):
        for j in range(0, len(two), 5):
            n = 0
            while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
                n += 1
            assert a.common_extension(i, b, j) == n
    assert (a.fingerprint() == b.fingerprint()) == (one == two)


@given(TEXT, TEXT, TEXT)
def test_likeness_is_a_lower_bound(head, x, y):
    one, two = head + x, head + y
    near = fp.likeness(fp.PrefixHashes(one).fingerprint(), fp.PrefixHashes(two).fingerprint())
    assert 0 <= near <= 1 and (near == 1) == (one == two)
    if one != two:
        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n
        both = common(one, two) + common(one[::-1], two[::-1])
        assert near <= both / max(len(one), len(two)) + 1e-9


@pytest.mark.parametrize("rows_a_range", [1, 3, 4000])
def test_edits_follow_descending_ids(spark, docs, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", rows_a_range)
    texts = {i * 7: "abcdé"[: i % 5 + 1] * (i * 3 % 40) + str(i) for i in range(25)}
    texts[3], texts[500] = "", None
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fp.fingerprinted(docs(list(texts.items()), CLASHING)).collect()}
    assert set(got) == set(texts)
    prints = {d: fp.PrefixHashes(t or "").fingerprint() for d, t in texts.items()}
    for at, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(at + 1) % len(order)]] or ""
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == prints[d] and r.edited_fingerprint == fp.PrefixHashes(new).fingerprint()
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.likeness(r.fingerprint, prints[order[(at + 1) % len(order)]])


def test_edge_rows(spark, docs):
    one = fp.fingerprinted(docs([(1, "abcdef")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "aaa"), (1, "bbb"), (1, "bbb"), (None, "ccc"), (None, None)]
    assert len(fp.fingerprinted(docs(rows)).collect()) == 5
    assert fp.fingerprinted(docs([(None, "ab"), (None, "cd")])).count() == 2
    assert fp.fingerprinted(docs(rows).limit(0)).count() == 0


def test_likeness_sees_what_lies_between_edits():
    random.seed(4)

    def prose(n):
        return " ".join("".join(random.choices("aeioustrnél", k=random.randint(2, 9))) for _ in range(n))

    def near(one, two):
        return fp.likeness(fp.PrefixHashes(one).fingerprint(), fp.PrefixHashes(two).fingerprint())

    body = prose(1000)
    assert near("Old title\n" + body + "\nold footer", "A new and longer title\n" + body + "\nby another") > 0.95
    words = body.split(" ")
    spread = [w if i % 100 else "edited" for i, w in enumerate(words)]
    assert near(body, " ".join(spread)) > 0.85
    half = len(body) // 2
    assert near(body, body[half:] + body[:half]) > 0.95
    assert near(body, prose(1000)) < 0.05
    # No span counts more often than both texts have it, and a run without borders is no harm.
    assert near(body + body, "x" + body + "y") <= 0.51
    assert near("a" * 20000, "b" + "a" * 20000 + "c") < 1
