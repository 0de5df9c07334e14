import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from gridpulse.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c 中", max_size=30)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    got = []
    for _, data, offsets in spans.chunks(pa.array(texts, pa.string())):
        found = spans.words(data, offsets)
        for i in range(len(offsets) - 1):
            own = range(found.first[i], found.first[i + 1])
            got.append([bytes(data[found.starts[k] : found.ends[k]]).decode() for k in own])
    assert got == [WORD.findall(t or "") for t in texts]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5))
def test_rolling_hashes_tell_windows_apart(values, k):
    hashes = spans.rolling(np.array(values, np.uint64), k)
    windows = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(hashes) == len(windows)
    assert len(set(hashes.tolist())) == len(set(windows))


def test_texts_longer_than_a_chunk_stay_whole():
    long = "ab " * spans.CHUNK_BYTES
    parts = list(spans.chunks(pa.array(["x y", long, None, "z"], pa.string())))
    assert sum(len(o) - 1 for _, _, o in parts) == 4
    counts = np.concatenate([spans.words(d, o).counts() for _, d, o in parts])
    assert counts.tolist() == [2, spans.CHUNK_BYTES, 0, 1]
