"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Leaves hold, for each symbol, the rank of the pair it begins; every node the smallest rank
below it, the leftmost of equals. The root is the next merge. A merge changes three leaves,
each in as many steps as the tree is high, so a pre-token of n symbols takes O(n log n)
whatever its length. Normaliser, pre-tokens, vocabulary and merges come from the file.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

CACHED_WORDS = 250_000  # per generation; two are kept
_NONE = 1 << 62

# Texts of these characters need neither the library's normaliser nor its splitter.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ]*")
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\\sa-z0-9ß-öø-ɏ]+")


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges; ``pairs`` maps two symbols to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    mask = size - 1
    shift = size.bit_length() - 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        pair = pairs.get((symbols[i], symbols[i + 1]))
        if pair:
            tree[size + i] = pair[0] << shift | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def update(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while (best := tree[1]) != _NONE:
        i = best & mask
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[j]
        after[i] = k
        if j < n - 1:
            update(j, _NONE)
        if k < n:
            before[k] = i
            pair = pairs.get((symbols[i], symbols[k]))
            update(i, pair[0] << shift | i if pair else _NONE)
        else:
            update(i, _NONE)
        h = before[i]
        if h >= 0:
            pair = pairs.get((symbols[h], symbols[i]))
            update(h, pair[0] << shift | h if pair else _NONE)
    return [s for s in symbols if s >= 0]


class _Words(dict):
    """(ids as bytes, decoded text) of a pre-token; two generations bound the cache."""

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.old.get(word)
        if found is None:
            ids = self.codec.word_ids(word)
            found = array("I", ids).tobytes(), self.codec.decode(ids)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        self.vocabulary, self.end = vocabulary, model["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left], vocabulary[right]
            self.pairs.setdefault(pair, (rank, vocabulary[left + right]))
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.token = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")
        self.words = _Words(self)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, spelled in the vocabulary's byte letters."""
        letters = [*word[:-1], word[-1] + self.end]
        return merged([self.vocabulary[c] for c in letters], self.pairs)

    def decode(self, ids) -> str:
        """Tokens joined by a space, which is what a file without a decoder asks for."""
        return " ".join([self.token[i] for i in ids])

    def pretokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            words = _PLAIN_WORD.findall(text.lower())
            return words if text.isascii() else [_spelled(w) for w in words]
        normal = self.normalizer.normalize_str(text)
        return [word for word, _ in self.splitter.pre_tokenize_str(normal)]

    def coded(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit bytes, decoded text) of a whole text."""
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += map(self.words.__getitem__, self.pretokens(text[at : mark.start()]))
            number = self.special[mark.group()]
            parts.append((array("I", [number]).tobytes(), mark.group()))
            at = mark.end()
        parts += map(self.words.__getitem__, self.pretokens(text[at:]))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])


# Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: chr(b) for b in _PRINTABLE}
_LETTERS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _LETTERS)}


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file; its cache lives as long as the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, vocabulary: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``.

    Whole texts are encoded and decoded again; a null text counts as empty and gives no
    tokens. With ``keep`` the columns ``ids`` (array) and ``decoded`` follow. Equal rows give
    equal results, a null doc_id stays null, further columns are ignored.
    """

    def run(batches):
        work = codec(vocabulary).coded
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for text in part.column(1).to_pylist():
                    ids, decoded = work(text or "")
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    out.append(row + ((array("I", ids).tolist(), decoded) if keep else ()))
                columns = list(zip(*out))
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names=names
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep else ""
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)
