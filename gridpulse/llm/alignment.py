"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide link counts.

The character offsets of the first tokenizer and the spans of the second one's proto are
coarse cuts in the bytes of a text. Tokens that share a character, and byte-fallback pieces,
are refined with their decoded bytes. Where both have a cut, a group of tokens ends; the
tokens of a group are linked with each other.

Texts are handled in units: a space or line feed after a character that is no white space
starts a token in both vocabularies (checked when the files are loaded), so unseen units are
aligned many at a time and looked up again. Where a vocabulary does not promise that, a text is one unit.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text. A block writes the groups of
its distinct units, its distinct linked id pairs with the number of its documents that hold
them, and each document as unit numbers. Pair counts are one aggregate over all blocks, and
go back to the blocks that hold the pair. So what moves is one row per block and pair, not
per document and pair, and a task holds one block.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridpulse.llm.scratch import stored

BLOCK_BYTES = 8 << 20
CACHED_UNITS = 450_000  # kept from one block to the next
UNITS_AT_ONCE = 200
OUT_CHARACTERS = 8 << 20

_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
_ODD_SPACE = re.compile(r"\s[ \n]")
_SPACE = "▁"

# Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    sums, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


@dataclass
class Groups:
    """Aligned units: ids of both sides, tokens in each group, groups in each unit."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    units: np.ndarray

    @staticmethod
    def joined(parts: list[Groups]) -> Groups:
        names = ("a", "b", "in_a", "in_b", "units")
        none = np.zeros(0, np.int32)
        return Groups(*(np.concatenate([none, *(getattr(p, n) for p in parts)]) for n in names))

    def of(self, units: np.ndarray) -> Groups:
        """The groups of some units, in their order."""
        sizes = self.units[units]
        own = _places((np.cumsum(self.units) - self.units)[units], sizes)
        in_a, in_b = self.in_a[own], self.in_b[own]
        a = self.a[_places((np.cumsum(self.in_a) - self.in_a)[own], in_a)]
        return Groups(a, self.b[_places((np.cumsum(self.in_b) - self.in_b)[own], in_b)], in_a, in_b, sizes)

    def links(self) -> np.ndarray:
        """Linked id pairs as one number each, group after group."""
        group = np.repeat(np.arange(len(self.in_a)), self.in_a)
        times = self.in_b[group]
        return np.repeat(self.a.astype(np.int64), times) << 32 | self.b[_places((np.cumsum(self.in_b) - self.in_b)[group], times)]

    def many(self) -> np.ndarray:
        """(first tokens, second tokens, groups, links) of each unit."""
        counts = (self.in_a, self.in_b, np.ones(len(self.in_a), np.int64), self.in_a * self.in_b)
        return np.stack([_sums(c, self.units) for c in counts])

    def texts(self) -> list[str]:
        """Each unit as ``a1,a2|b1;a3|b2,b3``."""
        both = self.in_a + self.in_b
        start = np.cumsum(both) - both
        codes = np.zeros(int(both.sum()), np.int64)
        codes[_places(start, self.in_a)] = self.a
        codes[_places(start + self.in_a, self.in_b)] = self.b
        codes *= 4
        codes[start + self.in_a - 1] += 1
        codes[start + both - 1] += 2
        codes[(start + both - 1)[np.cumsum(self.units) - 1]] += 1
        if len(codes) and codes.max() >= len(_marked):
            known = len(_marked) // 4
            _marked.extend(f"{i}{mark}" for i in range(known, int(codes.max()) // 4 + 1) for mark in ",|;\n")
        return "".join(map(_marked.__getitem__, codes.tolist())).split("\n")[:-1]


_NONE = np.zeros(0, np.int64)
_marked: list[str] = []


def cuts(offsets: list[tuple[int, int]], sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens with character offsets end.

    A token whose last character goes on in the next token ends inside it: there the sizes
    of the decoded tokens count.
    """
    if len(raw) == offsets[-1][1]:  # every character is one byte
        return np.array([end for _, end in offsets])
    offsets = np.array(offsets)
    characters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
    return np.where(shared, np.cumsum(sizes), characters[offsets[:, 1]])


class Aligner:
    """Both tokenizers, and the units met so far."""

    def __init__(self, a_file: str, b_file: str):
        # Tasks share the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        added = {str(t.content) for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = t.encode() if t in added else bytes([_BYTE_OF[c] for c in t])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if own else p.replace(_SPACE, " ").encode()
            for p, own in zip(pieces, self.b_byte)
        ]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        with open(a_file, encoding="utf-8") as file:
            rules = json.load(file)
        first = rules["pre_tokenizer"] or {}
        self.by_units = (
            rules["normalizer"] is None and first.get("type") == "ByteLevel"
            and first.get("use_regex", True) and not first["add_prefix_space"]
            and all(t["special"] for t in rules["added_tokens"])
            and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        )
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: list[Groups] = []
        self.met, self.worth = 0, np.zeros(0)

    def keep_frequent(self, own: list[np.ndarray]) -> None:
        """After a block: beyond ``CACHED_UNITS``, the half that was met most often lately stays."""
        worth = np.bincount(np.concatenate([_NONE, *own]), minlength=self.met).astype(float)
        worth[: len(self.worth)] += self.worth / 2
        self.worth = worth
        if self.met <= CACHED_UNITS:
            return
        kept = np.sort(np.argpartition(worth, -(CACHED_UNITS // 2))[-(CACHED_UNITS // 2) :])
        moved = np.full(self.met, -1)
        moved[kept] = np.arange(len(kept))
        moved = moved.tolist()
        groups = self.groups().of(kept)
        number = {u: moved[k] for u, k in self.number.items() if k >= 0 and moved[k] >= 0}
        self.forget()
        self.number, self.parts, self.met, self.worth = number, [groups], len(kept), worth[kept]

    def groups(self) -> Groups:
        """All units met, by number."""
        self.parts = [Groups.joined(self.parts)]
        return self.parts[0]

    def _aligned(self, units: list[str]) -> Groups | None:
        """Groups of units that follow each other; None where the bytes differ."""
        if units[0][0] != " ":  # the second tokenizer adds a space
            made = self._aligned([" a", *units])
            return made and made.of(np.arange(1, len(units) + 1))
        text = "".join(units)
        raw = text.encode()
        encoding = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(text[1:], return_type="proto")
        a = encoding.ids
        b, ends = zip(*[(piece.id, piece.end) for piece in proto.pieces]) if proto.pieces else ((), ())
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_cuts = cuts(encoding.offsets, self.a_size[a], np.frombuffer(raw, np.uint8))
        # Spans leave out the space that the tokenizer adds in front; byte pieces share one.
        b_cuts = np.where(self.b_byte[b], np.cumsum(self.b_size[b]), np.array(ends) + 1)
        common = np.intersect1d(a_cuts, b_cuts, assume_unique=True)
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        last = np.searchsorted(common, unit_ends)
        if (common[np.minimum(last, len(common) - 1)] != unit_ends).any():
            raise ValueError("a token crosses the border of two units")
        in_a, in_b = (
            np.bincount(np.searchsorted(common, c), minlength=len(common)) for c in (a_cuts, b_cuts)
        )
        return Groups(*(x.astype(np.int32) for x in (a, b, in_a, in_b, np.diff(last, prepend=-1))))

    def _learn(self, keys: list[str]) -> None:
        """Number the units; -1 where the bytes differ."""
        made = self._aligned([k if k[:1] in (" ", "\n") else " " + k for k in keys])
        if made is not None:
            self.number.update(zip(keys, range(self.met, self.met + len(keys))))
            self.parts.append(made)
            self.met += len(keys)
        elif len(keys) == 1:
            self.number[keys[0]] = -1
        else:
            self._learn(keys[: len(keys) // 2])
            self._learn(keys[len(keys) // 2 :])

    def _keys(self, text: str | None) -> list[str]:
        """The units of a text, each without its space where no white space follows that."""
        if not text:
            return []
        spaced = " " + text
        if not self.by_units:
            return [spaced]
        if _ODD_SPACE.search(spaced):
            return [u[1:] if u[0] == " " and not u[1:2].isspace() else u for u in _BORDER.split(spaced)]
        return text.replace("\n", " \n").split(" ")

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unit numbers of each text behind an added space; none without tokens."""
        split = list(map(self._keys, texts))
        alone, joined = [], []
        for key in set().union(*split).difference(self.number):
            # White space at the end could run on into a next unit.
            closed = self.by_units and key and not key[-1].isspace()
            (joined if closed else alone).append(key)
        for key in alone:
            self._learn([key])
        for at in range(0, len(joined), UNITS_AT_ONCE):
            self._learn(joined[at : at + UNITS_AT_ONCE])
        out = []
        for text, keys in zip(texts, split):
            own = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
            if len(own) and own.min() < 0:
                # Some bytes differ in a unit: the whole text decides.
                if " " + text not in self.number:
                    self._learn([" " + text])
                own = np.array([self.number[" " + text]], np.int64)
                own = own[own >= 0]
            out.append(own)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The worker's aligner for two vocabulary files; its units live as long as the worker."""
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


def _small(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 byte plane by byte plane, packed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _large(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _block_rows(block: int, ids: list, own: list[np.ndarray], groups: Groups) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its units and pairs first, then its documents."""
    distinct, place = np.unique(np.concatenate([_NONE, *own]), return_inverse=True)
    groups = groups.of(distinct)
    many = groups.many()
    pairs, index = np.unique(groups.links(), return_inverse=True)
    first = np.cumsum(many[3]) - many[3]
    held = np.zeros(len(pairs), np.int64)
    ends = np.cumsum([len(o) for o in own])
    own = [place[end - len(o) : end] for end, o in zip(ends, own)]
    run, total = [], 0
    for n, numbers in enumerate(own):
        once = np.unique(numbers)
        at = _places(first[once], many[3][once])
        run.append(index[at] + n * len(pairs))
        total += len(at)
        if len(pairs) and (total > 1_000_000 or n + 1 == len(own)):
            held += np.bincount(np.unique(np.concatenate(run)) % len(pairs), minlength=len(pairs))
            run, total = [], 0
    packed = [_small(x) for x in (groups.a, groups.b, groups.in_a, groups.in_b, groups.units)]
    one = _written([(block, 0, None, None, None, packed, [], [])])
    for name, values in (("pairs", pairs), ("held", held)):
        whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))
        one = one.set_column(one.schema.get_field_index(name), name, whole)
    yield one
    for at in range(0, len(ids), 1000):
        part = zip(ids[at : at + 1000], own[at : at + 1000])
        yield _written([
            (block, 2, doc_id, many[:, o].sum(axis=1).tolist(), _small(o), None, None, None) for doc_id, o in part
        ])


_BLOCK_FIELDS = [
    ("block", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("many", pa.list_(pa.int64())),
    ("units", pa.binary()), ("groups", pa.list_(pa.binary())), ("pairs", pa.list_(pa.int64())),
    ("held", pa.list_(pa.int64())),
]
_BLOCK_SCHEMA = (
    "block long, role int, doc_id long, many array<long>, units binary, groups array<binary>, "
    "pairs array<long>, held array<long>"
)


def _written(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _BLOCK_FIELDS)], names=[n for n, _ in _BLOCK_FIELDS]
    )


def blocks(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of role 0 (a block: its units and pairs) and of role 2 (a document in it)."""

    def run(batches: Iterator[pa.RecordBatch]):
        work = aligner(a_file, b_file)
        block, ids, own, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 200):
                texts = batch.column(1).slice(at, 200).to_pylist()
                ids += all_ids[at : at + 200]
                own += work.numbers(texts)
                size += sum([len(t) for t in texts if t])
                if size >= block_bytes:
                    yield from _block_rows(block, ids, own, work.groups())
                    work.keep_frequent(own)
                    block, ids, own, size = block + 1, [], [], 0
        if ids:
            yield from _block_rows(block, ids, own, work.groups())
            work.keep_frequent(own)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK_SCHEMA)


_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)
_OUT_TYPES = [pa.int64()] * 7 + [pa.string()]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the counts of their links, from rows sorted by block and role."""

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*ready), _OUT_TYPES)],
            names=[field.split()[0] for field in _OUT.split(", ")],
        )

    block, ready, size = None, [], 0
    for batch in batches:
        numbers, roles = (batch.column(i).to_numpy() for i in (0, 1))
        cut = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(roles) != 0)) + 1
        for first, last in zip([0, *cut], [*cut, batch.num_rows]):
            if first == last:
                continue
            part = batch.slice(first, last - first)
            if block != numbers[first]:
                block, texts, entries = numbers[first], None, []
                groups = Groups(*map(_large, part.column("groups")[0].as_py()))
            elif roles[first] == 1:
                entries.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])
            else:
                if texts is None:
                    pairs, *values = (np.concatenate([_NONE, *x]) for x in (zip(*entries) if entries else [()] * 3))
                    order = np.argsort(pairs)
                    at = order[np.searchsorted(pairs, groups.links(), sorter=order)]
                    sums = [_sums(x[at], groups.many()[3]) for x in (values[1], values[0])]
                    texts = groups.texts()
                for doc_id, many, units in zip(*(part.column(n).to_pylist() for n in ("doc_id", "many", "units"))):
                    own = _large(units)
                    text = ";".join([texts[u] for u in own.tolist()])
                    ready.append((doc_id, *many, *(int(s[own].sum()) for s in sums), text))
                    size += len(text)
                    if size > OUT_CHARACTERS:
                        yield out()
                        ready, size = [], 0
    if ready:
        yield out()


def aligned(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``a_file`` is a byte-level vocabulary of the tokenizers library, which gets the text
    behind one space; ``b_file`` a sentencepiece model, which adds that space itself.
    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``. All tokens of a group are linked with
    each other. The count of an id pair is the number of rows that hold it linked:
    ``count_sum`` adds it up over a document's links, ``n_best`` says how many of them have
    the highest count of their first id (ties included).

    Null and empty texts, and texts that either vocabulary does not give back byte by byte,
    have no tokens: zeros and an empty ``groups``. Whole texts are aligned, however long.
    Equal rows count each, a null doc_id stays null, further columns are ignored, an empty
    table gives no rows.
    """
    dealt = stored(blocks(docs, a_file, b_file, block_bytes), "aligned")
    held = dealt.filter("role = 0").select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    held = held.select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counted = held.groupBy("pair").agg(F.sum("held").alias("count"))
    counted = counted.withColumn("a", F.shiftright("pair", 32))
    highest = counted.groupBy("a").agg(F.max("count").alias("most"))
    ranked = counted.join(highest, "a").select(
        "pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")
    )
    entries = held.select("block", "pair").join(ranked, "pair").withColumn("role", F.lit(1))
    rows = dealt.drop("pairs", "held").unionByName(entries, allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "role").mapInArrow(_joined, _OUT)
