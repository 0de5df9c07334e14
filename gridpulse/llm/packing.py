"""Token windows of fixed length by bounded-space online best-fit packing.

Each partition keeps at most ``OPEN`` windows open. A document's whole windows go out at
once, its rest is placed into the open window it fits best. When it fits none and no window
may be opened, the fullest goes out: a gap of ``LEAST_PIECE`` tokens or more is first filled
by cutting the arriving piece. Windows still open at the end of a partition are merged by
groups of partitions, whose last gaps are closed by cutting too.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridpulse.llm.scratch import stored

WINDOW = 2048
OPEN = 32
LEAST_PIECE = 64
CACHED_UNITS = 100_000

# Pre-token pattern of the byte-level vocabulary: a fixed value.
_PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_NOT_LATIN = re.compile("[^\x00-\u024f]")


class _Units(dict):
    """Ids of units with what leads them, as bytes; filled on demand."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(self.lead + unit)
        if len(unit) <= 32:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class TextEncoder:
    """Ids of texts as the tokenizers library gives them, with a bounded cache of units.

    A space before a non-space always starts a pre-token, so the units between single
    spaces are encoded on their own and looked up. Unseen units in Latin letters go through
    a second encoder of the same vocabulary, which has less to do per call; others, and
    whole texts with a special token, with white space after a space or with a trailing
    space, go to the library itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {_bytes_of(token): number for token, number in self.tokenizer.get_vocab(False).items()}
        quick = tiktoken.Encoding(
            "units", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={}
        )
        self.quick = quick._core_bpe.encode_ordinary
        self.heads, self.units = _Units(self._unit, ""), _Units(self._unit, " ")

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, text: str) -> bytes:
        if _NOT_LATIN.search(text):
            return self.library(text)
        return array("I", self.quick(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(token in text for token in self.special):
            return self.library(text)
        head, *rest = text.split(" ")
        return self.heads[head] + b"".join(map(self.units.__getitem__, rest))


def _bytes_of(token: str) -> bytes:
    return bytes(_BYTE_OF[c] for c in token)


# Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}

_encoders: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


class OpenWindows:
    """The open windows of one partition, and the rows of finished ones."""

    def __init__(self, base: int):
        self.base, self.used = base, 0
        self.gaps: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _finish(self, window: int) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in self.held.pop(window):
            n = len(ids) // 4
            self.rows.append(
                (doc_id, start, n, zlib.crc32(ids), doc_tokens, self.base + window, offset, False, ids)
            )
            offset += n

    def _put(self, at: int, piece: tuple) -> None:
        free, window = self.gaps.pop(at)
        self.held[window].append(piece)
        free -= len(piece[2]) // 4
        if free:
            insort(self.gaps, (free, window))
        else:
            self._finish(window)

    def _open(self, piece: tuple) -> None:
        window, self.used = self.used, self.used + 1
        self.held[window] = []
        self.gaps.append((WINDOW, window))
        self.gaps.sort()
        self._put(len(self.gaps) - 1, piece)

    def place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= WINDOW:
                self._open((doc_id, start, ids[: 4 * WINDOW], doc_tokens))
                start, ids = start + WINDOW, ids[4 * WINDOW :]
                continue
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                self._put(at, (doc_id, start, ids, doc_tokens))
                return
            if len(self.gaps) < OPEN:
                self._open((doc_id, start, ids, doc_tokens))
                return
            free, window = self.gaps[0]
            if free >= LEAST_PIECE:
                self._put(0, (doc_id, start, ids[: 4 * free], doc_tokens))
                start, ids = start + free, ids[4 * free :]
            else:
                self.gaps.pop(0)
                self._finish(window)

    def leftovers(self) -> None:
        """Hand out the pieces of open windows as they are, marked open."""
        for window in sorted(self.held):
            for doc_id, start, ids, doc_tokens in self.held[window]:
                self.rows.append((doc_id, start, len(ids) // 4, None, doc_tokens, None, None, True, ids))
        self.held, self.gaps = {}, []

    def flush(self) -> None:
        """Close open windows: the emptiest are cut up to fill the fullest; one gap remains."""
        while len(self.gaps) > 1:
            free, window = self.gaps.pop()
            for doc_id, start, ids, doc_tokens in self.held.pop(window):
                while ids and self.gaps:
                    room = 4 * self.gaps[0][0]
                    self._put(0, (doc_id, start, ids[:room], doc_tokens))
                    start, ids = start + room // 4, ids[room:]
                if ids:
                    self._open((doc_id, start, ids, doc_tokens))
        for _, window in self.gaps:
            self._finish(window)
        self.gaps = []


_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("open", pa.bool_()), ("ids", pa.binary()),
]
_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, open boolean, ids binary"
)


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    if not keep_ids:
        rows = [r if r[7] else r[:8] + (None,) for r in rows]
    columns = list(zip(*rows)) or [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS]
    )


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is encoded whole with the vocabulary file (null text: empty) and
    followed by ``end_id``; each id lies in exactly one piece, pieces of a sequence add up
    to at most ``WINDOW`` ids. Equal rows are packed once each, a null doc_id stays null.
    With ``keep_ids`` the column ``ids`` holds little-endian 32-bit ids. Further columns are
    ignored; no rows give no pieces.
    """

    def pack(batches: Iterator[pa.RecordBatch]):
        end = np.array([end_id], "<u4").tobytes()
        windows = OpenWindows(TaskContext.get().partitionId() << 33)
        encode = text_encoder(vocabulary).encode
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(at, 500).to_pylist()
                for doc_id, text in zip(ids_of[at : at + 500], texts):
                    ids = encode(text or "") + end
                    windows.place(doc_id, 0, ids, len(ids) // 4)
                yield _batch(windows.rows, keep_ids)
                windows.rows = []
        windows.leftovers()
        yield _batch(windows.rows, keep_ids)

    def merge(batches: Iterator[pa.RecordBatch]):
        group, windows = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for number, doc_id, start, doc_tokens, ids in zip(*columns):
                if number != group:
                    if windows:
                        windows.flush()
                        out += windows.rows
                    group, windows = number, OpenWindows((1 << 62) + (number << 33))
                windows.place(doc_id, start, ids, doc_tokens)
            if windows:
                out += windows.rows
                windows.rows = []
            yield _batch(out, keep_ids)
        if windows:
            windows.flush()
            yield _batch(windows.rows, keep_ids)

    pieces = docs.select("doc_id", "text").mapInArrow(pack, _SCHEMA)
    pieces = stored(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    left = pieces.filter("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    groups = isqrt(parts)
    merged = (
        left.select(F.pmod("part", F.lit(groups)).alias("g"), "doc_id", "start", "doc_tokens", "ids")
        .repartition("g").sortWithinPartitions("g", F.length("ids").desc(), "doc_id", "start")
        .mapInArrow(merge, _SCHEMA)
    )
    out = pieces.filter("not open").drop("part").unionByName(merged).drop("open")
    return out if keep_ids else out.drop("ids")
