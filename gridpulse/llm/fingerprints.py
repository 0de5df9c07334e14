"""Document fingerprints from prefix polynomial hashes.

The hash of a text's first i characters, modulo two primes, is kept for every i; a span's
hash follows from two of them, so any two spans compare in constant time and the longest
common extension of two positions is found by binary search. A fingerprint samples these
arrays: the hashes of the prefixes and of the suffixes whose lengths lie on a geometric
grid, with the length and the hash of the whole, and the hashes and lengths of the spans
between borders that the text itself sets. Two fingerprints tell by binary search how far
the texts agree from the start and from the end, and by equal spans what they share between,
wherever it stands.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1350490027)
STEPS_A_DOUBLING = 4
DIGITS = 6  # hex digits of a sampled hash
LENGTH_DIGITS = 3  # hex digits of a span's length; longer spans are cut
WINDOW = 8  # characters that decide on a border, a power of two
REACH = 16  # a border is the least window among so many on either side
SHORT = 160  # texts up to this length are told by their ends alone
ROWS_A_RANGE = 4000
MOST_RANGES = 1_000_000

GRID = sorted({int(2 ** (i / STEPS_A_DOUBLING)) for i in range(40 * STEPS_A_DOUBLING)})
_GRID = np.array(GRID)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling; the table grows as needed."""
    table = _tables.get(base)
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        factor = pow(base, len(table), prime)
        table = np.concatenate([table, table * np.uint64(factor) % np.uint64(prime)])
    _tables[base] = table
    return table[:n]


class PrefixHashes:
    """Prefix hashes of one text; positions and lengths count code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length, self.codes, self.made = len(codes), codes, None
        values = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base, prime in zip(BASES, PRIMES):
            sums = np.zeros(self.length + 1, np.uint64)
            np.cumsum(values * _powers(base, prime, self.length) % np.uint64(prime), out=sums[1:])
            self.sums.append(sums % np.uint64(prime))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, the same for equal spans wherever they stand."""
        parts = []
        for base, prime, sums in zip(BASES, PRIMES, self.sums):
            p = np.uint64(prime)
            back = _powers(pow(base, -1, prime), prime, self.length + 1)[starts]
            parts.append((sums[ends] + p - sums[starts]) % p * back % p)
        return parts[0] << np.uint64(31) | parts[1]

    def equal(self, at: int, other: PrefixHashes, other_at: int, length: int) -> bool:
        one = self.spans(np.array([at]), np.array([at + length]))
        return bool(one[0] == other.spans(np.array([other_at]), np.array([other_at + length]))[0])

    def common_extension(self, at: int, other: PrefixHashes, other_at: int) -> int:
        """Length of the longest equal spans that start at the two positions."""
        low, high = 0, min(self.length - at, other.length - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(at, other, other_at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def borders(self) -> np.ndarray:
        """0, the places where a window hashes lower than all within REACH, and the length.

        A border depends on nothing farther away than REACH and a window, so an edit moves
        the borders next to it only.
        """
        values = self.codes * np.uint32(0x9E3779B1)
        size, factor = 1, 0x85EBCA6B
        while size < WINDOW and len(values) > size:
            values = values[:-size] * np.uint32(factor) + values[size:]
            size, factor = 2 * size, factor * factor & 0xFFFFFFFF
        values = (values ^ values >> np.uint32(15)) * np.uint32(0xC2B2AE35)
        values = (values ^ values >> np.uint32(13)) >> np.uint32(1)  # below the filling
        fill = np.full(REACH, 0xFFFFFFFF, np.uint32)
        least, width = np.concatenate([fill, values, fill]), 1
        while 2 * width <= REACH:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = REACH - width
        least = np.minimum(least[: len(least) - rest], least[rest:])  # of REACH places each
        n = len(values)
        inner = np.flatnonzero((values < least[:n]) & (values < least[REACH + 1 : REACH + 1 + n]))
        most = 16**LENGTH_DIGITS - 1
        found = np.unique(np.concatenate([[0], inner, [self.length]]))
        if (np.diff(found) > most).any():
            cut = [np.arange(lo, hi, most) for lo, hi in zip(found[:-1], found[1:])]
            found = np.concatenate([*cut, found[-1:]])
        return found

    def fingerprint(self) -> str:
        """length:whole:prefixes:suffixes:spans, in hex; equal texts have equal fingerprints."""
        if self.made:
            return self.made
        n = self.length
        sizes = _GRID[: bisect_right(GRID, n)]
        zero = np.zeros(len(sizes) + 1, np.int64)
        prefixes = self.spans(zero, np.append(sizes, n))
        suffixes = self.spans(n - sizes, np.full(len(sizes), n))
        at = self.borders() if n > SHORT else np.zeros(1, np.int64)
        inner = self.spans(at[:-1], at[1:])
        sampled = np.concatenate([prefixes[:-1], suffixes, inner]) * np.uint64(0x9E3779B97F4A7C15)
        sampled = (sampled >> np.uint64(64 - 4 * DIGITS)).tolist()
        digits = [f"{v:0{DIGITS}x}" for v in sampled]
        half = len(sizes)
        spans = [f"{d}{w:0{LENGTH_DIGITS}x}" for d, w in zip(digits[2 * half :], np.diff(at).tolist())]
        ends = f"{''.join(digits[:half])}:{''.join(digits[half : 2 * half])}"
        self.made = f"{n:x}:{int(prefixes[-1]):016x}:{ends}:{''.join(spans)}"
        return self.made


def _agreed(one: str, two: str) -> int:
    """Largest grid length up to which the sampled hashes agree."""
    low, high = 0, min(len(one), len(two)) // DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        at = slice((middle - 1) * DIGITS, middle * DIGITS)
        if one[at] == two[at]:
            low = middle
        else:
            high = middle - 1
    return GRID[low - 1] if low else 0


def _spans(digits: str, first: int, last: int) -> tuple[Counter, Counter]:
    """Lengths of the spans by hash and length: of all, and of those between two places."""
    every, between, at = Counter(), Counter(), 0
    for i in range(0, len(digits), DIGITS + LENGTH_DIGITS):
        span = digits[i : i + DIGITS + LENGTH_DIGITS]
        width = int(span[DIGITS:], 16)
        every[span] += width
        if at >= first and at + width <= last:
            between[span] += width
        at += width
    return every, between


def likeness(one: str, two: str) -> float:
    """Share of the longer text that equal spans of two fingerprints cover.

    Counted are what agrees from the start and from the end with the equal spans between, or
    all equal spans if those are more. 1 only for equal fingerprints. The shares are lower
    bounds: an end may be short by a grid step, and a span with an edit in it counts nothing.
    Texts of up to SHORT characters are compared by their ends alone.
    """
    if one == two:
        return 1.0
    a, b = one.split(":"), two.split(":")
    n, m = int(a[0], 16), int(b[0], 16)
    start, end = _agreed(a[2], b[2]), _agreed(a[3], b[3])
    same = start + end
    if a[4] and b[4] and same < min(n, m):
        every, between = _spans(a[4], start, n - end)
        others, beside = _spans(b[4], start, m - end)
        same = max(same + (between & beside).total(), (every & others).total())
    return min(same, min(n, m), max(n, m) - 1) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _ranges(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Smallest and largest doc_id of consecutive ranges of about ROWS_A_RANGE rows."""
    ids = docs.filter("doc_id is not null").select("doc_id")
    count = ids.count()
    ranges = min(MOST_RANGES, max(1, count // ROWS_A_RANGE))
    dealt = ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id())
    found = dealt.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    rows = sorted((r["lo"], r["hi"]) for r in found.collect())
    return [lo for lo, _ in rows], [hi for _, hi in rows]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_prefix (of text and edit, exact). Documents follow each other in
    descending doc_id, rows of one doc_id by text, rows without one come last; after the
    last comes the first. A null text counts as empty; a single row is its own next; equal
    rows are rows of their own. Further columns are ignored; no rows give no rows.

    Texts move once: ranges of consecutive ids are sorted in their own tasks, and the
    largest document of each range is also sent to the range above, whose smallest needs it.
    """
    lows, highs = _ranges(docs)
    lows_array, donors = np.array(lows, np.int64), dict(zip(highs, [*range(1, len(highs)), 0]))

    def deal(batches):
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(lows[0] if lows else 0).to_numpy(zero_copy_only=False)
            at = np.maximum(np.searchsorted(lows_array, known, "right") - 1, 0)
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), ids, texts], names=names
            )
            extra = [i for i, v in enumerate(ids.to_pylist()) if v in donors]
            if extra:
                take = pa.array(extra)
                to = pa.array([donors[ids[i].as_py()] for i in extra], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array([1] * len(extra), pa.int32()), ids.take(take), texts.take(take)], names=names
                )

    def run(batches):
        current, waiting, first = None, None, None

        def row(doc_id, text, own, following, next_print):
            new = edited(text, following)
            changed = PrefixHashes(new)
            one, two = own.fingerprint(), changed.fingerprint()
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            same = own.common_extension(0, changed, 0)
            return (
                doc_id, own.length, digest, one, two, likeness(one, two), likeness(one, next_print), same
            )

        def batch_of(out):
            columns = list(zip(*out)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                columns = [c.to_pylist() for c in batch.slice(at, 500).columns]
                for number, role, doc_id, text in zip(*columns):
                    if number != current:
                        if waiting:  # the last range without a donor: rows without doc_id only
                            out.append(row(*waiting, first[1], first[2].fingerprint()))
                        current, waiting, first = number, None, None
                    if waiting is None and role == 1:
                        continue
                    own = PrefixHashes(text)
                    if waiting:
                        out.append(row(*waiting, text, own.fingerprint()))
                    waiting = (doc_id, text, own) if role == 0 else None
                    first = first or waiting
                yield batch_of(out)
        if waiting:
            yield batch_of([row(*waiting, first[1], first[2].fingerprint())])

    names = ["range", "role", "doc_id", "text"]
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    )
    fields = [field.split()[0] for field in schema.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    dealt = docs.select("doc_id", "text").mapInArrow(deal, "range int, role int, doc_id long, text string")
    return (
        dealt.repartition("range")
        .sortWithinPartitions("range", "role", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(run, schema)
    )
