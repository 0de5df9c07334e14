"""Repeated passages: confirm recurring windows, compile automata, locate every occurrence.

1. Every text is winnowed: of the phrases of ``PHRASE`` words inside each window of
   ``window`` words, the one with the smallest hash is an anchor. Texts that share a window
   share its anchor, and only about one phrase in fifteen is one.
2. Windows whose anchor occurs in two different texts are hashed and counted; a window in
   two documents is confirmed, the smallest of them is its home. Runs of confirmed windows
   at home are passages, cut into pieces of bounded length.
3. Pieces are dealt to shards of bounded size. The windows of a shard's pieces form one
   Aho-Corasick automaton, spelled in numbered phrases of words; of the documents that share a window with one
   of its homes, the runs of shared windows stream through it, since no hit lies outside
   them. Every hit is an occurrence of a whole window, so a document of n words has at most
   n hits in a shard, however many passages resemble each other.
   Words themselves are compared, so a hash collision cannot remove a word.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import spans
from gridpulse.llm.scratch import stored

PHRASE = 20
SHARD_WINDOWS = 4000
STEP = 10  # words of the phrases that windows are spelled in, at most
WORDS_A_SALT = 500_000  # streaming past one copy of an automaton


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values, by runs of doubled length."""
    least, size = values, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:])


def anchors_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor (a phrase's hash) of each window of one text's words."""
    if len(hashes) < window:
        return np.zeros(0, spans.U64)
    size = min(PHRASE, window)
    return _smallest(spans.rolling(hashes, size), window - size + 1)


def _squeezed(data: np.ndarray, found: spans.Words, i: int) -> bytes:
    """The words of text i joined by one space."""
    lo, hi = found.first[i], found.first[i + 1]
    if lo == hi:
        return b""
    begin, end = found.starts[lo], found.ends[hi - 1]
    part = data[begin:end]
    keep = spans.WORD_BYTE[part]
    keep[found.ends[lo : hi - 1] - begin] = True  # one separator after each word
    out = part[keep]
    out[~spans.WORD_BYTE[out]] = 0x20
    return out.tobytes()


def scanned(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, two keys of the word sequence, anchors, digest of the joined words."""

    def run(batches):
        for batch in batches:
            counts, one, two, anchors, digests = [], [], [], [], []
            for _, data, offsets in spans.chunks(batch.column(1)):
                found = spans.words(data, offsets)
                hashes = found.hashes()
                for i, n in enumerate(found.counts().tolist()):
                    own = hashes[found.first[i] : found.first[i + 1]]
                    whole = np.array([0]), np.array([n])
                    counts.append(n)
                    one.append(int(spans.signed(spans.span_hashes(own, *whole))[0]) if n else 0)
                    two.append(int(spans.signed(spans.span_hashes(spans.mix(own), *whole))[0]) if n else 0)
                    chosen = anchors_of(own, window)
                    anchors.append(spans.signed(np.unique(chosen)) if len(chosen) else None)
                    digests.append(hashlib.sha256(_squeezed(data, found, i)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(anchors, pa.list_(pa.int64())),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_words", "key1", "key2", "anchors", "words_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, key1 long, key2 long, anchors array<long>, words_sha256 string",
    )


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(hash, doc_id, start) of every window whose anchor is among the row's ``anchors``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            wanted = batch.column(2)
            for row, data, offsets in spans.chunks(batch.column(1)):
                found = spans.words(data, offsets)
                hashes = found.hashes()
                values, owners, at = [], [], []
                for i in range(len(offsets) - 1):
                    own = hashes[found.first[i] : found.first[i + 1]]
                    recurring = np.array(wanted[row + i].values, np.int64).view(spans.U64)
                    starts = np.flatnonzero(np.isin(anchors_of(own, window), recurring))
                    values.append(spans.signed(spans.rolling(own, window)[starts]))
                    owners.append(np.full(len(starts), ids[row + i], np.int64))
                    at.append(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(part)) for part in (values, owners, at)],
                    names=["window", "doc_id", "start"],
                )

    return texts.select("doc_id", "text", "anchors").mapInArrow(
        run, "window long, doc_id long, start int"
    )


def _runs(sorted_positions: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive positions as (first, last)."""
    breaks = np.flatnonzero(np.diff(sorted_positions) != 1) + 1
    parts = np.split(sorted_positions, breaks)
    return [(int(p[0]), int(p[-1])) for p in parts if len(p)]


class _Shard:
    """The windows of a shard's passages in an automaton, and its numbers of phrases.

    A window of 50 words is spelled by the five phrases of ten words it consists of, so its
    path has five nodes; a text is read once from each of its first ten words on. Phrases are
    told apart by their words.
    """

    def __init__(self, window: int):
        self.window, self.ready = window, False
        self.step = max(d for d in range(1, min(STEP, window) + 1) if window % d == 0)
        self.number: dict[tuple[str, ...], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def _phrases(self, words: list[str]) -> list[tuple[str, ...]]:
        step = self.step
        return [tuple(words[i : i + step]) for i in range(len(words) - step + 1)]

    def add(self, home: int, words: list[str]) -> None:
        number = self.number
        values = tuple([number.setdefault(p, len(number) + 1) for p in self._phrases(words)])
        for at in range(len(words) - self.window + 1):
            self.automaton.add_word(values[at : at + self.window : self.step], home)

    def locate(self, doc_id: int, words: list[str]) -> list[tuple[int, int]]:
        """Word ranges of a run that repeat windows at home in smaller documents."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        get, step = self.number.get, self.step
        values = tuple([get(p, 0) for p in self._phrases(words)])
        ends = np.sort(np.array(
            [
                begin + (e + 1) * step - 1
                for begin in range(min(step, len(values)))
                for e, home in self.automaton.iter(values[begin::step])
                if home < doc_id
            ],
            np.int64,
        ))
        out: list[tuple[int, int]] = []
        for first, last in _runs(ends):
            first -= self.window - 1
            if out and first <= out[-1][1]:
                first = out.pop()[0]
            out.append((first, last + 1))
        return out


def _split(text: str | None) -> list[str]:
    """Words between space and \\t..\\r only (``str.split`` knows more separators)."""
    return [w for w in (text or "").translate(_BLANKS).split(" ") if w]


_BLANKS = {code: " " for code in range(0x09, 0x0E)}


def _pieces(homes: DataFrame, window: int) -> DataFrame:
    """(doc_id, home, piece, first, windows, text): runs of windows, cut at a bounded length.

    From rows (doc_id, text, shared), where ``shared`` holds the starts of the document's
    windows by home; ``first`` is the position of the piece's first word.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, shared in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = _split(text)
                for entry in shared:
                    piece = 0
                    for first, last in _runs(np.unique(np.array(entry["starts"], np.int64))):
                        for at in range(first, last + 1, SHARD_WINDOWS):
                            upto = min(at + SHARD_WINDOWS, last + 1)
                            part = " ".join(words[at : upto + window - 1])
                            out.append((doc_id, entry["home"], piece, at, upto - at, part))
                            piece += 1
            columns = list(zip(*out)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "home", "piece", "first", "windows", "text"],
            )

    return homes.select("doc_id", "text", "shared").mapInArrow(
        run, "doc_id long, home long, piece int, first int, windows long, text string"
    )


def _occurrences(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, last) from rows (shard, salt, role, doc_id, first, text).

    In a group passages (role 0) come first; runs of texts (role 1) stream past the automaton.
    """

    def run(batches):
        at, shard = None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, (number, salt, role, doc_id, begin) in enumerate(zip(*columns)):
                if at != (number, salt):
                    at, shard = (number, salt), _Shard(window)
                words = _split(batch.column(5)[i].as_py())
                if role == 0:
                    shard.add(doc_id, words)
                else:
                    out += [(doc_id, begin + lo, begin + hi) for lo, hi in shard.locate(doc_id, words)]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))],
                names=["doc_id", "first", "last"],
            )

    return (
        rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role", "doc_id")
        .select("shard", "salt", "role", "doc_id", "first", "text")
        .mapInArrow(run, "doc_id long, first int, last int")
    )


def repeated(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Scan table of all rows, and the texts to cut with the word ranges to remove.

    First result: one row per row of ``docs`` with doc_id, n_words, words_sha256 (of the
    words joined by one space) and ``whole``: the document has at least ``window`` words and
    repeats one with a smaller doc_id word by word, so all its words go.

    Second result: doc_id, text and ``ranges`` (array of word ranges [first, last), sorted;
    they may overlap) of the other documents that repeat a window of ``window`` words of a
    document with a smaller doc_id. Null and empty texts have no words. Equal rows are one
    document. Rows without a doc_id, and rows whose doc_id stands at different texts, have
    no place in the order: they lose no words and make no others lose any. Further columns
    are ignored; an empty table gives empty results.
    """
    scan = stored(scanned(docs, window), "scanned")
    single = (
        scan.filter("doc_id is not null").groupBy("doc_id")
        .agg(F.min("key1").alias("x"), F.max("key1").alias("y")).filter("x = y").select("doc_id")
    )
    long = scan.filter(F.col("n_words") >= window).join(single, "doc_id", "left_semi")
    first = long.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    whole = (
        long.join(first, ["key1", "key2"]).filter("rep < doc_id").select("doc_id").distinct()
        .withColumn("whole", F.lit(True))
    )
    scan_out = scan.select("doc_id", "n_words", "words_sha256").join(whole, "doc_id", "left")
    scan_out = scan_out.withColumn("whole", F.coalesce("whole", F.lit(False)))
    exploded = long.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        "doc_id", F.explode("anchors").alias("anchor")
    )
    recurring = (
        exploded.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        .filter("x < y").select("anchor")
    )
    candidates = (
        exploded.join(recurring, "anchor").groupBy("doc_id")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    keyed = docs.filter("doc_id is not null").select("doc_id", "text")
    texts = stored(keyed.join(candidates, "doc_id").dropDuplicates(["doc_id"]), "texts")
    windows = stored(_windows(texts, window), "windows")
    homes = windows.groupBy("window").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("y"))
    homes = homes.filter("home < y").select("window", "home")
    shared = (
        windows.join(homes, "window").groupBy("doc_id", "home").agg(F.collect_list("start").alias("starts"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("home", "starts")).alias("shared"))
    )
    pieces = stored(_pieces(shared.join(texts, "doc_id"), window), "pieces")
    at_home, away = pieces.filter("doc_id = home"), pieces.filter("doc_id > home")
    shards = max(1, -(-(at_home.agg(F.sum("windows")).first()[0] or 0) // SHARD_WINDOWS))
    shard = F.pmod(F.xxhash64("home", "piece"), F.lit(shards)).cast("int").alias("shard")
    dealt = at_home.select("home", shard, "text")
    # Routes are narrow rows: a home that very many documents share is joined without texts.
    routes = away.select("doc_id", "home", "piece", "windows").join(
        dealt.select("home", "shard").distinct(), "home"
    )
    salts = routes.groupBy("shard").agg(
        F.ceil(F.sum(F.col("windows") + (window - 1)) / WORDS_A_SALT).cast("int").alias("salts")
    )
    streams = (
        routes.drop("windows").join(salts, "shard").join(away.drop("windows"), ["doc_id", "home", "piece"]).select(
            "shard",
            F.pmod(F.xxhash64("doc_id", "home", "piece"), F.col("salts").cast("long")).cast("int").alias("salt"),
            F.lit(1).alias("role"),
            "doc_id",
            "first",
            "text",
        )
    )
    passages = dealt.join(salts, "shard").select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("role"),
        F.col("home").alias("doc_id"),
        F.lit(0).alias("first"),
        "text",
    )
    rows = streams.unionByName(passages)
    ranges = (
        stored(_occurrences(rows, window), "occurrences").groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    )
    return scan_out, ranges.join(texts.select("doc_id", "text"), "doc_id")


def _cut(repeats: DataFrame, digest: bool) -> DataFrame:
    """doc_id, n_removed and the kept text (or its digest) of documents with ranges."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _split(text)
                gone = np.zeros(len(words), bool)
                for span in cut:
                    gone[span["first"] : span["last"]] = True
                left = " ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(left.encode()).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_removed", "kept"],
            )

    return repeats.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_removed long, kept string"
    )


def removal_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``; see ``repeated``."""
    scan, repeats = repeated(docs, window)
    cut = _cut(repeats, digest=True)
    whole = F.col("whole")
    return scan.join(cut, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept", "words_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with repeated words gone from ``text`` (kept words joined by one space).

    All columns and rows stay; texts that lose nothing stay as they are, ``n_chars`` (if
    there) follows the text. See ``repeated`` for nulls, ties and repeated rows.
    """
    scan, repeats = repeated(docs, window)
    cut = _cut(repeats, digest=False)
    whole = scan.filter("whole").select("doc_id", F.lit("").alias("kept")).distinct()
    changed = cut.select("doc_id", "kept").unionAll(whole)
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(changed, "doc_id", "left")
    text = F.coalesce("kept", "row.text")
    values = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("kept").isNull(), values["n_chars"]).otherwise(size)
    return rows.select(*[value.alias(c) for c, value in values.items()])
