"""Spelling variants: words one edit apart, and the common form each rare one follows.

A word is the vector of its length and its letter counts in ``GROUPS`` of letters. Words
stand in a trie by successive counts. One edit changes the vector by at most one surplus and
one deficit, so a depth-first search that may spend each once meets all near words in a few
leaves; words in a leaf are verified letter by letter. Of a pair only the word whose first
difference is the surplus searches, so each pair is found once.

The trie is dealt over tasks: a prefix of counts with at most ``WORDS_A_SHARD`` words is a
shard, longer prefixes are taken where one has more, and whole vectors with more are salted.
A word searches the shards whose prefix its budget reaches. All state is in tables; the
driver sees how many words still wait for a longer prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import spans
from gridpulse.llm.scratch import stored

GROUPS = ("e", "a", "t", "i", "o", "n", "r", "s", "h", "l", "d", "u", "cmf", "wypv", "bgkjqxz")
DEPTHS = (3, 6, 10, 17)  # lengths of the prefixes tried: the word's length, then counts
WORDS_A_SHARD = 8_000
COUNTED_WORDS = 150_000  # held by a task between partial counts
STATES = 50_000  # of the search expanded at once
CANDIDATES = 500_000  # verified at once
SLIP = 199

_RUN = re.compile("[a-zÀ-ÿ]+")
_DEPTH = len(GROUPS) + 2  # length, groups, all other letters
_GROUP = np.full(256, len(GROUPS), np.int64)
for _number, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _number


def slipped(run: str, start: int) -> str:
    """The run, without one letter where the checksum asks for it."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur ``least`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF with A-Z in lower case, of whole
    texts (null: none). Where crc32 of ``doc_id:run`` (a null doc_id counts as empty) is a
    multiple of ``SLIP``, the letter at its remainder by the run's length is left out first.
    Every row counts, equal ones too. Tasks add up what they hold before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["word", "n"],
            )
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 500):
                for doc_id, text in zip(ids[at : at + 500], batch.column(1).slice(at, 500).to_pylist()):
                    if not text:
                        continue
                    # Bytes fold A-Z alone.
                    runs = Counter(_RUN.findall(text.encode().lower().decode()))
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for found, n in runs.items():
                        word = slipped(found, start)
                        if len(word) >= letters:
                            held[word] += n
                    if len(held) > COUNTED_WORDS:
                        yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class _Words:
    """Words as one byte a letter, and their vectors."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.letters = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(w) for w in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.vector = np.zeros((len(raw), _DEPTH), np.int64)
        self.vector[:, 0] = self.length
        owner = np.repeat(np.arange(len(raw)), self.length)
        np.add.at(self.vector, (owner, _GROUP[self.letters] + 1), 1)


def _prefix_keys(vector: np.ndarray, depth: int) -> np.ndarray:
    key = np.full(len(vector), depth, spans.U64)
    for count in vector[:, :depth].T:
        key = spans.mix(key * spans.U64(0x9E3779B97F4A7C15) + count.astype(spans.U64))
    return spans.signed(key)


def homes(words: DataFrame, depth: int) -> DataFrame:
    """(word, n, key): the prefix of counts each word stands under."""

    def run(batches):
        for batch in batches:
            keys = _prefix_keys(_Words(batch.column(0).to_pylist()).vector, depth)
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


# What the search has spent so far: nothing, a surplus, a surplus and then a deficit. A
# shorter word is met by a surplus alone, one of the same length by both or neither.
_NOTHING, _SURPLUS, _BOTH = 0, 1, 2
_STEPS = (
    (_NOTHING, 0, _NOTHING), (_SURPLUS, 0, _SURPLUS), (_BOTH, 0, _BOTH),
    (_NOTHING, -1, _SURPLUS), (_SURPLUS, 1, _BOTH),
)


def reached(states: DataFrame, upto: int) -> DataFrame:
    """Carry search states on to prefixes of ``upto`` counts.

    A state (word, n, shorter, up, down, depth) looks for words ``shorter`` letters shorter
    and has spent its surplus at count ``up`` and its deficit at count ``down`` (null: not
    yet), having passed ``depth`` counts.
    """

    def run(batches):
        for batch in batches:
            words = _Words(batch.column(0).to_pylist())
            shorter, up, down, depth = (
                batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in range(2, 6)
            )
            row = np.arange(batch.num_rows)
            for count in range(1, upto):
                ahead = depth[row] <= count
                rows, ups, downs = [row], [up], [down]
                more = np.flatnonzero(ahead & (up < 0) & (words.vector[row, count] > 0))
                rows.append(row[more]), ups.append(np.full(len(more), count)), downs.append(down[more])
                more = np.flatnonzero(ahead & (up >= 0) & (down < 0) & (shorter[row] == 0))
                rows.append(row[more]), ups.append(up[more]), downs.append(np.full(len(more), count))
                row, up, down = (np.concatenate(x) for x in (rows, ups, downs))
            vector = words.vector[row].copy()
            vector[:, 0] -= shorter[row]
            vector[np.flatnonzero(up > 0), up[up > 0]] -= 1
            vector[np.flatnonzero(down > 0), down[down > 0]] += 1
            columns = [batch.column(i).take(pa.array(row)) for i in range(3)]
            columns += [
                pa.array(up, pa.int32(), mask=up < 0), pa.array(down, pa.int32(), mask=down < 0),
                pa.array(np.full(len(row), upto), pa.int32()),
                pa.array(_prefix_keys(vector, upto), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "word string, n long, shorter int, up int, down int, depth int, key long"
    names = [field.split()[0] for field in schema.split(", ")]
    return states.select(*names[:-1]).mapInArrow(run, schema)


class Trie:
    """Words of a shard by successive counts, as sorted child keys per level."""

    def __init__(self, words: list[str], n: np.ndarray):
        own = _Words(words)
        order = np.lexsort(own.vector.T[::-1])
        self.words = [words[i] for i in order.tolist()]
        self.n, self.letters = n[order], own.letters
        self.length, self.start = own.length[order], own.start[order]
        vector = own.vector[order]
        self.base = int(vector.max()) + 3
        self.children, node = [], np.zeros(len(words), np.int64)
        for counts in vector.T:
            keys, node = np.unique(node * self.base + counts, return_inverse=True)
            self.children.append(keys)
        self.leaf = np.searchsorted(node, np.arange(node[-1] + 2))

    def child(self, level: int, node: np.ndarray, count: np.ndarray):
        """(child, whether there is one) of each node by its next count."""
        keys, wanted = self.children[level], node * self.base + count
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, (keys[at] == wanted) & (count >= 0) & (count < self.base)

    def search(self, queries: _Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word of the trie) pairs that are one edit apart, each pair of words once."""
        every = np.arange(len(queries.length))
        stack = []
        for shorter in (0, 1):
            node, there = self.child(0, np.zeros(len(every), np.int64), queries.length - shorter)
            stack.append((1, shorter, every[there], node[there], np.zeros(there.sum(), np.int64)))
        while stack:
            level, shorter, query, node, spent = stack.pop()
            if len(query) > STATES:
                for at in range(0, len(query), STATES):
                    piece = slice(at, at + STATES)
                    stack.append((level, shorter, query[piece], node[piece], spent[piece]))
            elif level < _DEPTH:
                stack.append((level + 1, shorter, *self._step(level, shorter, queries, query, node, spent)))
            else:
                done = spent == _SURPLUS if shorter else spent != _SURPLUS
                yield from self._leaves(shorter, queries, query[done], node[done], spent[done])

    def _step(self, level, shorter, queries, query, node, spent):
        found = []
        for before, change, after in _STEPS:
            if shorter and after == _BOTH:
                continue
            at = np.flatnonzero(spent == before)
            child, there = self.child(level, node[at], queries.vector[query[at], level] + change)
            found.append((query[at[there]], child[there], np.full(there.sum(), after)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _leaves(self, shorter, queries, query, node, spent):
        sizes = self.leaf[node + 1] - self.leaf[node]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(query):
            done = ends[at - 1] if at else 0
            upto = max(int(np.searchsorted(ends, done + CANDIDATES, "right")), at + 1)
            piece = slice(at, upto)
            one = np.repeat(query[piece], sizes[piece])
            first = self.leaf[node[piece]] - (ends[piece] - sizes[piece] - done)
            other = np.repeat(first, sizes[piece]) + np.arange(len(one))
            yield self._verified(shorter, queries, one, other, np.repeat(spent[piece], sizes[piece]))
            at = upto

    def _verified(self, shorter, queries, one, other, spent):
        needed = queries.length[one] - 1
        ahead = self._common(queries, one, other, 1)
        equal = ahead > needed  # the word itself, which stands in one shard
        behind = self._common(queries, one, other, -1)
        near = ~equal & (ahead + behind >= needed)
        one, other, spent = one[near], other[near], spent[near]
        if not shorter:
            # Words of one vector meet from both sides: the smaller letter goes first.
            at = ahead[near]
            here = queries.letters[queries.start[one] + at]
            there = self.letters[self.start[other] + at]
            once = (spent == _BOTH) | (here < there)
            one, other = one[once], other[once]
        return one, other

    def _common(self, queries, one, other, way: int) -> np.ndarray:
        """Letters in common from the front (way 1) or from the end (way -1)."""
        most = np.minimum(queries.length[one], self.length[other])
        left, right = queries.start[one], self.start[other]
        if way < 0:
            left, right = left + queries.length[one] - 1, right + self.length[other] - 1
        common = np.zeros(len(one), np.int64)
        alive, k = np.flatnonzero(most > 0), 0
        while len(alive):
            same = queries.letters[left[alive] + way * k] == self.letters[right[alive] + way * k]
            alive = alive[same]
            k += 1
            common[alive] = k
            alive = alive[most[alive] > k]
        return common


def _searched(rows: DataFrame) -> DataFrame:
    """(word, near, near_n) in both directions from rows of (shard, salt, role, word, n)."""

    def run(batches):
        at, trie, words, counts = None, None, [], []
        for batch in batches:
            shard, salt, role = (batch.column(i).to_numpy() for i in range(3))
            n = batch.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows]):
                if first == last:
                    continue
                part = batch.column(3).slice(first, last - first).to_pylist()
                if at != (shard[first], salt[first]):
                    at, trie, words, counts = (shard[first], salt[first]), None, [], []
                if role[first] == 0:
                    words += part
                    counts.append(n[first:last])
                    continue
                if not words:  # a salt no word fell into
                    continue
                if trie is None:
                    trie = Trie(words, np.concatenate(counts))
                for one, other in trie.search(_Words(part)):
                    if len(one):
                        mine, theirs = [part[i] for i in one.tolist()], [trie.words[i] for i in other.tolist()]
                        own_n = n[first:last][one]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(mine + theirs, pa.string()), pa.array(theirs + mine, pa.string()),
                                pa.array(np.concatenate([trie.n[other], own_n]), pa.int64()),
                            ],
                            names=["word", "near", "near_n"],
                        )

    return (
        rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")
        .mapInArrow(run, "word string, near string, near_n long")
    )


def near_words(words: DataFrame, words_a_shard: int = WORDS_A_SHARD) -> DataFrame:
    """(word, near, near_n): all ordered pairs of distinct words one edit apart.

    ``words`` has one row (word, n) per word, in letters up to U+00FF. An edit is one
    letter inserted, deleted or replaced. An empty table gives an empty one.
    """
    waiting = words
    states = words.select(
        "word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("shorter"),
        F.lit(None).cast("int").alias("up"), F.lit(None).cast("int").alias("down"), F.lit(1).alias("depth"),
    )
    rows = None
    for depth in DEPTHS:
        placed = stored(homes(waiting, depth), "trie-words")
        last = depth == DEPTHS[-1]
        size = F.count("*")
        sizes = stored(placed.groupBy("key").agg(
            (F.lit(False) if last else size > words_a_shard).alias("split"),
            F.ceil(size / words_a_shard).cast("int").alias("salts"),
        ), "trie-prefixes")
        # A state whose prefix no word has ends here.
        passing = stored(reached(states, depth).join(sizes, "key"), "trie-states")
        placed = placed.join(sizes, "key")
        salts = F.sequence(F.lit(0), F.when(F.col("split"), 1).otherwise(F.col("salts")) - 1)
        here = placed.filter("not split").select(
            F.col("key").alias("shard"), F.pmod(F.hash("word"), F.col("salts")).alias("salt"),
            F.lit(0).alias("role"), "word", "n",
        )
        searches = passing.filter("not split").select(
            F.col("key").alias("shard"), F.explode(salts).alias("salt"), F.lit(1).alias("role"), "word", "n",
        ).distinct()
        found = here.unionAll(searches)
        rows = found if rows is None else rows.unionAll(found)
        if last or not sizes.filter("split").limit(1).count():
            break
        waiting = placed.filter("split").select("word", "n")
        states = passing.filter("split").select("word", "n", "shorter", "up", "down", "depth")
    return _searched(rows)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form) rows, by doubling its steps.

    Counts grow five times or more from a word to its form, so chains are short and end.
    """
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(reach.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"),
        ), "roots")
        reach = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return reach


def variants(docs: DataFrame, times: int = 5, words_a_shard: int = WORDS_A_SHARD) -> DataFrame:
    """One row per word of ``vocabulary(docs)``: word, form, root, n, n_near, form_n.

    ``form`` is the near word that occurs most often (ties: the first in code-point order)
    if it occurs at least ``times`` times as often as the word, else null; ``root`` is
    reached by following forms to the last. ``n_near`` counts near words. Further columns
    of ``docs`` are ignored; no rows, and null or empty texts, give no words; a word of any
    length is compared whole.
    """
    words = stored(vocabulary(docs), "vocabulary")
    pairs = near_words(words, words_a_shard)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    around = pairs.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    joined = words.join(around, "word", "left")
    follows = -F.col("first.less") >= times * F.col("n")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("first.near")).alias("form"),
        F.when(follows, -F.col("first.less")).alias("form_n"),
    ), "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
