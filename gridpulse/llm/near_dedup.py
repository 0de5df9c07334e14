"""Near-duplicate groups with SetSketch registers: band, estimate, verify, connect.

A document is the set of its distinct word shingles. A register is the smallest of the
set's values under one hash function, truncated to an exponentially spaced grid with base
``BASE``; registers of two sets merge by maximum and agree with a probability that follows
the Jaccard similarity. Bands of registers propose pairs, register comparisons estimate the
similarity by maximum likelihood, full shingle sets decide.

Large groups never meet as pairs. Equal sets are one vertex. In a bucket every member is
compared with the smallest one only, its centre. Members of one bucket that still lie in
different components are compared in a second pass, in blocks inside a task and each pair in
its first common bucket only, except where the triangle inequality of the Jaccard distance
(both distances to the centre are known) rules a link out. A member's text goes once to each
block, and blocks are as large as memory lets them be.

A doc_id may stand at several texts. Each distinct set keeps a vertex of its own, and in the
end the vertices of one doc_id are tied together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import spans
from gridpulse.llm.components import connected
from gridpulse.llm.scratch import stored

BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band with probability 6e-6
REGISTERS = BANDS * ROWS
BASE = 1.02
MEMBERS_A_SALT = 2048
STRAY_SHINGLES = 1 << 20  # a block of strays holds so many, 8 MB, or one larger set
MARGIN = 6.0  # standard deviations of the estimate below the threshold that still get verified

_random = np.random.default_rng(10)
_FACTORS = _random.integers(0, 2**31, REGISTERS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_ONE_WORD = spans.U64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, in order.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle; a text without
    words, an empty and a null one have none.
    """
    for _, data, offsets in spans.chunks(texts):
        found = spans.words(spans.LOWER[data], offsets)
        hashes = found.hashes()
        for i in range(len(offsets) - 1):
            own = hashes[found.first[i] : found.first[i + 1]]
            if len(own) >= words:
                yield np.unique(spans.rolling(own, words))
            elif len(own):
                yield spans.span_hashes(own, np.array([0]), np.array([len(own)])) ^ _ONE_WORD
            else:
                yield own


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set: grid position of each truncated minimum."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> spans.U64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        values = np.multiply.outer(low[at : at + 2048], _FACTORS)
        values += _SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2**32
    return np.floor(1 - np.log(-np.log1p(-uniform)) / np.log(BASE)).astype(np.int16)


def band_keys(register: np.ndarray) -> np.ndarray:
    rows = register.reshape(BANDS, ROWS).astype(np.int64).view(spans.U64)
    key = np.arange(1, BANDS + 1).astype(spans.U64)
    for column in range(ROWS):
        key = spans.mix(key * spans.U64(0x9E3779B97F4A7C15) + rows[:, column])
    return spans.signed(key)


_GRID = np.linspace(0, 1, 201)


def likeliest(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> float:
    """Jaccard similarity with the largest likelihood, given registers and set sizes."""
    above, below = int((left > right).sum()), int((left < right).sum())
    u = n_left / (n_left + n_right)
    v = 1 - u
    grid = _GRID * min(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    same = np.maximum(1 - up - down, 1e-300)
    fit = (
        above * np.log(np.maximum(up, 1e-300))
        + below * np.log(np.maximum(down, 1e-300))
        + (REGISTERS - above - below) * np.log(same)
    )
    return float(grid[np.argmax(fit)])


def _set_keys(own: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit sums that name a set; nulls for an empty one."""
    if not len(own):
        return None, None
    return tuple(int(spans.signed(v.sum(keepdims=True))[0]) for v in (own, spans.mix(own)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (two longs, null if empty) and band keys of each row."""

    def run(batches):
        for batch in batches:
            sizes, first, second, bands = [], [], [], []
            for own in shingle_sets(batch.column(1), words):
                sizes.append(len(own))
                key1, key2 = _set_keys(own)
                first.append(key1), second.append(key2)
                bands.append(band_keys(registers(own)) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"
    )


def keyed_texts(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key1, key2 (of the shingle set) and text of each row."""

    def run(batches):
        for batch in batches:
            keys = [_set_keys(own) for own in shingle_sets(batch.column(1), words)]
            first, second = (pa.array(k, pa.int64()) for k in (list(zip(*keys)) or [[], []]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), first, second, batch.column(1)], names=["doc_id", "key1", "key2", "text"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key1 long, key2 long, text string")


_LAST_ID = 2**63 - 2


def vertex_ids(full: DataFrame) -> DataFrame:
    """key1, key2, rep, id of each distinct set: its smallest doc_id and its vertex.

    The vertex is ``rep``, or, where that stands for several sets, for all but the first of
    them a hash above ``rep``: so the smallest vertex of a component stays a doc_id. A hash
    meets one of n doc_ids with probability n / 2**63.
    """
    sets = stored(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "sets")
    several = sets.groupBy("rep").agg(
        F.min(F.struct("key1", "key2")).alias("first"), F.count("*").alias("n")
    )
    several = stored(several.filter("n > 1").select("rep", "first"), "several")
    own = F.col("first").isNull() | (F.col("first") == F.struct("key1", "key2"))
    base = F.least(F.greatest("rep", F.lit(0)), F.lit(_LAST_ID - 1))
    other = base + 1 + F.pmod(F.xxhash64("rep", "key1", "key2"), F.lit(_LAST_ID) - base)
    return sets.join(several, "rep", "left").select(
        "key1", "key2", "rep", F.when(own, F.col("rep")).otherwise(other).alias("id")
    )


def _spread(edges: DataFrame) -> DataFrame:
    """Edges (member, centre) with a salt, and the centre itself once per salt.

    A centre with many members is sent to several groups, each with a share of them.
    """
    sizes = edges.groupBy("centre").agg(
        F.ceil(F.count("*") / MEMBERS_A_SALT).cast("int").alias("salts")
    )
    members = edges.join(sizes, "centre").select(
        "centre",
        F.pmod(F.xxhash64("member"), F.col("salts").cast("long")).cast("int").alias("salt"),
        F.col("member").alias("id"),
        F.lit(1).alias("role"),
    )
    centres = sizes.select(
        "centre",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("centre").alias("id"),
        F.lit(0).alias("role"),
    )
    return members.unionAll(centres)


def _least_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5 - 0.01


def _common(left: np.ndarray, right: np.ndarray) -> int:
    return len(np.intersect1d(left, right, assume_unique=True))


def verified(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(member, centre, shared, united) shingle counts of edges, from full sets.

    Edges estimated to be far below ``percent`` similarity are left out.
    """
    least = _least_estimate(percent)

    def run(batches):
        centre, own, sketch = None, None, None
        for batch in batches:
            out = []
            centres, salts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, roles = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, found in enumerate(shingle_sets(batch.column(4), words)):
                if roles[i] == 0:
                    centre, own, sketch = (centres[i], salts[i]), found, registers(found)
                    continue
                if centre != (centres[i], salts[i]):
                    raise ValueError("a member came before its centre")
                if likeliest(registers(found), sketch, len(found), len(own)) < least:
                    continue
                shared = _common(found, own)
                out.append((ids[i], centres[i], shared, len(found) + len(own) - shared))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["member", "centre", "shared", "united"],
            )

    rows = _spread(edges).join(texts, "id").select("centre", "salt", "id", "role", "text")
    return (
        rows.repartition("centre", "salt")
        .sortWithinPartitions("centre", "salt", "role", "id")
        .mapInArrow(run, "member long, centre long, shared long, united long")
    )


@dataclass
class _Stray:
    id: int
    component: int
    distance: float
    bands: np.ndarray
    own: np.ndarray
    sketch: np.ndarray


def _across(buckets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) inside buckets between components.

    ``buckets``: band, centre, id, component, n_shingles, d (distance to the centre; null if
    unknown).
    ``n_shingles`` is the size of the member's set. A bucket's strays are the members
    outside its component with most shingles. They are held in blocks, and all members
    stream past each block; only links come out. The centre has met everybody and stays away.
    """
    sizes = buckets.groupBy("band", "component").agg(F.sum("n_shingles").alias("n"))
    largest = (
        sizes.groupBy("band")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
        .select(
            "band",
            F.col("top.component").alias("main"),
            F.ceil((F.col("all") - F.col("top.n")) / STRAY_SHINGLES).cast("int").alias("salts"),
        )
        .filter("salts > 0")
    )
    rows = buckets.filter("id != centre").join(largest, "band")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int"))
    columns = ["band", "salt", "role", "id", "component", "d"]
    strays = rows.filter("component != main").withColumn("role", F.lit(0)).select(*columns)
    members = (
        rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .withColumn("role", F.lit(1)).select(*columns)
    )
    rows = strays.unionAll(members).join(texts, "id").select(*columns, "bands", "text")
    far, least = 1 - percent / 100 + 1e-9, _least_estimate(percent)

    def run(batches):
        at, block = None, []
        for batch in batches:
            out = []
            values = [batch.column(i).to_pylist() for i in range(6)]
            for i, own in enumerate(shingle_sets(batch.column(7), words)):
                band, salt, role, id, component, d = (column[i] for column in values)
                if at != (band, salt):
                    at, block, met = (band, salt), [], None
                d = np.nan if d is None else d
                keys = batch.column(6)[i].values.to_numpy()
                if role == 0:
                    block.append(_Stray(id, component, d, keys, own, registers(own)))
                    continue
                if not block:
                    continue
                if met is None:
                    met = [np.array([getattr(s, f) for s in block]) for f in ("id", "component", "distance")]
                    strays, bands = {s.id for s in block}, np.stack([s.bands for s in block])
                    sketches_ = np.stack([s.sketch for s in block])
                same = bands == keys
                first = same[np.arange(len(block)), same.argmax(axis=1)]
                here = keys[same.argmax(axis=1)] == band
                open_ = (met[1] != component) & first & here & ~(np.abs(met[2] - d) > far)
                if id in strays:
                    open_ &= met[0] > id
                near = np.flatnonzero(open_)
                if not len(near):
                    continue
                sketch = registers(own)
                # Registers agree at least as often as sets are similar.
                near = near[(sketches_[near] == sketch).mean(axis=1) >= least]
                for stray in [block[k] for k in near.tolist()]:
                    if likeliest(stray.sketch, sketch, len(stray.own), len(own)) < least:
                        continue
                    shared = _common(stray.own, own)
                    if 100 * shared >= percent * (len(stray.own) + len(own) - shared):
                        out.append((stray.id, id))
            columns_ = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns_], names=["a", "b"]
            )

    return (
        rows.repartition("band", "salt").sortWithinPartitions("band", "salt", "role", "id")
        .mapInArrow(run, "a long, b long")
    )


def _texts(docs: DataFrame, sketched: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, bands, text of the given vertices.

    Where a doc_id stands at one set its row is found by doc_id, otherwise by the set too.
    """
    one, two = F.coalesce("key1", F.lit(0)), F.coalesce("key2", F.lit(0))
    clashing = (
        sketched.filter("doc_id is not null").groupBy("doc_id")
        .agg(*[f(c).alias(n) for c, n in ((one, "x"), (two, "y"), ("n_shingles", "z"))
               for f, n in ((F.min, n), (F.max, n + n))])
        .filter("x < xx or y < yy or z < zz").select("doc_id")
    )
    clashing = stored(clashing, "clashing")
    columns = ["id", "n_shingles", "bands", "text"]
    rows = docs.select("doc_id", "text")
    plain = rows.join(clashing, "doc_id", "left_anti").join(nodes.drop("key1", "key2"), "doc_id")
    found = plain.dropDuplicates(["doc_id"]).select(*columns)
    if clashing.isEmpty():
        return found
    odd = keyed_texts(rows.join(clashing, "doc_id", "left_semi"), words)
    odd = odd.join(nodes, ["doc_id", "key1", "key2"]).dropDuplicates(["doc_id", "key1", "key2"])
    return found.unionByName(odd.select(*columns))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with ``100 * shared >= percent * united`` shingles are linked;
    ``component_id`` is the smallest doc_id reachable, ``kept`` says that the document is
    that one. Empty and null texts are linked with nothing and kept. Rows without a doc_id
    cannot be named: they link nothing, get a null component and are kept. Equal rows come
    back as often as they were given; rows of one doc_id with different texts link like one
    document with all those texts. Further columns are ignored. An empty table gives no rows.
    """
    sketched = stored(sketches(docs, words), "sketches")
    full = sketched.filter("doc_id is not null and key1 is not null")
    classes = stored(vertex_ids(full), "classes")
    ties = (
        full.select("doc_id", "key1", "key2").join(classes, ["key1", "key2"]).filter("doc_id != id")
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    vertices = (
        full.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "key1", "key2"])
        .dropDuplicates(["rep", "key1", "key2"])
    )
    banded = vertices.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last"))
    shared = shared.filter("centre < last").select("band", "centre")
    buckets = stored(banded.join(shared, "band"), "buckets")

    edges = buckets.filter("id != centre").select(F.col("id").alias("member"), "centre").distinct()
    involved = buckets.select("id").distinct()
    nodes = vertices.join(involved, "id", "left_semi").select(
        F.col("rep").alias("doc_id"), "key1", "key2", "id", "n_shingles", "bands"
    )
    texts = stored(_texts(docs, sketched, stored(nodes, "nodes"), words), "texts")
    tested = stored(verified(edges, texts.select("id", "text"), words, percent), "tested")
    linked = F.expr(f"100 * shared >= {percent} * united")
    links = tested.filter(linked).select(F.col("member").alias("a"), F.col("centre").alias("b"))

    reached = connected(links)
    placed = buckets.join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "centre", "id", F.coalesce("component", "id").alias("component")
    )
    placed = placed.join(texts.select("id", "n_shingles"), "id")
    distances = tested.select(
        F.col("member").alias("id"), "centre", (1 - F.col("shared") / F.col("united")).alias("d")
    )
    placed = placed.join(distances, ["id", "centre"], "left")
    found = stored(_across(placed, texts, words, percent).distinct(), "links")
    groups = connected(links.unionAll(found).unionAll(ties)).withColumnRenamed("node", "doc_id")
    return sketched.select("doc_id", "n_shingles").join(groups, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
