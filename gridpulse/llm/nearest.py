"""Nearest neighbours: probed lists scanned by adaptive dimension sampling.

Vectors are scaled to length one and turned by a random rotation, so any leading columns
are a fair sample of all. Lists come from k-means on a bounded sample; every row is put into
its list. A query scans the lists of its nearest centroids column block by column block: the
partial distance of a candidate, set against the k-th best so far, is a hypothesis test, and
a candidate that fails is abandoned. Survivors are scored on the original vectors.

Lists and the queries that probe them are cut into blocks, and each task scans one block of
a list for one block of queries, so neither a crowded list nor a popular one meets in a task.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.scratch import stored

SAMPLE = 20_000  # bound of the k-means sample
MOST_LISTS = 256
PROBED_SHARE = 0.6  # of the lists; recall is measured in the tests
CANDIDATES_A_BLOCK = 4096
QUERIES_A_BLOCK = 512
COLUMNS = 16
EPSILON = 2.1  # of the abandonment test


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of rows that take part, vectors as arrays of doubles."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    )
    length = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return rows.filter("id is not null and v is not null").filter(~odd).filter(length > 0)


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cluster keeps its centre."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class _Scan:
    """Best candidates so far of one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.turned = (_unit(vectors) @ rotation).astype(np.float32)
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.limit = np.full(len(ids), np.inf)  # squared distance of the k-th best

    def see(self, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray) -> None:
        width = turned.shape[1]
        query, row = np.nonzero(self.ids[:, None] != ids[None, :])
        partial = np.zeros(len(query), np.float32)
        for at in range(0, width, COLUMNS):
            upto = min(at + COLUMNS, width)
            if at == 0:  # all pairs are alive: one matrix product
                q, c = self.turned[:, :upto], turned[:, :upto]
                first = (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (q @ c.T)
                partial = first[query, row]
            else:
                step = self.turned[query, at:upto] - turned[row, at:upto]
                partial = partial + np.einsum("ij,ij->i", step, step)
            slack = (1 + EPSILON / upto**0.5) ** 2 if upto < width else 1.0
            alive = partial * (width / upto) <= self.limit[query] * slack + 1e-5
            query, row, partial = query[alive], row[alive], partial[alive]
        if not len(query):
            return
        dots = np.einsum("ij,ij->i", self.vectors[query], vectors[row])
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        score = dots / (self.norms[query] * norms[row])
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        # Rows of one id at one score count once, before the best are cut.
        fresh = (query[1:] != query[:-1]) | (ids[row[1:]] != ids[row[:-1]]) | (score[1:] != score[:-1])
        fresh = np.r_[True, fresh]
        query, row, score = query[fresh], row[fresh], score[fresh]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(query)]):
            q = query[lo]
            few = slice(lo, min(hi, lo + self.k))
            new = list(zip((-score[few]).tolist(), ids[row[few]].tolist()))
            self.best[q] = sorted(set(self.best[q]) | set(new))[: self.k]
            if len(self.best[q]) == self.k:
                self.limit[q] = max(0.0, 2 + 2 * self.best[q][-1][0])


def nearest(
    vectors: DataFrame,
    id_column: str,
    vector_column: str,
    query_filter: str,
    k: int = 5,
    probed_share: float = PROBED_SHARE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest cosines found for each query.

    Queries are the rows with ``query_filter`` (over ``id``), candidates all rows with
    another id. Ties go to the smaller id. Rows with a null id and vectors that are null,
    zero, hold null or non-finite components, or differ in length from most, take no part.
    Equal rows count once. If the probed lists hold fewer than k others, further lists are
    probed. Further columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    valid = _valid(vectors, id_column, vector_column)
    widths = valid.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["w"]
    # Repeats go before anything is counted, so lists hold, and scans see, each row once.
    valid = stored(valid.filter(F.size("v") == width).distinct(), "vectors")
    total = valid.count()
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    units = _unit(np.array([r["v"] for r in sample], np.float64))
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))[0]
    lists = max(1, min(MOST_LISTS, isqrt(total), len(units)))
    centres = centroids(units, lists)

    def assign(batches):
        for batch in batches:
            values = _matrix(batch.column(1), width)
            if len(values):
                place = (_unit(values) @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), batch.column(0), batch.column(1)], names=["list", "id", "v"]
                )

    placed = valid.mapInArrow(assign, "list int, id long, v array<double>")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    sizes = np.array([counts.get(i, 0) for i in range(lists)])
    probes = max(1, round(lists * probed_share))

    def probe(batches):
        for batch in batches:
            values = _matrix(batch.column(1), width)
            if not len(values):
                continue
            order = (_unit(values) @ centres.T).argsort(axis=1)[:, ::-1]
            needed = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
            taken = np.minimum(np.maximum(needed, probes), lists)
            chosen = [order[i, : taken[i]].astype(np.int32) for i in range(len(values))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.list_(pa.int32())), batch.column(0), batch.column(1)],
                names=["lists", "id", "v"],
            )

    queries = valid.filter(query_filter)
    probing = queries.mapInArrow(probe, "lists array<int>, id long, v array<double>")
    probing = probing.withColumn("list", F.explode("lists")).drop("lists")
    asked = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}
    blocks = spark.createDataFrame(
        [
            (i, -(-counts.get(i, 0) // CANDIDATES_A_BLOCK), -(-asked.get(i, 0) // QUERIES_A_BLOCK))
            for i in range(lists)
        ],
        "list int, row_blocks int, query_blocks int",
    ).filter("row_blocks > 0 and query_blocks > 0")
    blocks = F.broadcast(blocks)  # at most MOST_LISTS rows

    def block(column):
        return F.pmod(F.xxhash64("id"), F.col(column).cast("long")).cast("int")

    def every(column):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    rows = placed.join(blocks, "list").withColumn("row_block", block("row_blocks"))
    rows = rows.withColumn("query_block", every("query_blocks")).withColumn("role", F.lit(1))
    asks = probing.join(blocks, "list").withColumn("query_block", block("query_blocks"))
    asks = asks.withColumn("row_block", every("row_blocks")).withColumn("role", F.lit(0))
    key = ["list", "row_block", "query_block"]
    tiles = asks.select(*key, "role", "id", "v").unionAll(rows.select(*key, "role", "id", "v"))

    def scan(batches):
        at, held, scanning = None, [], None

        def best():
            out = [(int(q), i, -s) for q, found in zip(scanning.ids, scanning.best) for s, i in found]
            columns = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            values, ids = _matrix(batch.column(5), width), batch.column(4).to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for lo, hi in zip(edges, np.r_[edges[1:], len(keys)]):
                tile, role = tuple(keys[lo, :3]), keys[lo, 3]
                if tile != at:
                    if scanning:
                        yield best()
                    at, held, scanning = tile, [], None
                if role == 0:
                    held.append((ids[lo:hi], values[lo:hi]))
                    continue
                if scanning is None and held:
                    asked_ids = np.concatenate([h[0] for h in held])
                    scanning = _Scan(asked_ids, np.concatenate([h[1] for h in held]), rotation, k)
                if scanning:
                    turned = (_unit(values[lo:hi]) @ rotation).astype(np.float32)
                    for i in range(0, hi - lo, 256):
                        j = min(i + 256, hi - lo)
                        scanning.see(ids[lo + i : lo + j], values[lo + i : lo + j], turned[i:j])
        if scanning:
            yield best()

    found = (
        tiles.repartition(*key).sortWithinPartitions(*key, "role", "id")
        .mapInArrow(scan, "query_id long, vec_id long, score double").distinct()
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
