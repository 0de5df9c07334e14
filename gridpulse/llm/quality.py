"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Words are runs of letters, of digits or of other signs. Besides its spelling each word has a
form (letter case for letters; signs are their own form). Single words and pairs of
neighbours, of spellings and of forms, are hashed into ``BUCKETS``; a feature's value is its
share among the text's features of its kind. Training follows the regularised leader with
per-coordinate rates over a bounded sample; a score is one sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import spans

BUCKETS = 1 << 18
SAMPLE = 6000  # bound of the training sample
EPOCHS = 4
SCALE = 10.0  # of every feature value
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.1

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[0x61:0x7B] = 1
_SHIFT = spans.U64(64 - 18)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, where each text's features begin) per kind of feature."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    borders = np.flatnonzero(change)
    inside = kind[borders[:-1]] != 0
    starts, ends = borders[:-1][inside], borders[1:][inside]
    first = np.searchsorted(starts, offsets)
    spelling = spans.span_hashes(spans.LOWER[data], starts, ends)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    lowers = np.concatenate([[0], np.cumsum(_LOWER[data])])
    upper, lower = uppers[ends] - uppers[starts], lowers[ends] - lowers[starts]
    case = np.where(upper == 0, 1, np.where(lower == 0, np.where(upper > 1, 2, 3), np.where(upper == 1, 3, 4)))
    sort = kind[starts]
    form = np.where(sort == 3, spelling, spans.mix((case * 4 + sort).astype(spans.U64)))
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    out = []
    for salt, words in ((1, spelling), (3, form)):
        single = spans.mix(words + spans.U64(salt)) >> _SHIFT
        out.append((single, first))
        pairs = spans.mix(words[:-1] * spans.U64(0x9E3779B97F4A7C15) + words[1:] + spans.U64(salt + 1))
        keep = ~last[:-1]
        at = np.concatenate([[0], np.cumsum(keep)])
        out.append((pairs[keep] >> _SHIFT, at[np.minimum(first, len(at) - 1)]))
    return out


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values."""
    values = np.zeros(0, spans.U64), np.zeros(0)
    for _, data, offsets in spans.chunks(pa.array([text], pa.string())):
        parts = [(b, np.full(len(b), SCALE / max(len(b), 1))) for b, _ in features(data, offsets)]
        buckets = np.concatenate([b for b, _ in parts])
        values, inverse = np.unique(buckets, return_inverse=True)
        return values, np.bincount(inverse, np.concatenate([v for _, v in parts]), len(values))
    return values


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = []
        for _, data, offsets in spans.chunks(texts):
            total = np.full(len(offsets) - 1, self.bias)
            for buckets, first in features(data, offsets):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets])])
                total += SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
            parts.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(rows: list[tuple[str, int]], seed: int = 3) -> QualityModel:
    """FTRL-proximal over (text, label) rows. Without rows every score is 1/2."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = 0.0

    def solve(z, n):
        pulled = z - np.sign(z) * L1
        return np.where(np.abs(z) <= L1, 0.0, -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2))

    random = np.random.default_rng(seed)
    data = [(*_sparse(text or ""), label) for text, label in rows]
    for _ in range(EPOCHS):
        for i in random.permutation(len(data)).tolist():
            at, value, label = data[i]
            weight = solve(z[at], n[at])
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            score = 1 / (1 + np.exp(-np.clip(weight @ value + bias, -500, 500)))
            slope = (score - label) * value
            z[at] += slope - (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / ALPHA * weight
            n[at] += slope**2
            own = score - label
            zb += own - ((nb + own**2) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += own**2
    return QualityModel(solve(z, n), float(-zb / ((BETA + nb**0.5) / ALPHA)))


def training_rows(docs: DataFrame, labels: DataFrame, keep) -> list[tuple[str, int]]:
    """At most ``SAMPLE`` (text, quality) rows, the first by hashed doc_id."""
    chosen = (
        labels.filter("doc_id is not null and quality is not null").filter(keep)
        .groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    return [(r["text"], int(r["_quality"])) for r in rows]


def scored(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 from ``threshold`` on) per row.

    Null and empty texts have no features and get the model's bias. Equal texts get equal
    scores up to rounding; further columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            score = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``threshold`` or more."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
