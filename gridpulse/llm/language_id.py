"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its subwords, which are the runs of 2 to 4 bytes of
its words with their borders, hashed into ``BUCKETS``. Embeddings and softmax are trained
together by stochastic gradient descent on a bounded sample of labelled documents. Mean and
softmax weights are linear, so scoring needs one table of logits per bucket: embeddings
times weights. Confidences are calibrated by temperature on documents kept from training,
and the level below which a text is rejected is read off the same documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm import spans
from gridpulse.llm.scratch import stored

BUCKETS = 1 << 16
DIMENSIONS = 16
SAMPLE_PER_LANGUAGE = 500  # bound of the training sample
SAMPLE_GROUPS = 256  # groups of input partitions the sample is cut in first
EPOCHS = 6
RATE = 0.5
REJECTED_SHARE = 0.001  # of right calibration documents, at most
HIGHEST_THRESHOLD = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BYTE = np.full(256, 0x20, np.uint32)
for _b in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    _BYTE[_b] = _b + 32


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket arrays (one per length; ``BUCKETS`` marks none) and where each text begins."""
    n = len(offsets) - 1
    letters = np.full(len(data) + n + 4, 0x20, np.uint32)
    lengths = np.diff(offsets)
    letters[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = _BYTE[data]
    first = offsets[:-1] + np.arange(n)  # the border before each text
    size = len(data) + n
    gap = letters == 0x20
    out = []
    key = letters[:size].copy()
    for length in (2, 3, 4):
        key = key * np.uint32(0x01000193) + letters[length - 1 : size + length - 1]
        bucket = ((key ^ np.uint32(length)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        inner = gap[1 : size + 1].copy()
        if length == 2:
            inner &= gap[:size]
        elif length == 4:
            inner |= gap[2 : size + 2]
        bucket[inner] = BUCKETS
        out.append(bucket)
    return out, first


@dataclass
class LanguageModel:
    """``languages[i]`` has logits ``table[bucket, i]``, averaged, plus ``bias[i]``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        parts = []
        table = np.vstack([self.table, np.zeros((1, len(self.languages)), np.float32)])
        for _, data, offsets in spans.chunks(texts):
            grams, first = subwords(data, offsets)
            total = np.zeros((len(first), len(self.languages)))
            seen = np.zeros(len(first))
            for bucket in grams:
                total += np.add.reduceat(table[bucket], first, axis=0)
                seen += np.add.reduceat((bucket < BUCKETS).astype(np.int64), first)
            parts.append(total / np.maximum(seen, 1)[:, None] + self.bias)
        return np.vstack(parts) if parts else np.zeros((0, len(self.languages)))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    for _, data, offsets in spans.chunks(pa.array([text], pa.string())):
        values = np.concatenate([b[b < BUCKETS] for b in subwords(data, offsets)[0]])
        bucket, count = np.unique(values, return_counts=True)
        return bucket, count.astype(np.float32)
    return np.zeros(0, np.uint32), np.zeros(0, np.float32)


def fit(rows: list[tuple[str, str]], seed: int = 6) -> LanguageModel | None:
    """Model from (text, language) rows; a fifth of them only calibrates. None without rows."""
    languages = sorted({language for _, language in rows})
    if not languages:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    data = [(*_counted(text), languages.index(language)) for text, language in rows]
    embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = random.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learn = [i for i in range(len(rows)) if i not in held and len(data[i][0])]
    steps, step = EPOCHS * max(len(learn), 1), 0
    for _ in range(EPOCHS):
        for i in random.permutation(learn).astype(int).tolist() if learn else []:
            bucket, count, target = data[i]
            share = count / count.sum()
            mean = share @ embed[bucket]
            logit = mean @ weight + bias
            slope = np.exp(logit - logit.max())
            slope /= slope.sum()
            slope[target] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            back = weight @ slope
            weight -= rate * np.outer(mean, slope)
            bias -= rate * np.float32(0.1) * slope
            # A mean over thousands of subwords moves each of them little; the step grows
            # with their number so that the mean itself moves.
            embed[bucket] -= (rate * len(bucket) * share)[:, None] * back
            step += 1
    model = LanguageModel(languages, embed @ weight, bias)
    check = [i for i in sorted(held) if len(data[i][0])] or learn
    if check:
        logits = model.logits(pa.array([rows[i][0] for i in check], pa.string()))
        right = np.array([data[i][2] for i in check])
        at = np.arange(len(check))

        def loss(temperature):
            model.temperature = temperature
            return -np.log(np.maximum(model.probabilities(logits)[at, right], 1e-12)).mean()

        model.temperature = float(min(np.geomspace(1, 32, 41), key=loss))
        found = model.probabilities(logits)
        sure = found.max(axis=1)[found.argmax(axis=1) == right]
        if len(sure):
            model.threshold = float(min(HIGHEST_THRESHOLD, np.quantile(sure, REJECTED_SHARE)))
    return model


def training_rows(docs: DataFrame, keep) -> list[tuple[str, str]]:
    """At most ``SAMPLE_PER_LANGUAGE`` (text, language) rows a language, by hashed doc_id.

    The smallest hashes are found in two levels: first among the input partitions of a
    group, then among ``SAMPLE_GROUPS`` groups, so no task sees more of a language than its
    share. The chosen ids are a table; the optimizer broadcasts it by its measured size.
    """
    known = docs.filter(keep).filter("doc_id is not null and lang is not null")
    group = F.pmod(F.spark_partition_id(), F.lit(SAMPLE_GROUPS)).alias("part")
    chosen = known.select("doc_id", "lang", group)
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_PER_LANGUAGE)
    chosen = stored(chosen.select("doc_id").distinct(), "sample")
    sample = known.select("doc_id", "lang", "text").join(chosen, "doc_id", "left_semi")
    rows = sample.filter("text is not null").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))]


def _decisions(texts: pa.Array, model: LanguageModel | None):
    """Predicted language, score and rejection of each text."""
    lettered = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
    if model is None:
        none = np.zeros(len(lettered))
        return [UNKNOWN] * len(lettered), none, none == 0
    found = model.probabilities(model.logits(texts))
    score = np.where(lettered, found.max(axis=1), 0.0)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(found.argmax(axis=1), lettered)]
    return names, score, ~lettered | (score < model.threshold)


def identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected per row of ``docs``.

    The prediction is a learned language, or ``und`` with score 0 where the text is null or
    has no letter, or nothing could be learned. ``rejected`` marks ``und`` and confidences
    below the calibrated threshold. Ties go to the language first in order. Equal rows give
    equal results, further columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            names, score, rejected = _decisions(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``identified`` does not reject."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_decisions(batch.column("text"), model)[2]))

    return docs.mapInArrow(run, docs.schema)
