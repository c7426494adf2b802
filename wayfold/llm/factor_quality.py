"""Quality of texts by a factorisation machine.

Inputs of a text are the shares of its distinct words, hashed into buckets, statistics of its structure, and its length as the table states it. Each
input has a weight and a vector of FACTORS numbers; every pair of inputs adds the product of their vectors. With the identity
sum over pairs = half of (square of the sum - sum of the squares) a text is scored in time linear in its distinct words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .quality_rules import SHARES, labelled_sample, statistics

BUCKETS = 1 << 14
FACTORS = 8
#: Structure of the text: the shares of the quality rules, lengths, repeated lines; then the stated length and whether there is one.
STATISTICS = (*SHARES, "log_words", "log_chars", "repeated_lines", "stated_chars", "stated")
#: The machine is fitted on this many labelled rows, those with the smallest hashes of id and label.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.02, 1e-5
SEED = 7


def text_inputs(text: str | None, stated: float | None) -> tuple[list[int], list[float], list[float]]:
    """Buckets, their values (of unit length together) and STATISTICS of a text; null is empty."""
    n, chars, _, lines, _, shares = statistics(text)
    counts = Counter((text or "").lower().encode("utf-8", "surrogatepass").split())
    buckets: Counter[int] = Counter()
    for word, count in counts.items():
        buckets[zlib.crc32(word) % BUCKETS] += count
    norm = math.sqrt(sum(buckets.values())) or 1.0
    known = stated is not None and stated == stated
    rest = [math.log1p(n), math.log1p(chars), lines / max(1, (text or "").count("\n") + 1), math.log1p(max(stated, 0)) if known else 0.0, float(known)]
    return list(buckets), [math.sqrt(c) / norm for c in buckets.values()], [*shares, *rest]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # one per bucket, then one per statistic
    vectors: np.ndarray  # FACTORS per bucket and statistic
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, statistic: np.ndarray) -> np.ndarray:
        return np.clip((statistic - self.mean) / self.scale, -5, 5) / 4

    def score(self, texts: list, stated: list) -> np.ndarray:
        """Probability that each text is good."""
        out = np.zeros(len(texts))
        for k, (text, length) in enumerate(zip(texts, stated)):
            buckets, values, statistic = text_inputs(text, length)
            at = np.concatenate([np.array(buckets, np.int64), np.arange(BUCKETS, BUCKETS + len(STATISTICS))])
            x = np.concatenate([values, self.scaled(np.array(statistic))]).astype(np.float32)
            vectors = self.vectors[at] * x[:, None]
            pairs = 0.5 * float((vectors.sum(0) ** 2).sum() - (vectors**2).sum())
            out[k] = self.bias + float(self.weights[at] @ x) + pairs
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(words: np.ndarray, statistic: np.ndarray, good: np.ndarray) -> Machine:
    """A machine from `words` (rows of bucket values), `statistic` (rows of STATISTICS) and `good` (0 or 1), by mini-batches of
    gradients with per-parameter step sizes. Without rows of both kinds every text scores the share of good ones, or a half."""
    rng = np.random.default_rng(SEED)
    size = BUCKETS + len(STATISTICS)
    share = (good.sum() + 1) / (len(good) + 2)
    machine = Machine(math.log(share / (1 - share)), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not len(good) or good.min() == good.max():
        return machine
    machine.mean, machine.scale = statistic.mean(0), np.maximum(statistic.std(0), 1e-3)
    machine.vectors = rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    rest = machine.scaled(statistic).astype(np.float32)
    moments = [np.zeros_like(machine.weights), np.zeros_like(machine.vectors)]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(good))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = np.hstack([words[rows], rest[rows]])
            sums, squares = x @ machine.vectors, x * x
            y = machine.bias + x @ machine.weights + 0.5 * (sums**2 - squares @ machine.vectors**2).sum(1)
            error = ((1 / (1 + np.exp(-np.clip(y, -30, 30)))) - good[rows]).astype(np.float32) / len(rows)
            machine.bias -= float(RATE * error.sum())
            slopes = (x.T @ error + DECAY * machine.weights, x.T @ (error[:, None] * sums) - machine.vectors * (squares.T @ error)[:, None] + DECAY * machine.vectors)
            for parameter, moment, slope in zip((machine.weights, machine.vectors), moments, slopes):
                moment *= 0.99
                moment += 0.01 * slope**2
                parameter -= RATE * slope / (np.sqrt(moment) + 1e-6)
    return machine


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """A machine from at most `rows` rows of `labels` (doc_id, quality) outside the held-out fold and their `docs` (doc_id, text, n_chars if
    there). Inputs are made in all tasks, fitting is one task on the bounded sample; the machine alone reaches the driver."""
    sample = labelled_sample(_with_length(docs), labels, "quality", rows, "stated")

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text_inputs(t, s) for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = [
                batch.column(2),
                pa.array([np.array(o[0], np.int32).tobytes() for o in out], pa.binary()),
                pa.array([np.array(o[1], np.float32).tobytes() for o in out], pa.binary()),
                pa.array([o[2] for o in out], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "buckets", "amounts", "statistic"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), key=lambda r: (r[1], r[2], r[0], r[3]))
        words = np.zeros((len(rows), BUCKETS), np.float16)
        for k, (_, buckets, amounts, _) in enumerate(rows):
            words[k, np.frombuffer(buckets, np.int32)] = np.frombuffer(amounts, np.float32)
        statistic = np.array([r[3] for r in rows], float).reshape(-1, len(STATISTICS))
        machine = fit(words, statistic, np.array([r[0] for r in rows], float))
        parts = [np.array([machine.bias]), machine.mean, machine.scale, machine.weights, machine.vectors]
        yield pa.RecordBatch.from_pydict({"parts": pa.array([[p.astype("<f8").tobytes() for p in parts]], pa.list_(pa.binary()))})

    features = sample.select("text", "stated", "label").mapInArrow(inputs, "label int, buckets binary, amounts binary, statistic array<double>")
    found = features.repartition(1).mapInArrow(fitted, "parts array<binary>").collect()
    if not found:
        return fit(np.zeros((0, BUCKETS)), np.zeros((0, len(STATISTICS))), np.zeros(0))
    bias, mean, scale, weights, vectors = (np.frombuffer(bytes(p), "<f8") for p in found[0].parts)
    return Machine(float(bias[0]), weights.astype(np.float32), vectors.astype(np.float32).reshape(-1, FACTORS), mean, scale)


def _with_length(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", stated.alias("stated"))


def quality(machine: Machine, text: Column, stated: Column) -> Column:
    @pandas_udf(DoubleType())
    def scored(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts.tolist(), lengths.tolist()), dtype="float64")

    return scored(text, stated)


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of every row of `docs` (doc_id, text, n_chars if there). A null text is empty, an empty one has
    a score too; repeated rows are scored alike, a null n_chars counts as not stated. Other columns are not read."""
    rows = _with_length(docs)
    return rows.select("doc_id", quality(machine, F.col("text"), F.col("stated")).alias("score"))
