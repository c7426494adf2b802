"""Toxic texts by a support vector machine with a subsequence string kernel.

The kernel of two short strings sums over all common subsequences of three letters, each weighted by DECAY for every place it spans in either
string, so that letters put in between, left out or set apart with marks cost a little and no more. Kernel values with a fixed set of
landmark strings, whitened by the landmarks' own kernel matrix (Nystroem), are the inputs of a linear machine.

It is trained on labelled sentences: every unit of a sentence in a text not marked toxic is a negative, and in a text marked so one unit, its witness, is
a positive. Witnesses begin as the units that are most often seen in toxic texts alone, and are then chosen by the machine. The WORST units of a
text give its score. Units are words, runs of very short words joined ("i d i o t"), and long words in overlapping pieces.
"""

from __future__ import annotations

import re
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

from .quality_rules import labelled_sample

DECAY = 0.7
LENGTH = 3
PIECE = 20  # letters and marks of a unit at most
#: A landmark meets a unit only if at least this share of its distinct letters are in it; below, the kernel counts as nothing.
SUPPORT = 0.75
LANDMARKS = 64
#: A witness is this many times (as a logarithm) likelier in a toxic text than in another at least.
LEAST_ODDS = 1.5
WORST = 3  # units that decide a text's score
#: The machine is fitted on this many labelled rows, those with the smallest hashes of id and label, and this many negative units of them.
SAMPLE = 12_000
NEGATIVES = 12_000
ROUNDS = 3
COST = 3000.0
SEED = 3

_SHORT_RUN = re.compile(r"(?<!\S)(?:\S{1,2}[^\S\n]+){2,}\S{1,2}(?!\S)")
# Marks that are taken off the ends of a word.
_ENDS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’¿¡…–—"""


def text_units(text: str | None) -> set[str]:
    """Strings of a text that are judged, in lower case and without marks at their ends. Words and runs of short words do not
    cross lines or sentences, so that the units of a text are those of its sentences."""
    if not text:
        return set()
    text = text.lower()
    out = {w.strip(_ENDS) for w in set(text.split())}
    for run in _SHORT_RUN.finditer(text):
        out.update("".join(part.split()).strip(_ENDS) for part in re.split(r"[.!?]\s", run[0]))
    out = {u for u in out if len(u) >= LENGTH}
    for u in [u for u in out if len(u) > PIECE]:
        out.discard(u)
        out.update(u[k : k + PIECE] for k in range(0, len(u) - PIECE // 2, PIECE // 2))
    return out


def coded(strings: list[str]) -> np.ndarray:
    """Code points of letters and digits, one row per string, filled up with zeros; other marks are zero as well, and match nothing."""
    width = max((len(s) for s in strings), default=1)
    joined = "".join(s.ljust(width, "\0") for s in strings)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width)
    marks = [c for c in set(joined) if not c.isalnum()]
    return np.where(np.isin(codes, np.array([ord(c) for c in marks], np.uint32)), 0, codes) if marks else codes


def _masks(codes: np.ndarray) -> np.ndarray:
    """The letters of each string as bits; different letters may share one of the 63 bits."""
    bits = np.where(codes > 0, np.uint64(1) << (codes.astype(np.uint64) % np.uint64(63)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1) if codes.size else np.zeros(len(codes), np.uint64)


def kernel(codes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sum over common subsequences of LENGTH letters of `other` (one string) and each row of `codes`, by the usual recursion
    over prefixes, for all rows at once."""
    other = other[: np.max(np.flatnonzero(other), initial=-1) + 1]
    n, m = len(codes), len(other)
    if not m:
        return np.zeros(n)
    gaps = np.arange(m)[None, :] - np.arange(m)[:, None]
    spread = np.where(gaps >= 0, DECAY ** np.maximum(gaps, 0), 0.0).astype(np.float32) * np.float32(DECAY**2)
    before = [np.ones((n, m), np.float32)] + [np.zeros((n, m + 1), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(n, np.float32)
    for place in range(codes.shape[1]):
        same = ((codes[:, place, None] == other[None, :]) & (other[None, :] > 0)).astype(np.float32)
        total += np.float32(DECAY**2) * (same * before[LENGTH - 1][:, :m]).sum(1)
        for k in range(LENGTH - 1, 0, -1):
            grown = (same * before[k - 1][:, :m]) @ spread
            before[k] *= np.float32(DECAY)
            before[k][:, 1:] += grown
    return total.astype(float)


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row of `codes` with itself: the same recursion, with a string of its own on the other side."""
    out = np.zeros(len(codes))
    # Rows of about one length together: the work of a row is the cube of the width.
    used = np.where((codes > 0).any(1), codes.shape[1] - np.argmax(codes[:, ::-1] > 0, axis=1), 0)
    for low, m in ((0, 8), (8, 12), (12, codes.shape[1])):
        rows = np.flatnonzero((used > low) & (used <= m))
        if not len(rows):
            continue
        part = codes[rows, :m]
        m = part.shape[1]
        gaps = np.arange(m)[None, :] - np.arange(m)[:, None]
        spread = np.where(gaps >= 0, DECAY ** np.maximum(gaps, 0), 0.0).astype(np.float32) * np.float32(DECAY**2)
        before = [np.ones((len(rows), m), np.float32)] + [np.zeros((len(rows), m + 1), np.float32) for _ in range(LENGTH - 1)]
        total = np.zeros(len(rows), np.float32)
        for place in range(m):
            same = ((part[:, place, None] == part) & (part > 0)).astype(np.float32)
            total += np.float32(DECAY**2) * (same * before[LENGTH - 1][:, :m]).sum(1)
            for k in range(LENGTH - 1, 0, -1):
                grown = (same * before[k - 1][:, :m]) @ spread
                before[k] *= np.float32(DECAY)
                before[k][:, 1:] += grown
        out[rows] = total
    return out


def similarity(strings: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each string with each landmark (rows of codes), zero beyond SUPPORT."""
    out = np.zeros((len(strings), len(landmarks)))
    if not len(strings):
        return out
    codes = coded(strings)
    masks, marks = _masks(codes), _masks(landmarks)
    for k, (mark, wanted) in enumerate(zip(marks, np.maximum(np.ceil(SUPPORT * np.bitwise_count(marks)), 1))):
        rows = np.flatnonzero(np.bitwise_count(masks & mark) >= wanted)
        if len(rows):
            out[rows, k] = kernel(codes[rows], landmarks[k])
    some = np.flatnonzero(out.any(1))
    if len(some):
        scale = np.sqrt(self_kernel(codes[some])[:, None] * self_kernel(landmarks)[None, :])
        out[some] = np.divide(out[some], scale, out=np.zeros_like(scale), where=scale > 0)
    return out


@dataclass
class Machine:
    landmarks: np.ndarray  # codes, one row each
    weights: np.ndarray  # one per landmark, whitening included
    bias: float
    slopes: np.ndarray  # from the values of the worst units, worst first, to a probability
    offset: float

    def values(self, strings: list[str], block: int = 20_000) -> np.ndarray:
        found = [similarity(strings[k : k + block], self.landmarks) @ self.weights for k in range(0, len(strings), block)]
        return np.concatenate([np.zeros(0), *found]) + self.bias

    def score(self, texts: list) -> np.ndarray:
        """Probability that each text is toxic: that of its worst units; places without a unit count like the plainest one."""
        per_text = [text_units(t) for t in texts]
        strings = list(set().union(*per_text))
        value = self.values(strings)
        # Few units are like any landmark; all others have the value of the bias.
        near = {strings[k]: float(value[k]) for k in np.flatnonzero(value > self.bias)}
        worst = np.array([_worst([near[u] for u in us & near.keys()], self.bias) for us in per_text]).reshape(-1, WORST)
        return _probability(worst @ self.slopes + self.offset)


def _worst(values: list[float], least: float) -> list[float]:
    """The largest values, cut to a range in which a machine's values mean something, `least` where there are fewer."""
    return [min(max(v, least), 1.5) for v in sorted(values, reverse=True)[:WORST]] + [least] * (WORST - len(values))


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _linear(inputs: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the squared hinge loss with a squared penalty, by Newton steps on the rows inside the margin."""
    x = np.hstack([inputs, np.ones((len(inputs), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        inside = label * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(penalty + a.T @ x[inside], a.T @ label[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the probability of a label of one given rows of values, with both classes' targets drawn in a little."""
    n, p = (label == 0).sum(), (label == 1).sum()
    target = np.where(label == 1, (p + 1) / (p + 2), 1 / (n + 2))
    mean, scale = values.mean(0), np.maximum(values.std(0), 1e-6)
    x = np.hstack([(values - mean) / scale, np.ones((len(values), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = _probability(x @ w)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (q - target) + 1e-2 * w)
        w -= np.clip(step, -4, 4)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def disguises(word: str, rng: np.random.Generator) -> list[str]:
    """`word` with marks between its letters, and with a letter put in."""
    k = int(rng.integers(1, len(word)))
    return [".".join(word), f"{word[:k]}-{word[k:]}", f"{word[:k]}{'x*1'[int(rng.integers(3))]}{word[k:]}"]


def fit(texts: list[str], toxic: np.ndarray) -> Machine:
    """A machine from texts and their labels (0 or 1). Without texts of both kinds every text scores the share of toxic ones."""
    rng = np.random.default_rng(SEED)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    nothing = Machine(np.zeros((1, 1), np.uint32), np.zeros(1), 0.0, np.zeros(WORST), float(np.log(share / (1 - share))))
    bags = [text_units(t) for t in texts]
    seen, clean = Counter(), Counter()
    for bag, label in zip(bags, toxic):
        (seen if label else clean).update(bag)
    marked = [sorted(bag) for bag, label in zip(bags, toxic) if label and bag]
    if not marked or not clean:
        return nothing
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    odds = {u: np.log((k + 0.5) / n_toxic) - np.log((clean[u] + 0.5) / n_clean) for u, k in seen.items()}
    value = {u: odds[u] * np.sqrt(seen[u]) for u in seen}
    plain = sorted(clean, key=lambda u: (-clean[u], u))
    picked = plain[: NEGATIVES // 4] + [plain[k] for k in sorted(rng.permutation(len(plain))[: NEGATIVES // 2]) if k >= NEGATIVES // 4]
    hard: list[str] = []
    machine = nothing
    for _ in range(ROUNDS):
        witnesses = Counter(u for bag in marked for u in sorted(bag, key=lambda u: (-value[u], u))[:WORST])
        # A unit that clean texts have as well is no witness of anything.
        positives = [u for u, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0])) if odds[u] > LEAST_ODDS and len(u) >= LENGTH]
        if not positives:
            return nothing
        landmarks = _landmarks(witnesses, positives, hard)
        z = coded(landmarks)
        own = similarity(landmarks, z)
        own = (own + own.T) / 2
        eigen, basis = np.linalg.eigh(own)
        keep = eigen > 1e-2 * eigen[-1]
        whiten = basis[:, keep] / np.sqrt(eigen[keep])
        masked = [(d, witnesses[u] / 6) for u in positives for d in disguises(u, rng)]
        bad = list(dict.fromkeys(picked + hard))
        strings = positives + [d for d, _ in masked] + bad
        # Each side weighs by how many of its texts have the unit.
        amount = np.array([witnesses[u] / n_toxic for u in positives] + [n / n_toxic for _, n in masked] + [(clean[u] + 0.5) / n_clean for u in bad]) * COST
        label = np.where(np.arange(len(strings)) < len(strings) - len(bad), 1.0, -1.0)
        w, bias = _linear(similarity(strings, z) @ whiten, label, amount)
        machine = Machine(z, whiten @ w, bias, np.zeros(WORST), 0.0)
        # Look again: the worst clean units become negatives, the worst unit of each toxic text its witness.
        of_clean = machine.values(plain)
        hard = [plain[k] for k in np.argsort(-of_clean, kind="stable")[: NEGATIVES // 4]]
        worst = dict(zip(plain, of_clean))
        rest = [u for u in seen if u not in worst]
        worst.update(zip(rest, machine.values(rest)))
        value = {u: worst[u] + 0.1 * min(odds[u], 3) for u in seen}
    machine.slopes, machine.offset = _logistic(np.array([_worst([worst[u] for u in bag], machine.bias) for bag in bags]), toxic)
    return machine


def _landmarks(witnesses: Counter, positives: list[str], hard: list[str]) -> list[str]:
    """Witnesses, each time the one with most texts for its distance from those taken before; then the clean units most like them."""
    positives = positives[:500]
    codes, weight = coded(positives), np.array([witnesses[u] for u in positives], float)
    nearest, taken = np.zeros(len(positives)), []
    while len(taken) < min(LANDMARKS * 3 // 4, len(positives)):
        k = int(np.argmax(weight * (1 - nearest)))
        if taken and nearest[k] > 0.95:
            break
        taken.append(positives[k])
        nearest = np.maximum(nearest, similarity(positives, codes[k : k + 1])[:, 0])
        nearest[k] = 1.0
    return taken + [u for u in hard if u not in taken][: LANDMARKS - len(taken)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """A machine from at most `rows` rows of `labels` (doc_id, toxic) outside the held-out fold and their `docs`, fitted in one task on
    that bounded sample; landmarks and weights alone reach the driver."""
    sample = labelled_sample(docs, labels, "toxic", rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        m = fit([r[0] for r in rows], np.array([r[1] for r in rows], int))
        parts = [m.landmarks.astype("<u4"), m.weights.astype("<f8"), np.array([m.bias, m.offset, *m.slopes], "<f8")]
        yield pa.RecordBatch.from_pydict({"parts": pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))})

    found = sample.select("text", "label").repartition(1).mapInArrow(fitted, "parts array<binary>").collect()
    if not found:
        return fit([], np.zeros(0, int))
    landmarks, weights, rest = (bytes(p) for p in found[0].parts)
    w = np.frombuffer(weights, "<f8")
    bias, offset, *slopes = np.frombuffer(rest, "<f8").tolist()
    return Machine(np.frombuffer(landmarks, "<u4").reshape(len(w), -1), w, bias, np.array(slopes), offset)


def toxicity(machine: Machine, text: Column) -> Column:
    @pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts.tolist()), dtype="float64")

    return scored(text)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row of `docs` (doc_id, text). A null text is empty; a text without units of three letters
    scores lowest. Repeated rows are scored alike. Other columns are not read."""
    return docs.select("doc_id", toxicity(machine, F.col("text")).alias("score"))
