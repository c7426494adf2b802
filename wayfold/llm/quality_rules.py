"""Quality rules: counts per text, hard limits on two of them, and an isolation forest over shares of them.

Trees split at random places of random shares; a text that such splits part from the good ones after few steps is odd. The trees are grown on
the good rows of a bounded labelled sample, with places drawn from the range that all its rows span, so that what no good text has is
parted at once. How short the mean path may be is set from the labels of the same rows: the cut keeps nearly all good rows and
removes as many of the others as it can.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .words import give_back

# Fixed values of the base rules.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # of 100 words
RUN = 3  # words of a repeated window

#: The forest and the cut are fitted on this many labelled rows, those with the smallest hashes of doc_id and label.
SAMPLE = 20_000
TREES = 100
TREE_ROWS = 1024
DEPTH = 16
#: Of the rows labelled good, this share at most may fall below the cut.
MOST_GOOD_LOST = 0.0005
SEED = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("chars_per_word", "symbols", "repeated_words", "upper", "exclamations", "distinct_words", "capped_words", "marks_per_word")
STATISTICS = StructType([StructField(n, LongType()) for n in COUNTS] + [StructField("shares", ArrayType(DoubleType()))])

_MARK = re.compile(r"[.,;:?]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(numbers: np.ndarray, run: int = RUN) -> int:
    """How many words lie in windows of `run` words that occur twice or more; `numbers` has a number for each word."""
    n = len(numbers) - run + 1
    if n < 2:
        return 0
    key = numbers[:n].astype(np.int64)
    for k in range(1, run):
        following = numbers[k : k + n].astype(np.int64)
        # Numbers stay below the count of words, so that a pair fits whatever the length of the text.
        key = np.unique(key * (int(following.max()) + 1) + following, return_inverse=True)[1].astype(np.int64)
    often = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(len(numbers), bool)
    for k in range(run):
        covered[often + k] = True
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """The counts of COUNTS and the list of SHARES of a text; null is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six characters of SPACES alone
    n = len(words)
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = repeated_words(numbers)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    n_lines = sum(lines.values())
    duplicates = n_lines - len(lines)
    some = max(n, 1)
    shares = [
        chars / some,
        math.log1p(100 * symbols / some),
        repeated / some,
        len(_CAPITAL.findall(text)) / max(chars, 1),
        math.log1p(100 * text.count("!") / some),
        len(known) / some,
        sum(w.isupper() for w in words) / some,
        len(_MARK.findall(text)) / some,
    ]
    return n, chars, symbols, duplicates, repeated, shares


@pandas_udf(STATISTICS)
def text_statistics(text: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([statistics(t) for t in text], columns=[*COUNTS, "shares"])
    give_back()
    return found


@dataclass
class Forest:
    """Complete arrays of trees: `feature` is -1 at a leaf, `value` is there the path length; children of node i are at `left` and `left` + 1."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: int
    cut: float

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row over the trees."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, value, left in zip(self.feature, self.value, self.left):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[at_row, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, left[node] + right, node)
            total += value[node]
        return total / len(self.feature)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[list[int], list[float], list[int]]:
    feature, value, left = [-1], [0.0], [0]
    todo = [(0, rows, 0, low, high)]
    while todo:
        node, part, level, low, high = todo.pop()
        wide = np.flatnonzero(high > low)
        if level >= depth or len(part) < 2 or not len(wide):
            value[node] = level + _expected(len(part))
            continue
        f = int(rng.choice(wide))
        split = float(rng.uniform(low[f], high[f]))
        right = part[:, f] >= split
        feature[node], value[node], left[node] = f, split, len(feature)
        below, above = high.copy(), low.copy()
        below[f] = above[f] = split
        todo += [(len(feature), part[~right], level + 1, low, below), (len(feature) + 1, part[right], level + 1, above, high)]
        feature += [-1, -1]
        value += [0.0, 0.0]
        left += [0, 0]
    return feature, value, left


def fit(rows: np.ndarray, good: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, most_good_lost: float = MOST_GOOD_LOST) -> Forest:
    """A forest over `rows` (one line of SHARES each) and its cut from `good` (booleans). Without rows of both kinds the cut keeps everything."""
    if not good.any() or good.all():
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), np.int64), 1, -math.inf)
    rng = np.random.default_rng(SEED)
    normal, low, high = rows[good], rows.min(0), rows.max(0)
    grown = [_tree(normal[rng.choice(len(normal), min(tree_rows, len(normal)), replace=False)], low, high, rng, depth) for _ in range(trees)]
    most = max(len(t[0]) for t in grown)
    pad = lambda part, fill: np.array([t[part] + [fill] * (most - len(t[part])) for t in grown])
    forest = Forest(pad(0, -1), pad(1, 0.0), pad(2, 0), depth, -math.inf)
    length = forest.paths(rows)
    kept = np.sort(length[good])
    worst = kept[int(most_good_lost * len(kept))]
    # Halfway between the worst good row that stays and the next odd row below it, so that rows like either are on its side.
    below = length[~good & (length < worst)]
    if len(below):
        forest.cut = float((worst + below.max()) / 2)
    return forest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *more: str) -> DataFrame:
    """doc_id, text, label and columns `more` of `docs`: at most `rows` labelled rows outside the held-out fold (crc32 of the id modulo 5 is
    0), those with the smallest hashes. Rows with a null id, text or label are left out; of texts that share an id, the first in order is taken."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where((fold != 0) & F.col("label").isin(0, 1)).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", F.struct("text", *more).alias("row")).where("row.text is not null").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("doc_id", "row.*", "label")


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Forest:
    """Forest and cut from at most `rows` rows of `labels` (doc_id, quality) and their `docs`, those of them that pass the base rules; shares alone
    reach the driver."""
    counted = labelled_sample(docs, labels, "quality", rows).select("label", text_statistics(F.col("text")).alias("s")).select("label", "s.*")
    sample = counted.where(~base_failed()).select("label", "shares").collect()
    return fit(np.array([r.shares for r in sample]).reshape(-1, len(SHARES)), np.array([r.label == 1 for r in sample], bool))


def path_length(forest: Forest, shares: Column) -> Column:
    @pandas_udf(DoubleType())
    def length(column: pd.Series) -> pd.Series:
        return pd.Series(forest.paths(np.stack(column.to_numpy())) if len(column) else [], dtype="float64")

    return length(shares)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """`docs` with a column `rules`: the counts, `path_length`, `base_failed` and `kept`. Every row stays, repeated ones and null ids too; a null
    or empty text has no words and fails. A column of that name is replaced."""
    names = [*COUNTS, "path_length", "base_failed"]
    inner = docs.select(F.struct(*docs.columns).alias("row"), text_statistics(F.col("text")).alias("s")).select("row", "s.*")
    inner = inner.withColumn("path_length", path_length(forest, F.col("shares"))).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("path_length") >= F.lit(forest.cut))
    rules = F.struct(*names, kept.alias("kept"))
    return inner.select("row", rules.alias("rules")).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "rules"], "rules")
