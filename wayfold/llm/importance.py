"""Importance resampling towards a target: hashed runs of words, counted once per distinct line.

Newlines cut texts into lines. A distinct line's features, the buckets of its runs of words, are computed once and written with the number of the line's
occurrences; bucket totals are these counts times the occurrences. Runs that cross a newline belong to no line: they are taken from the
documents and added separately. A document's weight is the sum of its lines' weights, joined by line, and of its crossing runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import with_rank
from ..session import discard
from .steps import blocks, flat_bytes, picked, step

BUCKETS = 10_000
LEAST_WORDS, SHARE, SEED = 20, 10, "2024"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
LINES = "h1 long, h2 long, occurrences long, n_words long, buckets binary"


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of `texts`, A-Z in lower case, and the place where each text's begin (one more entry than texts)."""
    data, bounds = flat_bytes(texts)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    begins[edges] = inside[edges]
    kept = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begins)
    offsets = np.append(kept[starts], kept[-1]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return found.dictionary_encode(), np.searchsorted(starts, bounds).astype(np.int64)


def features(texts: pa.Array, lines: np.ndarray | None, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to `longest` words of each text, and the number of words of each text.

    With `lines`, the number of a line for each word, only the runs that begin and end in different lines.
    """
    coded, bounds = words(texts)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = coded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out = []
    for size in range(1 if lines is None else 2, longest + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        whole = owner[:n] == owner[size - 1 :]
        if lines is not None:
            whole &= lines[:n] != lines[size - 1 :]
        at = np.flatnonzero(whole)
        if size == 1:
            runs, which = np.arange(len(known))[:, None], codes
        else:
            runs, which = np.unique(np.stack([codes[at + k] for k in range(size)], 1), axis=0, return_inverse=True)
        hashed = np.fromiter((zlib.crc32(b" ".join([known[c] for c in run])) % buckets for run in runs.tolist()), np.int64, len(runs))
        out.append((owner[at], hashed[which.reshape(-1)]))
    text = np.concatenate([np.empty(0, np.int64), *(x for x, _ in out)])
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate([np.empty(0, np.int64), *(x for _, x in out)])[order], np.diff(bounds)


def _packed(text: np.ndarray, bucket: np.ndarray, n: int) -> pa.Array:
    """The buckets of each of `n` texts as little-endian unsigned 32-bit numbers."""
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int64) * 4
    body = bucket.astype("<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.binary())


def line_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """LINES: a row per distinct line of `texts` (text), with its features. Written."""
    lines = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("occurrences"))
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "occurrences", "line")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 3, 4 << 20):
                text, bucket, n_words = features(part.column(3), None, longest, buckets)
                columns = [*part.columns[:3], pa.array(n_words, pa.int64()), _packed(text, bucket, part.num_rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "occurrences", "n_words", "buckets"])

    return step(hashed.mapInArrow(found, LINES))


def crossing_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """`texts` (row, text) with `crossing`: the buckets of each text's runs of words that cross a newline."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, 4 << 20):
                data, bounds = flat_bytes(part.column(1))
                inside = _IS_WORD[data]
                begins = inside & ~np.concatenate([[False], inside[:-1]])
                edges = bounds[:-1][np.diff(bounds) > 0]
                begins[edges] = inside[edges]
                text, bucket, _ = features(part.column(1), np.cumsum(data == 0x0A)[begins], longest, buckets)
                yield pa.RecordBatch.from_arrays([*part.columns, _packed(text, bucket, part.num_rows)], names=["row", "text", "crossing"])

    return texts.select("row", "text").mapInArrow(found, "row long, text string, crossing binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed buckets of all rows, one after another, and the row of each."""
    data, bounds = flat_bytes(column)
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), np.repeat(np.arange(len(column)), np.diff(bounds) // 4)


def bucket_totals(counted: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: over the rows of `counted` (occurrences, buckets), each counted as often as it occurs. Buckets without features have no row."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, row = _numbers(batch.column(1))
            np.add.at(total, bucket, batch.column(0).to_numpy()[row])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some])})

    partial = counted.select("occurrences", "buckets").mapInArrow(summed, "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight, from the totals of the corpus and of the target.

    One number for each bucket is all that reaches the driver.
    """
    spark = own.sparkSession
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = step(every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", s.alias("s"), t.alias("t")))
    sums = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = (F.col("t") + 1) * F.lit(sums["S"] + buckets) / ((F.col("s") + 1) * F.lit(sums["T"] + buckets))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    return np.array([gain for _, gain in sorted(map(tuple, rows))], np.int64)


def _weighed(rows: DataFrame, keys: str, column: str, gain: np.ndarray) -> DataFrame:
    """`rows` (three columns named in `keys`, and the packed buckets `column`) with n_features and weight in place of the buckets."""
    names = [part.split()[0] for part in keys.split(",")]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, row = _numbers(batch.column(len(names)))
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gain[bucket])
            columns = [*batch.columns[: len(names)], pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64()), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_features", "weight"])

    return rows.select(*names, column).mapInArrow(weigh, f"{keys}, n_features long, weight long")


def _totals(docs: DataFrame, longest: int, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(lines with features, bucket totals, crossing features of each row or none if runs are single words)."""
    lines = line_features(docs, longest, buckets)
    counted = lines.select("occurrences", "buckets")
    crossing = None
    if longest > 1:
        crossing = step(crossing_features(docs, longest, buckets).select("row", "crossing"))
        counted = counted.unionByName(crossing.select(F.lit(1).cast("long").alias("occurrences"), F.col("crossing").alias("buckets")))
    return lines, bucket_totals(counted, buckets), crossing


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of `docs` (doc_id, text), drawn towards `target` (text). Written."""
    # Row numbers are written with what they number, as another run of the same scan may give others.
    texts = picked(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    if longest > 1:
        texts = step(texts)
    lines, own, crossing = _totals(texts.select("row", "text"), longest, buckets)
    wanted, other, _ = _totals(picked(target, "text").withColumn("row", F.monotonically_increasing_id()), longest, buckets)
    gain = gains(own, other, buckets)
    weighed = step(_weighed(lines, "h1 long, h2 long, n_words long", "buckets", gain))
    discard(lines, wanted)
    cut_up = texts.select("row", "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    placed = step(cut_up.select("row", "doc_id", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    parts = step(placed.join(weighed, ["h1", "h2"]).select("row", "doc_id", "n_words", "n_features", "weight"))
    discard(placed, weighed)
    if crossing is not None:
        more = _weighed(crossing, "row long", "crossing", gain).join(texts.select("row", "doc_id"), "row")
        parts = parts.unionByName(more.select("row", "doc_id", F.lit(0).cast("long").alias("n_words"), "n_features", "weight"))
    return step(parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]).drop("row"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    share: int = SHARE,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of `docs` (doc_id, text); `share` percent of the rows with at least `least_words`
    words are drawn without replacement towards `target` (text), by hashed Gumbel noise, and get a rank.

    A null or empty text has no features, weight 0 and is not drawn (unless `least_words` is 0). A null doc_id counts as an empty string in the hash and comes after
    others in ties; rows that repeat a doc_id are scored one by one and take ranks of their own. A very long text, or line, is one row. An empty `docs` gives no rows; an
    empty target has no features, and all gains come from the corpus. Other columns are not read.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long").cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + gumbel)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share // 100
    ranked = with_rank(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
