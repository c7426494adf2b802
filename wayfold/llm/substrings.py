"""Repeated passages: windows of words that also start in a document with a smaller id, found with FM-indexes.

A full index of the corpus would have to meet every document; instead, stretches of text that can repeat are brought together first. Every window
has an anchor, the least hash among its short runs of words; equal windows have equal anchors at equal places. Neighbouring windows that
share their anchor form a stretch. Stretches whose anchor one document alone has are dropped, equal ones become one, and the rest is
dealt by anchor to shards of bounded size. Each shard builds a compressed FM-index of its stretches (suffixes in order, Burrows-Wheeler transform in a
wavelet matrix of packed bits) and streams its stretches through it by backward search: matching statistics, cut at the window's length, give
for every window the interval of its occurrences, and that the smallest document among them.

An anchor with very many different stretches (the rim of a passage that very many texts quote) does not fit a shard. Its windows are taken by longer anchors
in a second pass, in which the anchor is the window itself, so that a group is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import BASE, mixed, rolled, within, word_hashes

WINDOW = 50
ANCHOR = 10
#: Stretches per shard, and how many an anchor may have before its windows are dealt one by one.
SHARD = 5_000
CROWD = 2_000
KEY = ["doc_id", "text_hash"]
STRETCH = "doc_id long, text_hash long, anchor long, low int, high int, content long"


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The leftmost place of the least of every `span` values in a row."""
    place, best, width = np.arange(len(values)), values, 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        place = np.where(right < left, place[step:], place[:-step])
        best, width = np.minimum(left, right), width + step
    return place


def _prefix_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes times powers of BASE up to each place, and the inverse powers."""
    n = len(hashes)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE))])[:n]
    inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))])
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)]), inverses


def stretches(hashes: np.ndarray, bounds: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, low, high, content) of all stretches of the texts: windows low..high (places in the text) have the anchor in common.
    `content` is a hash of the words from `low` to the end of window `high`."""
    starts = np.flatnonzero(within(bounds, len(hashes), size))
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    runs = rolled(hashes, anchor)
    at = _least(runs, size - anchor + 1)[starts]
    text = np.searchsorted(bounds, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(text) != 0)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    low, high = starts[new], starts[last]
    sums, inverses = _prefix_hash(hashes)
    content = mixed((sums[high + size] - sums[low]) * inverses[low] + (high - low).astype(np.uint64))
    base = bounds[text[new]]
    return text[new], runs[at[new]].view(np.int64), low - base, high - base, content.view(np.int64)


class WaveletMatrix:
    """Numbers below 2^levels with rank queries; bits are packed, with a count per 64."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        self.n = len(values)
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each value occurs before `low` and before `high`."""
        begin = np.zeros(len(value), np.int64)
        at = np.stack([begin, low, high])
        for k, (words, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros)):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & mask)
            set_ = ((value >> (self.levels - 1 - k)) & 1).astype(bool)
            at = np.where(set_, zeros + ones, at - ones)
        return at[1] - at[0], at[2] - at[0]


class Index:
    """FM-index of several strings of numbers for patterns of up to `size` of them."""

    def __init__(self, strings: list[np.ndarray], owners: np.ndarray, size: int):
        self.size = size
        lengths = np.array([len(s) for s in strings], np.int64)
        flat = np.concatenate(strings)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        # Zero parts the strings and ends the last; no pattern has it.
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(lengths.sum() + len(strings)), np.int32)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = codes + 1
        n = len(text)
        self.text, self.begin, self.lengths = text, ends - lengths, lengths
        # Suffixes in the order of their first `depth` numbers, by doubling: enough for patterns of `size`.
        half = 1 << (size - 1).bit_length() - 1 if size > 1 else 1
        ranks, depth = text, 1
        while depth < size + 1:
            if depth == half:
                at_half = ranks
            key = ranks * np.int64(int(ranks.max()) + 2)
            key[: n - depth] += ranks[depth:] + 1
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            ranks = np.empty(n, np.int32)
            ranks[order] = np.concatenate([np.zeros(1, np.int32), np.cumsum(key[1:] != key[:-1], dtype=np.int32)])
            depth *= 2
        self.order = order
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.matrix = WaveletMatrix(before, self.levels)
        # Blocks of suffixes that agree in their first size - 1 (and size) numbers: two overlapping runs of half the depth tell.
        self.shorter = self._blocks(at_half, size - 1 - half)
        whole = self._blocks(at_half, size - half) if size <= 2 * half else self._blocks(ranks, 0)
        of_text = np.repeat(np.arange(len(strings)), lengths + 1)
        edges = np.unique(whole[0])
        self.least = edges, np.minimum.reduceat(owners[of_text[order]], edges)

    def _blocks(self, ranks: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each suffix's block, by place in the order."""
        a = ranks[self.order]
        moved = np.full(len(ranks), -1, np.int32)
        moved[: len(ranks) - shift] = ranks[shift:]
        b = moved[self.order]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])
        number = np.cumsum(new) - 1
        edges = np.concatenate([np.flatnonzero(new), [len(ranks)]])
        return edges[number], edges[number + 1]

    def smallest(self, low: np.ndarray) -> np.ndarray:
        """The least owner in the intervals of whole patterns that begin at `low`."""
        edges, least = self.least
        return least[np.searchsorted(edges, low)]

    def stream(self) -> list[np.ndarray]:
        """For every string, and each of its windows of `size`, the least owner of a string with that window.

        All strings go through backward search side by side, from their ends; a match that has reached `size` loses its last number, that is, its interval
        widens to the block of what is left, before it takes the next.
        """
        out = [np.full(max(0, n - self.size + 1), -1, np.int64) for n in self.lengths.tolist()]
        flat = np.concatenate(out) if out else np.empty(0, np.int64)
        offset = np.cumsum([0, *(len(o) for o in out)])
        order = np.argsort(-self.lengths, kind="stable")
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        matched = np.zeros(len(order), np.int64)
        sizes = self.lengths[order]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, side="left"))  # strings longer than `step`
            rows = order[:active]
            place = sizes[:active] - 1 - step
            value = self.text[self.begin[rows] + place].astype(np.int64)
            full = matched[:active] == self.size
            low[:active] = np.where(full, self.shorter[0][low[:active]], low[:active])
            high[:active] = np.where(full, self.shorter[1][np.maximum(high[:active] - 1, 0)], high[:active])
            matched[:active] -= full
            a, b = self.matrix.rank(value, low[:active], high[:active])
            low[:active], high[:active] = self.first[value] + a, self.first[value] + b
            matched[:active] += 1
            assert (high[:active] > low[:active]).all()
            done = np.flatnonzero(matched[:active] == self.size)
            flat[offset[rows[done]] + place[done]] = self.smallest(low[done])
        return [flat[a:b] for a, b in zip(offset[:-1], offset[1:])]


def _stretch_rows(docs: DataFrame, size: int, anchor: int, ranges: DataFrame | None = None) -> DataFrame:
    """All stretches of `docs` (doc_id, text_hash, text); with `ranges` (KEY, ranges), those of the windows in a document's ranges."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                hashes, bounds = word_hashes(part.column(2))
                text, key, low, high, content = stretches(hashes, bounds, size, anchor)
                if part.num_columns > 3 and len(text):
                    wanted = np.zeros(len(hashes) + 1, np.int64)
                    for begin, spans in zip(bounds.tolist(), part.column(3).to_pylist()):
                        for span in spans:
                            wanted[begin + span["low"]] += 1
                            wanted[begin + span["high"] + 1] -= 1
                    keep = np.cumsum(wanted)[bounds[text] + low] > 0
                    text, key, low, high, content = (x[keep] for x in (text, key, low, high, content))
                arrays = [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(key), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(content)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "anchor", "low", "high", "content"])

    rows = docs.select(*KEY, "text") if ranges is None else docs.select(*KEY, "text").join(ranges, KEY).select(*KEY, "text", "ranges")
    return rows.mapInArrow(found, STRETCH)


def _words_of(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """`chosen` (KEY, anchor, content, low, high) with the hashes of the stretch's words as bytes."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, bounds = word_hashes(part.column(1))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, begin, wanted in zip(part.column(0).to_pylist(), bounds.tolist(), part.column(2).to_pylist()):
                    for w in wanted:
                        values = (doc_id, w["anchor"], w["content"], hashes[begin + w["low"] : begin + w["high"] + size].tobytes())
                        for column, value in zip(out, values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["doc_id", "anchor", "content", "words"])

    lists = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "content", "low", "high")).alias("wanted"))
    # Rows that repeat a document would list its stretches again.
    rows = docs.join(lists, KEY).select(*KEY, "text", "wanted").select("doc_id", "text", "wanted")
    return rows.mapInArrow(taken, "doc_id long, anchor long, content long, words binary")


def _searched(words: DataFrame, shards: int, size: int) -> DataFrame:
    """anchor, content, least: for the windows of each stretch, one after another, the least document that has the window."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby(["anchor", "content"], as_index=False, sort=True).agg({"doc_id": "min", "words": "first"})
        index = Index([np.frombuffer(w, np.uint64) for w in rows["words"]], rows["doc_id"].to_numpy(np.int64), size)
        return pd.DataFrame({"anchor": rows["anchor"], "content": rows["content"], "least": index.stream()})

    dealt = words.withColumn("shard", F.pmod("anchor", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "anchor long, content long, least array<long>")


def _pass(docs: DataFrame, size: int, anchor: int, ranges: DataFrame | None, crowd: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Repeated windows (KEY, low, high) of documents, and the ranges of windows whose anchors are too crowded. Both written."""
    rows = cut(_stretch_rows(docs, size, anchor, ranges))
    # One row per anchor and task moves; written, so that the joins below can be split.
    shared = cut(rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    rows = cut(rows.join(shared, "anchor"))
    distinct = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_hash", "low", "high")).alias("r"))
    distinct = cut(distinct.select("anchor", "content", "r.*"))
    crowded = None
    if crowd is not None:
        busy = cut(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"))
        if not busy.isEmpty():
            crowded = cut(rows.join(busy, "anchor").groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
            rows, distinct = rows.join(busy, "anchor", "left_anti"), cut(distinct.join(busy, "anchor", "left_anti"))
    shards = distinct.count() // SHARD + 1
    least = cut(_searched(_words_of(docs, distinct, size), shards, size))
    found = rows.join(least, ["anchor", "content"]).where(F.array_min("least") < F.col("doc_id"))
    whole = F.array_max("least") < F.col("doc_id")
    ranges = found.where(whole).select(*KEY, "low", "high")
    each = found.where(~whole).select(*KEY, "low", F.posexplode("least").alias("k", "first")).where("first < doc_id")
    start = F.col("low") + F.col("k")
    return cut(ranges.unionByName(each.select(*KEY, start.alias("low"), start.alias("high")))), crowded


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, low, high: ranges of starts of all windows of `size` words of `docs` that also start in a document with a smaller
    doc_id. Written."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").where("doc_id is not null")
    found, crowded = _pass(keyed, size, min(ANCHOR, size), None, CROWD)
    if crowded is not None:
        more, _ = _pass(keyed, size, size, crowded, None)
        found = found.unionByName(more)
    return found


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    A word goes if a window of `size` words that covers it also starts in a document with a smaller doc_id, as the input stands. A null text has no words. A null doc_id
    is neither smaller nor larger than another: such a row keeps all words. Rows that share a doc_id do not count for each other. An
    empty table gives no rows. Other columns are not read.
    """
    windows = repeated_windows(docs, size)
    lists = cut(windows.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("ranges")))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if ranges.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, ranges.values.field("low").to_numpy(), 1)
                    np.add.at(cover, ranges.values.field("high").to_numpy() + size, -1)
                    left = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                    n_removed.append(len(words) - len(left))
                    words = [words[k] for k in left.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.join(lists, KEY, "left").select("doc_id", "text", "ranges").mapInArrow(rest, "doc_id long, n_words long, n_removed long, kept string")
