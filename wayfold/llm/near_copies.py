"""Near copies of documents: DartMinHash signatures, banded joining, exact comparison.

A document is the multiset of its five-word shingles. Darts fall at hashed places into the regions that a shingle and its weight span: a region
is a shingle and a range of weights (0-1, 1-2, 2-4, ...), and gets darts at hashed ranks with a density that is the range's width.
A document keeps the darts below its own weights, and of these the earliest for each of its coordinates; two documents agree in a coordinate with the probability
of their weighted Jaccard similarity. Only the first darts of each region are thrown at all, so that the work follows the number of shingles, and not
that times the number of coordinates.

Documents that share a band are compared, each with one centre per band, and then what hangs together is one class. What is still apart in some band is
settled exactly by prefixes: similar multisets share one of the rarest shingles of each, early enough that the rest can still make them similar. Here too a
centre comes first, the document with the least of its own, before the few that are left are compared one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut
from .words import give_back, mixed, rolled, word_hashes

SHINGLE = 5
LEAST_SIMILARITY = 0.8
#: 40 bands of 6: a pair at 0.8 shares none with a probability of 5e-6, one at 0.5 shares one with 0.47.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Darts per document beyond those that fill all coordinates on average; the few documents with an empty one throw more.
SLACK = 3.0
BLOCK = 256  # documents whose darts are thrown at a time


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes and how often each occurs; fewer than `size` words are one shingle, none is none."""
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(rolled(hashes, min(size, len(hashes))), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, until: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that hit: owner * k + coordinate, rank, name of each. `until` is the rank up to which each owner throws."""
    keys, ranks, names = [], [], []
    low, high = 0.0, 1.0
    level = 0
    while len(elements):
        # One region per element: this level's range of weights. Its first dart comes after a hashed exponential time, and so on.
        region = mixed(elements ^ mixed(np.full(1, 0xD1B54A32D192ED03, np.uint64) + np.uint64(level)))
        seed, weight, own, limit = region, weights, owner, until[owner]
        rank = np.zeros(len(region))
        width, throw = high - low, 0
        while len(seed):
            throw += 1
            name = mixed(seed + np.uint64((throw * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            rank = rank - np.log(_uniform(name)) / width
            go = rank <= limit
            seed, weight, own, limit, rank, name = seed[go], weight[go], own[go], limit[go], rank[go], name[go]
            hit = weight >= high
            if not hit.all():
                hit |= low + width * _uniform(mixed(name ^ np.uint64(0x2545F4914F6CDD1D))) <= weight
            # Upper bits of a product, that is, bits that depend on all of the name.
            place = (name[hit] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
            keys.append(own[hit] * k + ((place * np.uint64(k)) >> np.uint64(20)).astype(np.int64))
            ranks.append(rank[hit])
            names.append(name[hit])
        more = weights > high
        elements, weights, owner = elements[more], weights[more], owner[more]
        low, high, level = high, high * 2, level + 1
    return np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """One row of `k` coordinates for each (elements, weights); zeros for an empty one. Weights are positive numbers."""
    out = np.zeros((len(sets), k), np.uint64)
    left = np.array([i for i, (e, _) in enumerate(sets) if len(e)], np.int64)
    darts = k * (math.log(k) + SLACK)
    while len(left):
        sizes = [len(sets[i][0]) for i in left]
        elements = np.concatenate([sets[i][0] for i in left])
        weights = np.concatenate([sets[i][1] for i in left]).astype(np.float64)
        owner = np.repeat(np.arange(len(left)), sizes)
        until = darts / np.bincount(owner, weights, len(left))
        keys, ranks, names = _throw(elements, weights, owner, until, k)
        first = np.full(len(left) * k, np.inf)
        np.minimum.at(first, keys, ranks)
        won = np.flatnonzero(ranks == first[keys])
        found = np.zeros(len(left) * k, np.uint64)
        found[keys[won]] = names[won]
        full = np.isfinite(first).reshape(-1, k).all(1)
        out[left[full]] = found.reshape(-1, k)[full]
        left, darts = left[~full], darts * 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One key for each band of each row; a band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + mixed(np.arange(1, BANDS + 1).astype(np.uint64))
    for row in range(ROWS):
        key = mixed(key ^ parts[:, :, row])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    total = a[1].sum() + b[1].sum()
    _, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at], b[1][to]).sum()
    return float(common / (total - common)) if total else 1.0


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, bounds = word_hashes(texts)
    return [shingles(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _digests(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, content (digest of the text's words), keys (one per band; none for a text without words) of each row with a doc_id."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                hashes, bounds = word_hashes(part.column(1))
                sets = [shingles(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                keys = bands(signatures(sets))
                lists = [keys[i] if len(s[0]) else keys[i][:0] for i, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays([part.column(0), _digests(hashes, bounds), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "content", "keys"])
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(sketched, "doc_id long, content binary, keys array<long>")


def _texts_of_contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of each of `wanted` (node, content, first): a text of that content, `first` being an id that has it beside others."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([_digests(*word_hashes(part.column(0))), part.column(0)], names=["content", "text"])
            give_back()

    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("text")
    found = rows.mapInArrow(digested, "content binary, text string").join(wanted.select("node", "content"), "content")
    return found.groupBy("node").agg(F.min("text").alias("text"))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; `texts` has one row (node, text) per node. Written."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                left, right = _sets(part.column(2)), _sets(part.column(3))
                keep = pa.array([similarity(x, y) >= LEAST_SIMILARITY for x, y in zip(left, right)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])
            give_back()

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return cut(both.select("a", "b", "left", "right").mapInArrow(similar, "a long, b long"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` (node, class) after `links` (a, b) between nodes. Written. Only classes, not nodes, go through the rounds of the components."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("class").alias(f"c{end}"))
    between = cut(links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb").distinct())
    if between.isEmpty():
        return classes
    found = cut(connected_components(between, "ca", "cb").select(F.col("node").alias("class"), "component"))
    return cut(classes.join(found, "class", "left").select("node", F.coalesce("component", "class").alias("class")))


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """key, node, class of the members of bands that hold more than one class. Written."""
    known = members.join(classes, "node")
    # Written before the join, so that a band with very many members can be split.
    mixed_bands = cut(known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key"))
    return cut(known.join(mixed_bands, "key"))


def _with_centres(apart: DataFrame, number: int) -> DataFrame:
    """Distinct pairs (a, b) of members and the centre of their band, of different classes. The first centre is the least node, the others are drawn."""
    order = F.lit(0).cast("long") if number == 0 else F.xxhash64("node", F.lit(number))
    centre = cut(apart.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "class")).alias("c")).select("key", "c.node", "c.class").toDF("key", "centre", "centre_class"))
    met = apart.join(centre, "key").where("class <> centre_class").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return met.distinct()


def _prefixes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, own, element, place: of each of `nodes` (node) the rarest shingles, as many as a similar multiset must share one of. Written.

    The k-th occurrence of a shingle is an element of its own; rarity is counted over `nodes`. A node has `n` elements, `own` of them alone; `place` is
    the element's in the order of rarity.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                elements = []
                for known, counts in _sets(part.column(1)):
                    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    elements.append(mixed(np.repeat(known, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(elements, pa.list_(pa.int64()))], names=["node", "elements"])
            give_back()

    rows = cut(nodes.join(texts, "node").select("node", "text").mapInArrow(listed, "node long, elements array<long>"))
    each = rows.select("node", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    # An element that one node alone has meets nobody; written, so that the join below can be split.
    often = cut(each.groupBy("element").agg(F.count("*").alias("f")).where("f > 1"))
    shared = each.join(often, "element")
    # All shared elements of a node in order of rarity; its own ones come first and use up places of the prefix.
    ordered = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "element"))).alias("e"))
    own = F.col("n") - F.size("e")
    places = F.greatest(F.col("n") - F.ceil(F.lit(LEAST_SIMILARITY) * F.col("n") - 1e-9) + 1 - own, F.lit(0)).cast("int")
    listing = ordered.select("node", "n", own.alias("own"), F.posexplode(F.slice("e", 1, places)).alias("k", "x"))
    return cut(listing.select("node", "n", "own", F.col("x.element").alias("element"), (F.col("own") + F.col("k")).alias("place")))


def _can_be_similar() -> Column:
    """Whether nodes of sizes na and nb can be similar if the element at places pa and pb is the first they share."""
    least = F.ceil(F.lit(LEAST_SIMILARITY / (1 + LEAST_SIMILARITY)) * (F.col("na") + F.col("nb")) - 1e-9)
    return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least


def _settled_by_prefixes(texts: DataFrame, classes: DataFrame, apart: DataFrame) -> DataFrame:
    """`classes` after all links between nodes of `apart` that are in different classes. Written."""
    prefix = _prefixes(texts, apart.select("node").distinct())
    of = lambda end: (F.col("node").alias(end), F.col("class").alias(f"c{end}"), F.col("n").alias(f"n{end}"), F.col("place").alias(f"p{end}"), "element")
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    order = F.struct((F.col("own") / F.col("n")).alias("o"), "node")
    for first in (True, False):
        known = cut(prefix.join(classes, "node"))
        centre = known.groupBy("element").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min_by(F.struct("node", "class", "n", "place"), order).alias("c"))
        centre = cut(centre.where("low < high").select("element", "c.*"))
        if first:
            met = known.select(*of("a")).join(centre.select(*of("b")), "element")
        else:
            # Nodes that are not in the centre's class, with all others: few, and in a class of many copies none.
            odd = cut(known.join(centre.select("element", F.col("class").alias("main")), "element").where("class <> main").drop("main"))
            met = odd.select(*of("a")).join(known.select(*of("b")), "element")
        pairs = cut(met.where(F.col("ca") != F.col("cb")).where(_can_be_similar()).select(*pair).distinct())
        classes = _merged(classes, _compared(pairs, texts))
    return classes


def near_copies(docs: DataFrame, centres: int = 2) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id and class_id, the least doc_id of its class.

    A class is what hangs together by links, a link being a weighted Jaccard similarity of LEAST_SIMILARITY or more between five-word shingles.
    Texts of the same words are always linked, texts without words too (null is empty). Rows that share a doc_id are in one class, and
    each of their texts is compared. A row without a doc_id is in no class: its class_id is null. An empty table
    gives no rows. Other columns are not read.
    """
    sketch = cut(sketches(docs))
    repeats = not sketch.groupBy("doc_id").count().where("count > 1").isEmpty()
    # Copies are one node, however many; the partial result of a task has one row for each text in it. Where ids repeat, several contents can have
    # the same least id, and nodes are numbered instead.
    number = F.monotonically_increasing_id() if repeats else F.col("first")
    nodes = cut(sketch.groupBy("content").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")).withColumn("node", number))
    members = nodes.select("node", F.explode("keys").alias("key"))
    full = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    members = cut(members.join(full, "key"))
    met = members.select("node").distinct()
    if repeats:
        texts = cut(_texts_of_contents(docs, nodes.select("node", "content", "first").join(met, "node", "left_semi")))
    else:
        texts = cut(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(met, "node", "left_semi"))
    classes = cut(nodes.select("node", F.col("node").alias("class")).distinct())
    if repeats:  # texts of one id hang together
        of_ids = sketch.select("doc_id", "content").distinct().join(nodes.select("content", "node"), "content")
        least = cut(of_ids.groupBy("doc_id").agg(F.min("node").alias("a")))
        classes = _merged(classes, of_ids.join(least, "doc_id").select("a", F.col("node").alias("b")))
    apart = _apart(members, classes)
    for number in range(centres):
        pairs = cut(_with_centres(apart, number))
        if pairs.isEmpty():
            break
        classes = _merged(classes, _compared(pairs, texts))
        apart = _apart(members, classes)
    if not apart.isEmpty():
        classes = _settled_by_prefixes(texts, classes, apart)
    if repeats:  # from numbers back to ids
        known = nodes.select("node", "first").join(classes, "node")
        least = cut(known.groupBy("class").agg(F.min("first").alias("id")))
        classes = classes.join(least, "class").select("node", F.col("id").alias("class"))
    of_content = cut(nodes.select("content", "node").join(classes, "node").select("content", F.col("class").alias("class_id")))
    of_rows = sketch.select("doc_id", "content").join(of_content, "content").select("doc_id", "class_id")
    nobody = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return of_rows.unionByName(nobody)
