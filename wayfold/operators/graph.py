"""Iterative graph passes on edge tables. Every round is written to the checkpoint folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import dist_euclid
from ..session import cut, discard
from .common import with_rank


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge, the component being its smallest node.

    Alternating large-star and small-star rounds: logarithmically many even on long chains, and each round is a
    minimum per node (reduced before the shuffle) joined back to the edges. The minima are written before that join:
    an aggregate on the join key would leave the rows of a hub in one task, plain tables can be split.
    """
    now = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    )
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    before = None
    while True:
        both = now.unionByName(_flip(now))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        small_min = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_min.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        earlier, now = now, cut(small)
        discard(earlier, least, large, small_min)
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


# Rounds after which an iteration counts as stuck. Contraction takes away a constant share of what can be contracted in each.
ROUNDS = 400


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = ROUNDS) -> DataFrame:
    """(node, component) for every node on an edge: nodes that reach each other along directed edges, named by the smallest of them.

    Nodes without an in-edge or without an out-edge are components of their own and go. Of the nodes with one in-neighbour and one out-neighbour, no two of them
    adjacent, those with the least hash are bypassed by an edge; they belong to a component if both neighbours turn out to. So long paths and trees
    vanish in logarithmically many rounds. When little can be contracted, every node gets the first node, in a random order of the round, that reaches
    it, then the first that it reaches among the nodes with the same; nodes whose two answers are the same node form a component, and edges between nodes with
    different answers go. More than `rounds` rounds raise an error.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = cut(both.select(F.col("u").alias("node")).union(both.select(F.col("v").alias("node"))).distinct())
    now = cut(both.filter("u <> v").distinct())
    bypassed, found = [], []
    for turn in range(rounds):
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("_out"), F.lit(None).cast(now.schema["u"].dataType).alias("_in"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), F.lit(None).cast(now.schema["v"].dataType).alias("_out"), F.col("u").alias("_in")))
        degrees = cut(ends.groupBy("node").agg(F.count("_in").alias("ins"), F.count("_out").alias("outs"), F.min("_in").alias("pred"), F.min("_out").alias("succ")))
        through = degrees.filter("ins = 1 AND outs = 1").select("node", "pred", "succ")
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)
        known = through.select(F.col("node").alias("_n"))
        picked = through
        for side in ("pred", "succ"):
            picked = picked.join(known, F.col(side) == F.col("_n"), "left")
            picked = picked.filter(F.col("_n").isNull() | (order("node") < order(side))).drop("_n")
        picked = cut(picked)
        gone = cut(degrees.filter("ins = 0 OR outs = 0").select("node").unionByName(picked.select("node")))
        alive, less = degrees.count(), gone.count()
        bypassed.append(picked)
        joined = now.unionByName(picked.select(F.col("pred").alias("u"), F.col("succ").alias("v")))
        left = joined.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
        earlier, now = now, cut(left.select("u", "v").filter("u <> v").distinct())
        discard(earlier, degrees, gone)
        if now.isEmpty():
            break
        if less * 8 < alive:
            colours, now = _coloured(now, turn, rounds)
            found.append(colours)
            if now.isEmpty():
                break
    else:
        raise RuntimeError(f"strong components are not settled after {rounds} rounds")
    settled = nodes.limit(0).select("node", F.col("node").alias("root"))
    for part in found:
        settled = settled.unionByName(part)
    settled = cut(settled)
    for picked in reversed(bypassed):
        if picked.isEmpty():
            continue
        at = lambda side: settled.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
        ends = picked.join(at("pred"), "pred", "left").join(at("succ"), "succ", "left")
        ends = ends.withColumn("root", F.coalesce("_pred", "pred")).filter(F.col("root") == F.coalesce("_succ", "succ"))
        # A neighbour that no component holds yet becomes the root of one.
        more = ends.select("node", "root").unionByName(ends.select(F.col("root").alias("node"), "root")).distinct()
        more = more.join(settled.select("node"), "node", "left_anti")
        earlier, settled = settled, cut(settled.unionByName(more))
        discard(earlier)
    discard(*bypassed, *found)
    least = settled.groupBy("root").agg(F.min("node").alias("component"))
    named = settled.join(cut(least), "root").select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _first_reaching(edges: DataFrame, nodes: DataFrame, turn: int, rounds: int) -> DataFrame:
    """(node, first): of the nodes that reach a node along `edges` (u, v), itself included, the first in the random order of `turn`.

    What reaches a node's answer reaches the node, so answers also hop over to the answer of the answer, and paths are walked in leaps.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
    now = cut(nodes.select("node", rank("node").alias("first")))
    for _ in range(rounds):
        along = edges.join(now, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "first")
        better = now.filter(F.col("first.id") != F.col("node")).select(F.col("node").alias("_at"), F.col("first").alias("_first"))
        leaps = now.join(better, F.col("first.id") == F.col("_at")).select("node", F.col("_first").alias("first"))
        own = now.select("node", "first", F.col("first").alias("_own"))
        none = F.lit(None).cast(own.schema["_own"].dataType).alias("_own")
        every = own.unionByName(along.select("node", "first", none)).unionByName(leaps.select("node", "first", none))
        after = cut(every.groupBy("node").agg(F.min("first").alias("first"), F.min("_own").alias("_own")))
        discard(now)
        now = after
        if now.filter(F.col("first") < F.col("_own")).isEmpty():
            return now.select("node", F.col("first.id").alias("first"))
    raise RuntimeError(f"labels are not settled after {rounds} rounds")


def _coloured(edges: DataFrame, turn: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(components found: node, root; edges left), both written."""
    nodes = cut(edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct())
    at = lambda labels, end, name: labels.select(F.col("node").alias(end), F.col("first").alias(name))
    reached = cut(_first_reaching(edges, nodes, turn, rounds))
    inner = edges.join(at(reached, "u", "_a"), "u").join(at(reached, "v", "_b"), "v").filter("_a = _b")
    inner = cut(inner.select("u", "v"))
    back = cut(_first_reaching(_flip(inner), nodes, turn, rounds))
    labels = cut(reached.join(back.withColumnRenamed("first", "_back"), "node"))
    found = cut(labels.filter("first = _back").select("node", F.col("first").alias("root")))
    rest = labels.filter("first <> _back").select("node", F.col("_back").alias("first"))
    left = cut(inner.join(at(rest, "u", "_a"), "u").join(at(rest, "v", "_b"), "v").filter("_a = _b").select("u", "v"))
    discard(nodes, reached, inner, back, labels)
    return found, left


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(seed, node): everything a seed reaches along directed edges, itself included. Breadth-first rounds."""
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("_to")).filter("node <> _to").distinct()
    steps = cut(steps)
    seen = cut(seeds.select("seed", F.col("seed").alias("node")))
    front = seen
    while True:
        found = front.join(steps, "node").select("seed", F.col("_to").alias("node")).distinct()
        ahead = cut(found.join(seen, ["seed", "node"], "left_anti"))
        if ahead.isEmpty():
            return seen
        known = cut(seen.unionByName(ahead))
        discard(front, seen)
        front, seen = ahead, known


# Bits of one of Spark's bitmaps, the origins whose bitmaps a task extends together, and the pairs that a task lists.
BITS, ORIGINS, LISTED = 32768, 16384, 1 << 25


def k_step(edges: DataFrame, k: int, src: str = "o", dst: str = "d", nodes: DataFrame | None = None) -> DataFrame:
    """Pairs connected by a path of 1..k edges, without the diagonal.

    Paths are listed (only newly found pairs are extended) unless those of two edges outnumber the 64-bit words that a bit for each pair of nodes would take: in a
    dense relation most paths find a pair again, and what a node reaches is kept in bitmaps instead. `nodes` (node, place) are all that edges end at, near ones
    side by side in the order of `place`: then dense edges are not written one by one, and bitmaps shrink. Edges are told apart by the ids alone.
    """
    ends = edges.select(F.col(src).alias("o"), F.col(dst).alias("d")).filter("o IS NOT NULL AND d IS NOT NULL")
    if k <= 1:
        return ends.distinct().filter("o <> d").select(F.col("o").alias(src), F.col("d").alias(dst))
    if nodes is not None:
        numbers, words = _numbered_words(ends, nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("place").alias("place")))
        leaving = words.groupBy("_a").agg(F.sum(F.bit_count("_word")).cast("double").alias("_out"))
        n, paths = numbers.count(), leaving.agg(F.sum(F.col("_out") * F.col("_out"))).first()[0] or 0.0  # as many come in, for this choice
        if paths * 64 > float(n) * n:
            pairs = _multiplied(words, numbers, n, k)
        else:
            discard(numbers, words)
            pairs = _k_step_paths(cut(ends), k)
        return pairs.select(F.col("o").alias(src), F.col("d").alias(dst))
    ends = cut(ends)
    leaving = ends.groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
    coming = ends.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
    nodes = cut(leaving.join(coming, "node", "full_outer"))
    facts = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("_in") * F.col("_out").cast("double")).alias("paths")).first()
    if (facts.paths or 0.0) * 64 > facts.n * facts.n:
        pairs = _k_step_bitmaps(ends, nodes.select("node"), int(facts.n), k)
        discard(ends, nodes)
    else:
        discard(nodes)
        pairs = _k_step_paths(ends, k)
    return pairs.select(F.col("o").alias(src), F.col("d").alias(dst))


def _k_step_paths(ends: DataFrame, k: int) -> DataFrame:
    one = ends.distinct()
    hop = one.select(F.col("o").alias("d"), F.col("d").alias("_next"))
    seen, front = one, one
    for _ in range(k - 1):
        found = front.join(hop, "d").select("o", F.col("_next").alias("d")).distinct()
        front = cut(found.join(seen, ["o", "d"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.filter("o <> d")


def _k_step_bitmaps(ends: DataFrame, nodes: DataFrame, n: int, k: int) -> DataFrame:
    numbers, words = _numbered_words(ends, nodes)
    return _multiplied(words, numbers, n, k)


def _numbered_words(ends: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers: node, _no; words: _a, _w, _word), written: nodes are numbered, and a word holds which of the nodes from 64 * `_w` + 1 on node number `_a` has an edge to."""
    numbers = cut(with_rank(nodes, [F.col(c) for c in ("place", "node") if c in nodes.columns], "_no").select("node", "_no"))
    a, b = (numbers.select(F.col("node").alias(c), F.col("_no").alias(f"_{name}")) for c, name in (("o", "a"), ("d", "b")))
    numbered = ends.join(a, "o", "left").join(b, "d", "left")
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("an edge ends at none of the nodes")).cast("long"))
    bits = numbered.select(known("_a").alias("_a"), (known("_b") - 1).alias("_b"))
    # Words are or-ed where edges are made, before the shuffle.
    words = bits.groupBy("_a", F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 AS INT)))").alias("_word"))
    return numbers, cut(words)


def _multiplied(words: DataFrame, numbers: DataFrame, n: int, k: int) -> DataFrame:
    """The pairs by a product of bit matrices: a row holds the part `_block` of what node number `_a` reaches. `words` and `numbers` are used up.

    A task takes up to `ORIGINS` origins with one block of their neighbours, and one block of what these reach, so that its memory does not grow with the table.
    Blocks without a bit are neither copied nor multiplied.
    """
    a, b = (numbers.select(F.col("node").alias(c), F.col("_no").alias(f"_{name}")) for c, name in (("o", "a"), ("d", "b")))
    lists = words.groupBy("_a", (F.shiftright("_w", 9) + 1).alias("_block"))
    lists = lists.agg(F.collect_list(F.struct(F.col("_w").bitwiseAND(F.lit(511)).alias("_w"), "_word")).alias("_words"))
    one = cut(lists.mapInArrow(_packed, "_a long, _block long, _bits binary"))
    discard(words)
    keys = ["_part", "_via", "_block"]
    part = (F.floor((F.col("_a") - 1) / ORIGINS) + 1).alias("_part")
    first = one.select("_a", part, F.col("_block").alias("_via"), "_bits")
    wanted = cut(first.select("_part", "_via").distinct())
    reached = one
    for _ in range(k - 1):
        then = reached.select(F.col("_a").alias("_row"), F.bitmap_bucket_number("_a").alias("_via"), "_block", F.col("_bits").alias("_held"))
        given = cut(then.select("_via", "_block").distinct())
        # One row per pair of blocks; as many tasks as there are products, so that none is given many by Spark's merging of small partitions.
        tasks = max(1, wanted.join(F.broadcast(given), "_via").count())
        mine = first.join(F.broadcast(given), "_via").repartition(tasks, *keys).groupBy(*keys)
        theirs = then.join(F.broadcast(wanted), "_via").repartition(tasks, *keys).groupBy(*keys)
        product = mine.cogroup(theirs).applyInArrow(_product, "_a long, _block long, _bits binary")
        further = cut(one.unionByName(product).groupBy("_a", "_block").agg(F.bitmap_or_agg("_bits").alias("_bits")))
        discard(given)
        if reached is not one:
            discard(reached)
        reached = further
    discard(one, wanted)
    pairs = reached.agg(F.sum(F.bitmap_count("_bits"))).first()[0] or 0
    if pairs > LISTED:
        reached = reached.repartition(math.ceil(pairs / LISTED), "_a", "_block")
    listed = reached.join(a, "_a").mapInArrow(_positions, "o " + a.schema["o"].dataType.simpleString() + ", _b array<long>")
    return listed.select("o", F.explode("_b").alias("_b")).join(b, "_b").select("o", "d")


def _matrices(column):
    """The bitmaps of an Arrow column as rows of 64-bit words, chunk by chunk and not copied."""
    import numpy as np
    import pyarrow as pa

    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk):
            start = np.frombuffer(offsets, dtype="<i8" if pa.types.is_large_binary(chunk.type) else "<i4")[chunk.offset]
            yield np.frombuffer(data, dtype="<u8", count=len(chunk) * BITS // 64, offset=int(start)).reshape(len(chunk), -1)


def _packed(batches):
    """Bitmaps from lists of their words, a few at a time."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            few = batch.slice(at, 1024)
            lists = few["_words"]
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            bits = np.zeros((len(lists), BITS // 64), dtype="<u8")
            bits[row, flat.field("_w").to_numpy()] = flat.field("_word").to_numpy().view("<u8")
            yield pa.record_batch([few["_a"], few["_block"], pa.array([r.tobytes() for r in bits], type=pa.binary())], names=["_a", "_block", "_bits"])


def _product(mine, reached):
    """For each origin, all that some of its neighbours in one block reaches in another block.

    Where 64 or 8 neighbours in a row are all asked for, one row stands for what they reach together; when all that the block reaches is found, the rest is not looked at.
    """
    import numpy as np
    import pyarrow as pa

    kinds = pa.schema([("_a", pa.int64()), ("_block", pa.int64()), ("_bits", pa.binary())])
    if not mine.num_rows or not reached.num_rows:
        return kinds.empty_table()
    at = (reached["_row"].to_numpy() - 1) % BITS
    every, done = np.zeros((BITS, BITS // 64), dtype="<u8"), 0
    for rows in _matrices(reached["_held"]):
        every[at[done : done + len(rows)]] = rows
        done += len(rows)
    eights = np.bitwise_or.reduce(every.reshape(BITS // 8, 8, -1), axis=1)
    sixties = np.bitwise_or.reduce(eights.reshape(BITS // 64, 8, -1), axis=1)
    most = np.bitwise_or.reduce(sixties, axis=0)
    there = np.zeros(BITS, dtype=bool)
    there[at] = True
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    there = np.packbits(there, bitorder="little").view("<u8")
    blocks, out, rows = mine["_block"].to_numpy(), [], []
    for i, bits in enumerate(row for part in _matrices(mine["_bits"]) for row in part):
        found = np.zeros(BITS // 64, dtype="<u8")
        # Neighbours that reach nothing in the block change nothing, whether asked for or not.
        whole = ((bits | ~there) == full) & (there != none)
        single = np.where(whole, none, bits & there).view(np.uint8)
        octets = ((single | ~there.view(np.uint8)) == 255) & (single != 0)
        for table, near in ((sixties, whole), (eights, octets), (every, None)):
            if near is None:
                near = np.unpackbits(np.where(octets, 0, single).astype(np.uint8), bitorder="little")
            near = np.flatnonzero(near)
            for j in range(0, len(near), 64):  # so many rows stay in the processor's cache
                found |= np.bitwise_or.reduce(table[near[j : j + 64]], axis=0)
                if table is every and (found == most).all():
                    break
            if (found == most).all():
                break
        if found.any():
            out.append(found.tobytes())
            rows.append(i)
    return pa.table([mine["_a"].combine_chunks().take(pa.array(rows, type=pa.int64())), pa.array(blocks[rows], type=pa.int64()), pa.array(out, type=pa.binary())], schema=kinds)


def _positions(batches):
    """The node numbers in each bitmap but the origin's own, a few bitmaps at a time."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            few = batch.slice(at, 16)
            found = []
            for own, block, bits in zip(few["_a"].to_pylist(), few["_block"].to_pylist(), few["_bits"].to_pylist()):
                numbers = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")) + (BITS * (block - 1) + 1)
                found.append(numbers[numbers != own])
            starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.record_batch([few["o"], pa.ListArray.from_arrays(starts, np.concatenate(found).astype(np.int64))], names=["o", "_b"])


def drop_isolated(nodes: DataFrame, links: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Nodes with at least one incoming or outgoing link."""
    used = links.select(F.col(src).alias(key)).unionByName(links.select(F.col(dst).alias(key))).distinct()
    return nodes.join(used, key, "left_semi")


def proximity_components(points: DataFrame, radius: float | Column, strict: bool = True, by: list[str] | None = None) -> DataFrame:
    """(id, component): points linked when closer than `radius` (strict) or not farther (otherwise), within `by` groups.

    The radius may be a column that is constant within a group. Crowded places do not list their pairs: points of one
    fine cell (narrower than the radius) belong together, so the graph is built on cells. Two cells are linked if some
    point of one is near some point of the other; this is decided from the cells' extents and extreme points where
    possible, and for the remaining cell pairs by halving the cells again and again, so that only the rim between two
    cells is ever looked at in detail. The component is the smallest id in it.
    """
    by = [*(by or []), "_r"]
    reach = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    near = (lambda d: d < F.col("_r")) if strict else (lambda d: d <= F.col("_r"))
    size = F.col("_r") / 1.5
    celled = points.withColumn("_r", reach).select("id", "x", "y", *by).withColumns(
        {"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)}
    )
    heads = celled.groupBy(*by, "bx", "by").agg(F.min("id").alias("head"))
    links = _linked_cells(celled, heads, by, size, near)
    joined = connected_components(links, "src", "dst")
    labels = heads.join(joined.withColumnRenamed("node", "head"), "head", "left").select(
        *by, "bx", "by", F.coalesce("component", "head").alias("component")
    )
    return celled.join(labels, [*by, "bx", "by"]).drop("_r").select("id", *[c for c in by if c != "_r"], "component")


def _summaries(celled: DataFrame, keys: list[str]) -> DataFrame:
    """Extent and eight extreme points per cell."""
    p = F.struct("x", "y")
    x, y = F.col("x"), F.col("y")
    ends = [f(p, o) for o in (x, y, x + y, x - y) for f in (F.min_by, F.max_by)]
    return celled.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.array(*ends).alias("ends"), F.count(F.lit(1)).alias("n"),
    )


def _linked_cells(celled, heads, by, size, near):
    """Edges (src, dst) between the heads of neighbouring cells that hold points near each other."""
    celled = celled.select(*by, "x", "y", "bx", "by").distinct()
    summary = _summaries(celled, [*by, "bx", "by"]).join(heads, [*by, "bx", "by"])
    a = summary
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    b = summary.select(*by, *[F.col(c).alias(f"q{c}") for c in ("bx", "by", "x0", "x1", "y0", "y1", "ends", "n", "head")])
    b = b.withColumn("_o", shift).withColumns({"bx": F.col("qbx") - F.col("_o.i"), "by": F.col("qby") - F.col("_o.j")}).drop("_o")
    pairs = a.join(b, [*by, "bx", "by"])
    pairs = cut(_judge(pairs, near))
    sure = pairs.filter("verdict = 1").select(F.col("head").alias("src"), F.col("qhead").alias("dst"))
    open_pairs = pairs.filter("verdict = 0").select(
        *by, F.col("head").alias("src"), F.col("qhead").alias("dst"),
        F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("qbx").alias("cx"), F.col("qby").alias("cy"),
    )
    return _refine(celled.select(*by, "x", "y"), open_pairs, by, size, near, sure)


def _gap(p: str, q: str) -> Column:
    """Distance between the extents of two cells."""
    dx = F.greatest(F.col(f"{q}x0") - F.col(f"{p}x1"), F.lit(0.0), F.col(f"{p}x0") - F.col(f"{q}x1"))
    dy = F.greatest(F.col(f"{q}y0") - F.col(f"{p}y1"), F.lit(0.0), F.col(f"{p}y0") - F.col(f"{q}y1"))
    return F.sqrt(dx * dx + dy * dy)


def _judge(pairs: DataFrame, near) -> DataFrame:
    """verdict 1 = linked, 0 = unclear; pairs that cannot be near are dropped, single points are always clear."""
    closest = F.array_min(
        F.flatten(F.transform("ends", lambda p: F.transform("qends", lambda q: dist_euclid(p.x, p.y, q.x, q.y))))
    )
    return (
        pairs.filter(near(_gap("", "q")))
        .withColumn("verdict", F.when(near(closest), 1).when((F.col("n") <= 2) & (F.col("qn") <= 2), -1).otherwise(0))
        .filter("verdict >= 0")
        .drop("ends", "qends")
    )


def _refine(points, open_pairs, by, size, near, sure):
    level = 0
    found = sure
    while not open_pairs.isEmpty():
        level += 1
        half = size / float(2**level)
        fine = points.withColumns({"fx": F.floor(F.col("x") / half), "fy": F.floor(F.col("y") / half)})
        parts = _summaries(
            fine.withColumns({"px": F.floor(F.col("fx") / 2), "py": F.floor(F.col("fy") / 2)}), [*by, "px", "py", "fx", "fy"]
        )
        p = parts.withColumnsRenamed({"px": "ax", "py": "ay", "fx": "nax", "fy": "nay"})
        q = parts.select(
            *by, F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("fx").alias("ncx"), F.col("fy").alias("ncy"),
            *[F.col(c).alias(f"q{c}") for c in ("x0", "x1", "y0", "y1", "ends", "n")],
        )
        tried = open_pairs.join(p, [*by, "ax", "ay"]).join(q, [*by, "cx", "cy"])
        judged = cut(
            _judge(tried, near).select(
                *by, "src", "dst", "verdict", F.col("nax").alias("ax"), F.col("nay").alias("ay"),
                F.col("ncx").alias("cx"), F.col("ncy").alias("cy"),
            )
        )
        linked = judged.filter("verdict = 1").select("src", "dst").distinct()
        found = found.unionByName(linked)
        open_pairs = judged.filter("verdict = 0").join(linked, ["src", "dst"], "left_anti").drop("verdict")
    return found
