import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def filled(runs, histogram, capacity):
    """Sequences as lists of (offset, length), after a check that every piece has one place."""
    ranks, out = Counter(), {}
    for length, first, n, sequence, each, at in sorted(runs):
        assert first == ranks[length] and n > 0 and each > 0
        ranks[length] += n
        for k in range(n):
            out.setdefault(sequence + k // each, []).append((at + k % each * length, length))
    assert +ranks == +Counter(histogram)
    for members in out.values():
        end = 0
        for at, length in sorted(members):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(out) == list(range(len(out)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plan_is_a_packing(histogram):
    found = filled(packing.plan(histogram, 64), histogram, 64)
    for members in found.values():
        assert sum(3 * n > 64 for _, n in members) <= 2
    total = sum(k * n for k, n in histogram.items())
    assert len(found) <= max(2 * total / 64 + 1, sum(n for k, n in histogram.items() if 3 * k > 64))


def best_fit(lengths, capacity):
    """Longest first, one at a time: large ones with the longest partner that fits, then each small one into the tightest gap."""
    large, gaps = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        first = large.pop(0)
        partner = next((k for k, n in enumerate(large) if first + n <= capacity), None)
        gaps.append(capacity - first - (large.pop(partner) if partner is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 12), max_size=20))
def test_plan_is_as_good_as_one_at_a_time(histogram):
    runs = packing.plan(histogram, 50)
    one_by_one = best_fit([k for k, n in histogram.items() for _ in range(n)], 50)
    assert abs(len(filled(runs, histogram, 50)) - one_by_one) <= 1 + one_by_one // 20


def test_steps_do_not_grow_with_counts():
    small = {n: 3 for n in range(1, 1025)}
    large = {n: 3_000_000_000 for n in range(1, 1025)}
    assert len(packing.plan(large, 1024)) <= 4 * len(packing.plan(small, 1024)) + 4096


def test_pieces_and_sequences(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "same text here", "same text here", "word " * 5000, "é" * 3000]
    texts += [" ".join(rng.choice(["alpha", "beta", "the", "\n", "ünder"]) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    rows = [(None if k % 17 == 0 else k // 2, t, "x", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, rank int").repartition(5)
    packed = packing.pack(docs, PATH, 2)
    found = packed.collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n, first = len(ids), len(ids) % 1024 or 1024
        edges = [0, *range(first, n, 1024), n]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in found) == want
    members = {}
    for r in found:
        members.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    for number, parts in members.items():
        end = 0
        for at, length, _ in sorted(parts):
            assert at == end
            end += length
        assert end <= 1024 and whole[number] == (end, b"".join(p[2] for p in sorted(parts)))
    assert len(members) == best_fit([r.length for r in found], 1024) or len(members) <= 1.02 * sum(r.length for r in found) / 1024 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []
