import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import near_copies as nc
from wayfold.llm.words import BASE, mixed, rolled, word_hashes


def test_words_and_rolling():
    texts = ["a b  c\td", None, "", " \n ", "x", "é\x1cü z\x0b\x0c"]
    hashes, bounds = word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    numbers = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 5, 7, 50):
        want = [(sum(int(numbers[i + j]) * pow(int(BASE), j, 1 << 64) for j in range(size)) + size) % (1 << 64) for i in range(51 - size)]
        assert (rolled(numbers, size) == mixed(np.array(want, np.uint64))).all()


def test_signatures_estimate_weighted_similarity():
    rng, sets, truth = np.random.default_rng(1), [], []
    for _ in range(150):
        base = np.unique(rng.integers(1, 2**62, int(rng.integers(1, 300))).astype(np.uint64))
        weight = rng.integers(1, 9, len(base))
        other = np.where(rng.random(len(base)) < 0.2, rng.integers(1, 9, len(base)), weight)
        keep = rng.random(len(base)) < 0.9
        keep[0] = True
        sets += [(base, weight), (base[keep], other[keep])]
        truth.append(nc.similarity(*sets[-2:]))
    found = nc.signatures(sets, 1024)
    error = (found[0::2] == found[1::2]).mean(1) - np.array(truth)
    assert abs(error.mean()) < 0.004 and error.std() < 0.016
    assert (nc.signatures(sets[::-1], 1024)[::-1] == found).all()
    # Weights need not be whole numbers.
    a, b = (np.arange(1, 60).astype(np.uint64), np.linspace(0.1, 3, 59)), (np.arange(1, 60).astype(np.uint64), np.linspace(3, 0.1, 59))
    both = nc.signatures([a, b], 4096)
    assert abs((both[0] == both[1]).mean() - np.minimum(a[1], b[1]).sum() / np.maximum(a[1], b[1]).sum()) < 0.04


def multiset(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def brute(docs):
    """Least id of what hangs together, by comparing all pairs that share a shingle."""
    by_id = {}
    for doc, text in docs:
        if doc is not None:
            by_id.setdefault(doc, set()).add(text or "")
    texts = {doc: min(t) for doc, t in by_id.items()}
    root = {doc: doc for doc in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    words = {}
    for doc, versions in by_id.items():
        for text in versions:
            link(doc, words.setdefault(tuple(re.findall(r"[^\x20\x09-\x0D]+", text)), doc))
    sets, holders = {d: multiset(t) for d, t in texts.items()}, {}
    for doc, s in sets.items():
        for shingle in s:
            holders.setdefault(shingle, []).append(doc)
    for doc, s in sets.items():
        common = Counter()
        for shingle, n in s.items():
            for other in holders[shingle]:
                if other < doc:
                    common[other] += min(n, sets[other][shingle])
        for other, n in common.items():
            if n / (s.total() + sets[other].total() - n) >= 0.8:
                link(doc, other)
    return Counter((doc, None if doc is None else find(doc)) for doc, _ in docs)


def run(spark, docs, **how):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id long, text string, node string, keys int, class string").repartition(4)
    return Counter(tuple(r) for r in nc.near_copies(frame, **how).collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_small_cases(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    docs, number = [], 0
    passage = [word() for _ in range(60)]
    for group in range(12):
        base = [word() for _ in range(rng.choice([4, 12, 80, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            docs.append((number, changed(rng, base, rng.choice([0, 1, 2, 4]))))
            number += 1
    docs += [(200 + k, " ".join([*passage, *(word() for _ in range(50 + k))])) for k in range(40)]
    docs += [(300 + k, " ".join([*passage, *(f"own{k}" for _ in range(1))] * 2)) for k in range(6)]
    docs += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "one"), (None, "one"), (None, None), (405, "a b c d e"), (406, "a b c d e"), (407, "a b c d")]
    docs += [(408, "z " * 4000), (409, "z " * 4001), (410, "z " * 200), (411, docs[0][1]), (411, docs[20][1]), (412, "same"), (412, "same")]
    assert run(spark, docs) == brute(docs)
    # Without any centres the prefixes alone have to find the links.
    assert run(spark, docs, centres=0) == brute(docs)


def test_every_text_of_an_id_is_compared(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(40)]
    # Text B of 9 is also one of 5, whose other text A is the first in order: C of 12 is similar to B alone.
    docs = [(5, "a " + " ".join(base[0])), (5, "b " + " ".join(base[1])), (9, "b " + " ".join(base[1])), (12, "b " + changed(rng, base[1], 2)), (13, "c " + " ".join(base[2]))]
    for how in ({}, {"centres": 0}):
        assert run(spark, docs, **how) == Counter({(5, 5): 2, (9, 5): 1, (12, 5): 1, (13, 13): 1})
    # Against all pairs of rows.
    docs = [(rng.randrange(60), changed(rng, base[rng.randrange(40)], rng.choice([0, 1, 2, 3]))) for _ in range(70)]
    sets, root = [multiset(text) for _, text in docs], {doc: doc for doc, _ in docs}
    for _ in root:
        for (a, _), x in zip(docs, sets):
            for (b, _), y in zip(docs, sets):
                common = (x & y).total()
                if common / (x.total() + y.total() - common) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    want = Counter((doc, root[doc]) for doc, _ in docs)
    assert run(spark, docs) == want and run(spark, docs, centres=0) == want
    assert len(set(root.values())) > 1


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    found = Counter(tuple(r) for r in nc.near_copies(rows).collect())
    assert found == brute(docs) and len({c for _, c in found}) < len(docs)


def test_empty_table(spark):
    assert run(spark, []) == Counter()
