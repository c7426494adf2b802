import random
import re

import numpy as np
import pytest

from wayfold.llm import substrings


def brute(docs, size):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in docs]
    for (doc, _), words in zip(docs, split):
        for k in range(len(words) - size + 1):
            if doc is not None:
                window = tuple(words[k : k + size])
                first[window] = min(first.get(window, doc), doc)
    out = []
    for (doc, _), words in zip(docs, split):
        gone = set()
        for k in range(len(words) - size + 1):
            if doc is not None and first[tuple(words[k : k + size])] < doc:
                gone |= set(range(k, k + size))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def run(spark, docs, size):
    frame = spark.createDataFrame([(*r, "x", 1, []) for r in docs], "doc_id long, text string, anchor string, low int, ranges array<int>").repartition(3)
    return sorted((tuple(r) for r in substrings.without_repeats(frame, size).collect()), key=str)


@pytest.mark.parametrize("size", [2, 3, 8, 9, 17, 33, 50])
def test_index_finds_the_least_owner_of_every_window(size):
    rng = np.random.default_rng(size)
    base, strings = rng.integers(0, 5, 400).astype(np.uint64), []
    for _ in range(60):
        a = int(rng.integers(0, 300))
        part = base[a : a + int(rng.integers(size, size + 40))].copy()
        if rng.random() < 0.5 and len(part):
            part[rng.integers(len(part))] = rng.integers(0, 7)
        if len(part) >= size:
            strings.append(part)
    owners = rng.integers(0, 30, len(strings))
    first = {}
    for s, o in zip(strings, owners.tolist()):
        for k in range(len(s) - size + 1):
            first[tuple(s[k : k + size])] = min(first.get(tuple(s[k : k + size]), o), o)
    want = [[first[tuple(s[k : k + size])] for k in range(len(s) - size + 1)] for s in strings]
    assert [x.tolist() for x in substrings.Index(strings, owners, size).stream()] == want


def test_ranks():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 1000)
    matrix = substrings.WaveletMatrix(values, 6)
    asked, low, high = rng.integers(0, 37, 500), rng.integers(0, 1001, 500), rng.integers(0, 1001, 500)
    a, b = matrix.rank(asked, low, high)
    assert a.tolist() == [int((values[:p] == v).sum()) for v, p in zip(asked, low)]
    assert b.tolist() == [int((values[:p] == v).sum()) for v, p in zip(asked, high)]


@pytest.mark.parametrize("size", [4, 12])
def test_small_cases(spark, size):
    rng = random.Random(size)
    vocabulary = ["the", "of", "and", "é\x1cé", " ", "q"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n\t"]) for _ in range(n))
    common = text(3 * size)
    docs = [(k, text(rng.choice([0, size - 1, 40]))) for k in range(40)]
    docs += [(50 + k, f"{text(5)} {common} {text(k % 4)}") for k in range(20)]
    docs += [(90, docs[3][1]), (90, docs[3][1]), (90, docs[45][1]), (None, common), (None, None), (91, None), (92, ""), (93, " \n"), (3, common), (94, "a " * 20_000), (95, "a " * 20_001)]
    assert run(spark, docs, size) == brute(docs, size)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 5)
    monkeypatch.setattr(substrings, "SHARD", 40)
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage = " ".join(word() for _ in range(30))
    docs = [(k, " ".join(word() for _ in range(15)) + f" {passage} " + " ".join(word() for _ in range(15))) for k in range(60)]
    docs += [(100 + k, docs[k % 7][1]) for k in range(12)]
    assert run(spark, docs, 12) == brute(docs, 12)


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    found = sorted((tuple(r) for r in substrings.without_repeats(rows).collect()), key=str)
    assert found == brute(docs, 50) and sum(r[2] for r in found) > 0


def test_empty_table(spark):
    assert run(spark, [], 50) == []
