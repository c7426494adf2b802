import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [
    None, "", " \n\t\x0b\x0c\r", "a", "a b c", "a b c a b c", "a a a a", "a b a b a b a", "#tag <x> | & 100% $5 *", "x\n\nx\nx \n x\n\n", "é ü ö z",
    "one\x1ctwo three", "w " * 50_000, " ".join(str(k) for k in range(30_000)), "\n".join(["same line"] * 400), " ".join(f"w{k % 70}" for k in range(300)),
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts(text):
    assert rules.statistics(text)[:5] == brute(text)


def test_forest_parts_the_odd():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, 8))
    odd = rng.normal(0, 1, (200, 8)) + np.eye(8)[rng.integers(0, 8, 200)] * 40
    forest = rules.fit(np.vstack([good, odd]), np.arange(2200) < 2000)
    more = np.vstack([rng.normal(0, 1, (1000, 8)), rng.normal(0, 1, (100, 8)) + np.eye(8)[rng.integers(0, 8, 100)] * 40])
    kept = forest.paths(more) >= forest.cut
    assert kept[:1000].mean() > 0.99 and kept[1000:].mean() < 0.05


@pytest.mark.parametrize("rows, good", [(np.zeros((0, 8)), np.zeros(0, bool)), (np.zeros((5, 8)), np.ones(5, bool)), (np.zeros((6, 8)), np.arange(6) < 3)])
def test_forest_without_a_cut(rows, good):
    forest = rules.fit(rows, good)
    assert (forest.paths(np.ones((3, 8))) >= forest.cut).all()


def test_small_tables(spark):
    rows = [(None if k % 5 == 0 else k // 2, t, "x", 1, [0.0]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string, n_words int, shares array<double>")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    judged = rules.judge(docs, rules.fit_rules(docs, labels))
    assert judged.columns == ["doc_id", "text", "n_words", "shares", "rules"]
    found = Counter((r.doc_id, *[r.rules[c] for c in rules.COUNTS]) for r in judged.collect())
    assert found == Counter((r[0], *brute(r[1])) for r in rows)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judge(nothing, rules.fit_rules(nothing, spark.createDataFrame([], "doc_id long, quality int"))).collect() == []


def test_documents(spark):
    from wayfold.llm import queries

    folder = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_quality_rules"](spark, folder).collect()
    assert len(rows) == len(docs)
    held = Counter()
    for r in rows:
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
        if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed:
            held[label[r.doc_id], r.kept] += 1
    assert held[1, True] >= 0.99 * (held[1, True] + held[1, False])
    assert held[0, False] >= 0.9 * (held[0, True] + held[0, False])
