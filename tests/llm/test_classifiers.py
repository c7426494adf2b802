import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import factor_quality, queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def plain_kernel(a, b, decay=toxicity.DECAY, n=toxicity.LENGTH):
    def features(s):
        out = Counter()
        for places in itertools.combinations(range(len(s)), n):
            if all(s[p].isalnum() for p in places):
                out["".join(s[p] for p in places)] += decay ** (places[-1] - places[0] + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items())


WORDS = ["idiot", "i.d.i.o.t", "idot", "abc", "ab", "aaaa", "héros", "abcabcabc", "zz-top"]


def test_kernel_is_that_over_all_subsequences():
    codes = toxicity.coded(WORDS)
    for k, word in enumerate(WORDS):
        assert toxicity.kernel(codes, codes[k]) == pytest.approx([plain_kernel(w, word) for w in WORDS], rel=1e-4)
    assert toxicity.self_kernel(codes) == pytest.approx([plain_kernel(w, w) for w in WORDS], rel=1e-4)


def test_gaps_and_insertions_are_tolerated():
    rng = np.random.default_rng(1)
    syllables = ["ra", "ton", "mel", "ub", "kes", "lin", "do", "fa"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, label = [], []
    for k in range(900):
        words = [word() for _ in range(rng.integers(3, 60))]
        if k % 6 == 0:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["scoundrel", "blockhead", "weasel"])))
        texts.append(" ".join(words) + ".")
        label.append(k % 6 == 0)
    machine = toxicity.fit(texts, np.array(label, int))
    bad = ["you s.c.o.u.n.d.r.e.l", "a block-head", "such a weasel here", "w e a s e l", "scounxdrel ra ton", "blockhead!"]
    good = ["ra ton mel ub", "", None, "!!", "a b", "fado kestonmel", "round the block"]
    assert (machine.score(bad) >= 0.5).all() and (machine.score(good) < 0.5).all()


def test_pairs_by_the_identity():
    rng = np.random.default_rng(2)
    size = factor_quality.BUCKETS + len(factor_quality.STATISTICS)
    machine = factor_quality.Machine(0.3, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, 8)), np.zeros(len(factor_quality.STATISTICS)), np.ones(len(factor_quality.STATISTICS)))
    text = "some words and some more words here, # and | there"
    buckets, values, statistic = factor_quality.text_inputs(text, 50.0)
    x = dict(zip(buckets, values)) | {factor_quality.BUCKETS + k: v for k, v in enumerate(machine.scaled(np.array(statistic)))}
    want = 0.3 + sum(machine.weights[i] * v for i, v in x.items())
    want += sum(machine.vectors[i] @ machine.vectors[j] * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    assert machine.score([text], [50.0])[0] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-4)


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.95), ("op6_quality_classifier", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if label == "toxic" else 0.3)) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in held if r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) >= least


@pytest.mark.parametrize("module, fit, score, label", [
    (toxicity, toxicity.fit_toxicity, toxicity.score_toxicity, "toxic"),
    (factor_quality, factor_quality.fit_quality, factor_quality.score_quality, "quality"),
])
def test_small_tables(spark, module, fit, score, label):
    rows = [(k, "plain words here " * (k % 5), 3 * k, "x", 0.5) for k in range(20)]
    rows += [(None, None, None, "x", 0.5), (4, "idiot " * 100_000, 1, "x", 0.5), (4, "idiot " * 100_000, 1, "x", 0.5), (5, "", None, "x", 0.5), (6, "\n \x00", -5, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label string, score double")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2, "x") for k in range(18)] + [(None, 1, 0, "x"), (3, None, None, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    found = score(docs, fit(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    no_docs, no_labels = docs.limit(0), labels.limit(0)
    assert score(no_docs, fit(no_docs, labels)).collect() == []
    assert len({round(r.score, 9) for r in score(docs, fit(docs, no_labels)).collect()}) == 1
    assert len(score(docs.drop("n_chars"), fit(docs.drop("n_chars"), labels)).collect()) == len(rows)
