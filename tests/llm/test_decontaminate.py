import random
import re

from wayfold.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, tests, size=10):
    windows = {}
    for item, text in tests:
        w = words(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])] - {None}
        items = sorted(map(str, items))
        out.append((doc, len(w), len(hit), len(items), items))
    return sorted(out, key=str)


def run(spark, docs, tests):
    d = spark.createDataFrame([(*r, "x", 1, []) for r in docs], "doc_id long, text string, term string, position int, words array<string>")
    t = spark.createDataFrame([(*r, "x", 2) for r in tests], "item_id long, text string, phrase string, n int")
    return sorted((tuple(r) for r in decontaminate.contamination(d, t).collect()), key=str)


def test_small_cases(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "ÄÖ", "q1", "naïve", "x", "zebra", "yak", "The"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    tests = [(1, text(30)), (2, text(12)), (3, text(4)), (11, text(10)), (5, ""), (6, None), (None, text(11)), (7, "the the the the the the the the the the the"), (7, "yak yak"), (8, "!?")]
    docs = [(k, text(rng.choice([0, 3, 50]))) for k in range(40)]
    docs += [(100 + k, f"{text(9)} {t} {text(9)} {t}") for k, (_, t) in enumerate(tests)]
    docs += [(100, docs[45][1]), (100, docs[45][1]), (None, tests[0][1]), (None, None), (200, ""), (201, "the " * 30_000), (202, tests[0][1].upper())]
    assert run(spark, docs, tests) == brute(docs, tests)


def test_one_passage_in_most_documents(spark):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = [(k, f"start{k} {passage} end{k}") for k in range(600)] + [(1000 + k, f"other {k}") for k in range(50)]
    assert run(spark, docs, [(1, passage), (2, passage)]) == brute(docs, [(1, passage), (2, passage)])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [])]


def test_near_matches(spark):
    docs = [(1, "x alpha the beta of gamma y"), (2, "gamma alpha beta"), (3, "alpha beta one two three four five gamma"), (4, "alpha beta"), (None, None)]
    d = decontaminate.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    p = spark.createDataFrame([("p", ["alpha", "beta", "gamma"])], "phrase_id string, phrase array<string>")
    found = sorted({(r.doc_id, r.start, r.end) for r in decontaminate.near_matches(d, p, 2).collect()})
    assert found == [(1, 1, 6), (2, 0, 3)]
