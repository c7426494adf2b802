"""Importance resampling against SQL, and against a plain version for runs of several words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.check import compare, connect
from wayfold.llm import importance, queries

SMALL = "/root/testdata/sf0.001"


def runs(text, longest):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain(docs, target, longest, buckets, least, share, seed="2024"):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(bucket(r) for text in texts for r in runs(text, longest)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        words, found = runs(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(r)) for r in found)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    for k, row in enumerate(able[: len(able) * share // 100]):
        row[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def found(spark, docs, target, **how):
    result = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    return sorted(map(tuple, result.collect()), key=str)


DOCS = [
    (1, "The cat\nthe DOG, the cat!\n\nthe cat"), (2, "the cat\r\nthe DOG"), (3, None), (4, ""), (4, "\n\n"), (5, "Été 1984 — naïve été"), (5, "the cat"), (None, "the dog barks"),
    (6, "a b c d e f g h i j " * 30), (7, "x\ny\nz\nx\ny"), (7, "x\ny\nz\nx\ny"), (8, "word " * 50_000), (9, "no.newline_here-but[marks]"),
]


def test_query_matches_sql(spark):
    frame = queries.QUERIES["op13_importance_resampling"](spark, SMALL)
    rows = [tuple(r) for r in frame.collect()]
    cursor = connect(SMALL).execute(queries.ORACLES["op13_importance_resampling"])
    assert compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) is None


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_of_words_within_and_across_lines(spark, longest):
    target = ["the dog\nbarks", "été", None, ""]
    assert found(spark, DOCS, target, longest=longest, buckets=97, least_words=2, share=50) == plain(DOCS, target, longest, 97, 2, 50)


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    assert found(spark, DOCS, [], least_words=3, share=30, buckets=50) == plain(DOCS, [], 1, 50, 3, 30)
    assert found(spark, DOCS[:3], [None], least_words=0, share=100, buckets=50) == plain(DOCS[:3], [], 1, 50, 0, 100)


def test_clashing_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    extra = docs.select("*", *[F.lit(7).alias(c) for c in ("row", "line", "n_words", "weight", "rank", "meta.url", "Text")], F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    target = spark.createDataFrame([("the dog", 1)], "text string, `a.b` int")
    assert sorted(map(tuple, importance.resample(extra, target, buckets=50, least_words=1).collect()), key=str) == plain(DOCS, ["the dog"], 1, 50, 1, 10)


def test_lines_are_counted_once(spark):
    """A line that very many texts share is one row with its occurrences."""
    docs = spark.createDataFrame([(k, f"shared line of words\nown {k}") for k in range(200)], "doc_id long, text string")
    lines = importance.line_features(docs, 1, 1000)
    assert lines.count() == 201 and lines.agg(F.max("occurrences")).first()[0] == 200
    totals = {r.bucket: r.n for r in importance.bucket_totals(lines.select("occurrences", "buckets"), 1000).collect()}
    want = Counter(zlib.crc32(w.encode()) % 1000 for k in range(200) for w in f"shared line of words own {k}".split())
    assert totals == want
