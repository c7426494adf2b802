"""The filter audit against SQL on the given tables and a plain version on odd rows."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tests.check import compare, connect
from wayfold.llm import filter_audit, queries

SMALL = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        facts.append((source or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                before = [f for f in own if letter in f[1] and f not in left]
                redundant = sum(letter in f[1] for f in own) - len(gone)
                assert len(before) <= redundant
                left = [f for f in left if letter not in f[1]]
                shapley[letter] += len(gone)
                alone = sum(f[1] == {letter} for f in own)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), redundant, alone, sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def report(spark, docs, labels):
    found = filter_audit.interactions(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(map(tuple, found.collect()))


def test_query_matches_sql(spark):
    frame = queries.QUERIES["op12_filter_audit"](spark, SMALL)
    rows = [tuple(r) for r in frame.collect()]
    cursor = connect(SMALL).execute(queries.ORACLES["op12_filter_audit"])
    assert compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) is None


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = [
        (1, None, "a"), (2, "", "a"), (3, long, None), (4, long, ""), (4, long, "a"), (5, long + " #", "b"), (None, long, "b"), (None, None, None),
        (6, "Ab " * 40, "b"), (7, "x " * 200_000, "a"), (8, "A" * 300 + long, "c"), (9, long, "c"), (9, "tab\tnew\nline one word", "c"),
    ]
    labels = [(1, 1, 0), (4, None, 1), (4, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 1), (9, 1, 1)]
    assert report(spark, docs, labels) == plain(docs, labels)
    assert report(spark, docs[:2], []) == plain(docs[:2], [])
    assert report(spark, [], labels) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s")], DOCS)
    extra = docs.select("*", *[F.lit(7).alias(c) for c in ("part", "row", "A", "failed", "meta.url", "Source", "prefix")], F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    labels = spark.createDataFrame([(2, 1, 0)], LABELS)
    want = sorted(map(tuple, filter_audit.interactions(docs, labels).collect()))
    assert sorted(map(tuple, filter_audit.interactions(extra, labels.withColumn("GOOD", F.lit(1))).collect())) == want
    assert len(want) == 600


def test_tables_hold_the_failing_ids(spark):
    docs = spark.createDataFrame([(1, "few words", "s"), (2, "few words", "s"), (3, " ".join(map(str, range(70))), "s")], DOCS)
    rows, tables = filter_audit.failing_ids(docs, spark.createDataFrame([], LABELS))
    assert {name: t.count() for name, t in tables.items()} == {"A": 2, "B": 0, "C": 0, "D": 0, "E": 1}
    left = filter_audit.survivors(rows, tables).groupBy("prefix").count().collect()
    assert {r["prefix"]: r["count"] for r in left} == {p: 2 - (1 if p & 16 else 0) for p in range(32) if not p & 1}
