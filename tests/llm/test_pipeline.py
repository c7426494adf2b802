import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_copies import brute as classes

import corpus_pipeline as pipeline
from wayfold.llm import near_copies, queries, secrets
from wayfold.session import cut

FOLDER = "/root/testdata/sf0.01"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [rows]
    for _, stage in pipeline.STAGES:
        rows = cut(stage(spark, rows, FOLDER))
        out.append(rows)
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_are_registered(spark):
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in entry.queries()
    assert len(pipeline.STAGES) == 5 and set(entry.oracle_sql()) <= set(entry.queries())


def test_quality(spark, steps):
    kept = {r.doc_id for r in queries.QUERIES["op10_quality_rules"](spark, FOLDER).collect() if r.kept}
    assert set(by_id(steps[1])) == kept and 0 < len(kept) < steps[0].count()


def test_one_of_each_class_stays(steps):
    before = by_id(steps[1])
    found = classes([(k, r.text) for k, r in before.items()])
    assert by_id(steps[2]) == {k: r for k, r in before.items() if found[k, k]}
    assert len(by_id(steps[2])) < len(before)


def test_no_benchmark_passage_stays(spark, steps):
    tests = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    before = by_id(steps[2])
    hit = {r[0] for r in contaminated([(k, r.text) for k, r in before.items()], tests) if r[2]}
    assert by_id(steps[3]) == {k: r for k, r in before.items() if k not in hit} and hit


def test_secrets_are_masked(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert set(before) == set(after) and steps[4].columns == steps[0].columns
    masked = 0
    for k, r in before.items():
        spans = [{"kind": a, "start": b, "end": c} for a, b, c in secrets.spans_of(r.text)]
        assert after[k].text == secrets.masked(r.text, spans) and after[k].n_chars == len(after[k].text)
        masked += bool(spans)
    assert masked


def test_everything_is_packed(spark, steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    want, members = Counter(), {}
    for k, r in by_id(steps[4]).items():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want.update((k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:])))
    rows = steps[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        members.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in members.values():
        assert sum(n for _, n in parts) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0


def test_odd_rows(spark):
    rows = [(1, "same words in two rows here", "en", "a", 3), (1, "same words in two rows here", "en", "a", 3), (1, "another text of that id", "en", "b", None)]
    rows += [(None, "same words in two rows here", None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = STAGES["near copies"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert found == [(False, 1, "another text of that id"), (False, 1, "same words in two rows here"), (False, 2, ""), (True, 0, ""), (True, 0, "same words in two rows here")]
    for name in ("decontamination", "secrets"):
        assert STAGES[name](spark, docs, FOLDER).count() == len(rows)
    assert STAGES["quality rules"](spark, docs, FOLDER).count() == 0
    assert STAGES["packing"](spark, docs, FOLDER).count() == len(rows)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Unrelated texts of an id all stay; a text that a smaller id has goes, whatever else its id has."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    rows = [(1, a), (1, b), (2, c), (5, b + " eight"), (9, c), (9, "a text of nine alone and nobody else"), (9, a)]
    kept = STAGES["near copies"](spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    similar = near_copies.similarity(*near_copies._sets(pa.array([b, b + " eight"]))) >= near_copies.LEAST_SIMILARITY
    assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (1, b), (2, c), (9, rows[5][1])] + [rows[3]] * (not similar))


def test_other_columns_pass_all_stages(spark):
    """Names with dots, of inner columns, or that differ in case alone, and maps, come out as they went in."""
    words = " ".join(f"word{k} of the sentence number {k}." for k in range(40))
    docs = spark.createDataFrame([(1, words, 5), (2, words, 5), (1, words, 5)], "doc_id long, text string, n_chars long")
    extra = {c: F.lit(7) for c in ("meta.url", "rules", "row", "class", "first", "spans", "doc", "column 3")}
    docs = docs.withColumns(extra).select("*", F.lit("r").alias("Rules"), F.lit("t").alias("TEXT"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert all(r[3] == 7 and r[-1] == {"k": 1} and r[-2] == "t" for r in map(tuple, out.collect())), name
    assert STAGES["near copies"](spark, docs, FOLDER).count() == 1
    assert STAGES["packing"](spark, docs, FOLDER).count() == 3
