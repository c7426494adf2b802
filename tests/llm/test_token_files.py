import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import token_files, tokens
from wayfold.session import scratch

PATHS = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
TEXTS = [
    None, "", " ", "  a  b ", "a\n\n b\t\tc \r\n x", "a b", "é ́x", "don't  'S we'll", "a\x1cb \x1c!", "<|endoftext|> a <|endoftext|>", " \n",
    "x" * 2000, "é　 q", "123 4 5", "a\n", "a \nb", "a\x00b", " a", "x\n \ny", "Σίσυφος ΟΔΟΣ", "ǅ İ ﬁ", "\x01 a \x01", "a\x85b", " ".join(f"q{k}" for k in range(9_000)), "word " * 120_000, "\n".join(f"line {k}" for k in range(40_000)),
]


@pytest.mark.parametrize("path", PATHS)
def test_encoder_is_exact(path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 1 << 12)
    plain, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = TEXTS + TEXTS[::-1] + ["".join(chr(33 + (i * j) % 400) + " \n\t "[i % 4] for i in range(1, 200)) for j in range(1, 60)]
    for text, ids in zip(texts, list(encoder.encode(texts)), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", PATHS)
def test_round_trip(spark, path):
    rows = [(None if k == 3 else (k * 7) % 19, t, "x", 5) for k, t in enumerate(TEXTS)] + [(4, "twice", "x", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(4)
    folder = scratch(spark)
    token_files.write_tokens(docs, folder, path, 1)
    plain, at = Tokenizer.from_file(path), 0
    want = []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = token_files.read_tokens(spark, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found), key=lambda r: r[1]) == want
    some = spark.createDataFrame([(4,), (7,), (999,)], "doc_id long")
    few = token_files.read_documents(spark, folder, some).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in few), key=lambda r: r[1]) == [w for w in want if w[0] in (4, 7)]
    index = token_files.read_index(spark, folder)
    assert index.count() == len(want) and index.select("start").distinct().count() == len(want)


def test_another_dictionary_is_found(spark):
    folders = [scratch(spark), scratch(spark)]
    for folder, text in zip(folders, ("alpha beta", "gamma")):
        token_files.write_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), folder, PATHS[0], 1)
    spark.read.parquet(f"{folders[1]}/segments").write.mode("append").parquet(f"{folders[0]}/segments")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_tokens(spark, folders[0]).collect()


def test_empty_table(spark):
    folder = scratch(spark)
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, PATHS[0], 1)
    assert token_files.read_tokens(spark, folder).collect() == [] and token_files.read_index(spark, folder).collect() == []
