"""Token ids on disk: segments of separately compressed documents that share a dictionary.

A folder holds three tables. `dictionary` is one row: the shared zstandard dictionary, its SHA-256, the tokenizer's file name, the
id width and the end id. `segments` has rows (part, segment, dictionary_hash, documents, body): `body` is MAGIC and the dictionary's hash
followed by one zstandard frame per document, `documents` the offset index with each document's id, place and size. `parts` has the
number of ids before each part. A short document is read by its index entry and one slice of a body; the index can be read
without the bodies. Segments are bounded (SEGMENT_BYTES, or one longer document) and written by Spark, so that any file system will do and a task that
is run again replaces its files.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import Encoder
from .words import give_back

MAGIC = b"WTOK1\x00"
HEAD = len(MAGIC) + 32
SEGMENT_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is fitted on this many documents, those with the smallest hashes of their ids, and this many ids of each.
SAMPLE_DOCUMENTS = 1000
SAMPLE_IDS = 1 << 14
LEVEL = 3

DICTIONARY = "hash binary, dictionary binary, tokenizer string, width int, end_id long"
ENTRY = "struct<doc_id: bigint, offset: bigint, length: bigint, start: bigint, n_tokens: bigint>"
SEGMENTS = f"part int, segment int, dictionary_hash binary, documents array<{ENTRY}>, n_tokens long, body binary"
PARTS = "part int, base long"
_ENTRY = pa.struct([(name, pa.int64()) for name in ("doc_id", "offset", "length", "start", "n_tokens")])


def _ids(path: str, end_id: int) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    encoder = Encoder(path)
    return lambda texts: (np.append(ids, np.uint32(end_id)) for ids in encoder.encode(texts))


def fit_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary of at most DICTIONARY_BYTES from the id arrays of a bounded sample (see SAMPLE_DOCUMENTS), made in one
    task. Too few or too small samples give a dictionary of plain content, none an empty one."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in ids(batch.column(0))], pa.binary())})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(x for batch in batches for x in batch.column(0).to_pylist())[:SAMPLE_DOCUMENTS]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    rows = sample.repartition(4).mapInArrow(encoded, "ids binary").repartition(1).mapInArrow(fitted, "dictionary binary").collect()
    return bytes(rows[0].dictionary) if rows else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encode every whole text of `docs` (doc_id, text) with the tokenizer file `path`, append `end_id` to each and write them to `folder`
    in ascending order of doc_id.

    A null or empty text has the end id alone. Null doc_ids come first; rows that share a doc_id follow each other in the order of
    their texts. An empty table gives a folder without documents. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select("doc_id", "text")
    data = fit_dictionary(rows, path, end_id, width)
    mark = hashlib.sha256(data).digest()
    spark.createDataFrame([(mark, data, os.path.basename(path), width, end_id)], DICTIONARY).coalesce(1).write.parquet(f"{folder}/dictionary")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids = _ids(path, end_id)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data), write_checksum=True, write_content_size=True)
        body, entries, size = [MAGIC, mark], [], HEAD

        def segment() -> pa.RecordBatch:
            total = sum(e["n_tokens"] for e in entries)
            columns = {
                "part": pa.array([part], pa.int32()),
                "segment": pa.array([number], pa.int32()),
                "dictionary_hash": pa.array([mark], pa.binary()),
                "documents": pa.array([entries], pa.list_(_ENTRY)),
                "n_tokens": pa.array([total], pa.int64()),
                "body": pa.array([b"".join(body)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, one in zip(batch.column(0).to_pylist(), ids(batch.column(1))):
                frame = compressor.compress(one.astype(f"<u{width}").tobytes())
                if entries and size + len(frame) > SEGMENT_BYTES:
                    yield segment()
                    number, body, entries, size = number + 1, [MAGIC, mark], [], HEAD
                entries.append({"doc_id": doc_id, "offset": size, "length": len(frame), "start": start, "n_tokens": len(one)})
                body.append(frame)
                size, start = size + len(frame), start + len(one)
        if entries:
            yield segment()
        give_back()

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(packed, SEGMENTS).write.parquet(f"{folder}/segments")
    # One row per part; partitions of a range exchange are numbered in the order of their keys.
    sizes = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{folder}/parts")


def _meta(spark: SparkSession, folder: str) -> tuple[bytes, bytes, int]:
    row = spark.read.schema(DICTIONARY).parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).digest() != bytes(row.hash):
        raise ValueError(f"the dictionary in {folder} does not have the hash it is stored under")
    return bytes(row.hash), bytes(row.dictionary), row.width


def _with_base(rows: DataFrame, folder: str) -> DataFrame:
    """Turn starts inside a part into starts in the whole; `parts` has one row per partition that wrote."""
    base = rows.sparkSession.read.schema(PARTS).parquet(f"{folder}/parts")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers) of every document, decoded from
    the segments. Fails on a body that was written with another dictionary or is damaged."""
    mark, data, width = _meta(spark, folder)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in range(batch.num_rows):
                part, documents, body = (batch.column(c)[row] for c in range(3))
                view = memoryview(body.as_buffer())
                if bytes(view[:HEAD]) != MAGIC + mark:
                    raise ValueError("a segment was written with another dictionary")
                out: list[tuple] = []
                size = 0
                for e in documents.as_py():
                    ids = np.frombuffer(decompressor.decompress(view[e["offset"] : e["offset"] + e["length"]]), f"<u{width}").astype("<u4")
                    if len(ids) != e["n_tokens"]:
                        raise ValueError(f"document {e['doc_id']} is damaged")
                    out.append((part.as_py(), e["doc_id"], e["start"], e["n_tokens"], ids.tobytes()))
                    size += 4 * len(ids)
                    if size > SEGMENT_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    stored = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").select("part", "documents", "body")
    rows = stored.mapInArrow(opened, "part int, doc_id long, start long, n_tokens long, ids binary")
    return _with_base(rows, folder)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids"])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, part, segment, offset, length of every document; reads no body."""
    stored = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").select("part", "segment", F.explode("documents").alias("d"))
    rows = stored.select("part", "segment", "d.*").withColumn("at", F.col("part"))
    return _with_base(rows, folder).withColumnRenamed("at", "part")


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in `wanted` (doc_id): the index gives the slices, only these are decompressed."""
    mark, data, width = _meta(spark, folder)
    found = read_index(spark, folder).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    bodies = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").select("part", "segment", "dictionary_hash", "body")
    slices = found.join(bodies, ["part", "segment"]).where(F.col("dictionary_hash") == F.lit(mark))
    slices = slices.select("doc_id", "start", "n_tokens", F.substring("body", F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("frame"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            ids = [np.frombuffer(decompressor.decompress(x), f"<u{width}").astype("<u4").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return slices.mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")
