"""Written steps and safe column picking for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame) -> DataFrame:
    """`cut`, after which the shuffle files of this one write are deleted: the written table replaces them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return cut(df)
    finally:
        conf.set(CLEANUP, before)


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else is there: names with dots, or that differ in case alone."""
    places = [df.columns.index(name) for name in names]
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{p}").alias(name) for p, name in zip(places, names)])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (one more entry than texts). A null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose texts have about `limit` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
