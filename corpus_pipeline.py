"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of `documents`; the last returns the packed pieces. Between stages
the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, near_copies, packing, quality_rules, secrets
from wayfold.session import cut

#: Packing: the tokenizer's file, the id that ends a document, and the tokens of a sequence.
TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Bytes of text a worker tokenises at a time: small, as the stages before have left their traces in its memory.
BLOCK = 4 << 20


#: Bytes of rows that go to a Python worker at a time. Batches lie in the memory of the executor's JVM and of the worker, on their way there and back, and both keep some of it for the stages after.
BATCH = 2 << 20


def _small_batches(spark: SparkSession) -> None:
    """From here on rows go to Python in batches of about BATCH bytes, whatever the length of their texts. No result depends on batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


#: Columns that a stage may read or change; all others are handed on under numbers, whatever they are called.
COLUMNS = ("doc_id", "text", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with names that clash with nothing; `toDF(*docs.columns)` gives the old ones back."""
    return docs.toDF(*[c if c in COLUMNS else f"column {k}" for k, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest, which is fitted on labelled rows of the input tables."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _numbered(docs)
    forest = quality_rules.fit_rules(rows.select("doc_id", "text"), labels)
    kept = quality_rules.judge(rows, forest).where("rules.kept").select(*[f"`{c}`" for c in rows.columns])
    return kept.toDF(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts: that with the least doc_id. Rows are judged by their texts: those that share a doc_id are in one class only if
    their texts are. Rows without a doc_id are in no class and stay."""
    _small_batches(spark)
    rows = _numbered(docs)
    repeats = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():  # ids are as good as numbers of rows, which would have to be written with the texts
        rows = rows.withColumn("row", F.col("doc_id").cast("long"))
    else:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    known = rows.where("doc_id is not null")
    classes = near_copies.near_copies(known.select(F.col("row").alias("doc_id"), "text")).withColumnsRenamed({"doc_id": "row", "class_id": "class"})
    classes = cut(classes.where("row is not null").join(known.select("row", "doc_id"), "row"))
    # One row per class and task moves; written, so that a class of very many copies can be split.
    firsts = cut(classes.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", F.col("first.row").alias("first")))
    gone = cut(classes.join(firsts, "class").where("row <> first").select("row"))
    return rows.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; rows are judged one by one, by id and text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(_numbered(docs), benchmark).toDF(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind."""
    _small_batches(spark)
    return secrets.mask_secrets(_numbered(docs)).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    _small_batches(spark)
    import public_tokenizers

    packed = packing.pack(_numbered(docs), public_tokenizers.path(TOKENIZER), END_ID, CAPACITY, BLOCK)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Fitted forests, signatures and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        rows = cut(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
