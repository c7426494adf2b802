"""What filters do to each other: which removes what, in every order.

Every filter has a table with the ids of the rows that fail it. A prefix of an order is the set of filters applied so far; its survivors are those
of a shorter prefix left-anti one more table, so that all 2^n sets come from n joins. A filter's removals after a prefix are its ids left-semi the survivors, its
redundant ids are left-anti them. Rows that fail nothing survive every prefix; they are counted and take no part in the joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .steps import picked, step

#: More filters than this would make a report of over 5040 rows for each part.
MOST_FILTERS = 7
COPY = "E"


def conditions() -> Mapping[str, Column]:
    """Failure conditions over a column `text` that is never null, and `words`, its words."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows, tables): `rows` has row, part, good, toxic for every row of `docs` (doc_id, text, source), and tables[filter] the same for those that fail
    the filter; both written.

    Filters are `conditions` and COPY: the text equals that of a row with a smaller doc_id, anywhere in the table. A null text is empty, a
    null source the empty part. A null doc_id is neither smaller nor larger than another and has no labels; rows that share a doc_id are judged one by one, and none is the
    other's copy. Labels may repeat a doc_id: one row with 1 is enough. Very long texts are one row like others; an empty table gives empty tables.
    """
    texts = picked(docs, "doc_id", "text", "source")
    facts = texts.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    checks = conditions()
    facts = facts.withColumn("words", words).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "part",
        F.sha2("text", 256).alias("digest"),
        F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()])).alias("failed"),
    )
    facts = step(facts)
    marks = picked(labels, "doc_id", "quality", "toxic").groupBy("doc_id")
    marks = marks.agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # Both small sides are written, so that a hot text or id on the other side can be split.
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = step(firsts.where("first < last").select("digest", "first"))
    joined = facts.join(firsts, "digest", "left").join(step(marks.where("doc_id is not null")), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.array(F.lit(COPY))).otherwise(F.array())
    rows = step(
        joined.select(
            "row",
            "part",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
            F.concat("failed", copy).alias("failed"),
        )
    )
    return rows, id_tables(rows, [*checks, COPY])


def id_tables(rows: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """One written table per filter, from `rows` (row, part, good, toxic, failed: names of the filters that the row fails)."""
    folder = scratch(rows.sparkSession)
    ids = rows.select("row", "part", "good", "toxic", F.explode("failed").alias("filter"))
    ids.write.partitionBy("filter").parquet(folder)
    schema = "row long, part string, good boolean, toxic boolean, filter string"
    stored = rows.sparkSession.read.schema(schema).parquet(folder)
    return {name: stored.where(F.col("filter") == name).drop("filter") for name in names}


def survivors(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """prefix, row, part: of the rows that fail something, those left after each set of filters. Bit k of `prefix` is the k-th of `tables`."""
    left = rows.where(F.size("failed") > 0).select(F.lit(0).alias("prefix"), "row", "part")
    for k, ids in enumerate(tables.values()):
        passed = left.join(ids.select("row"), "row", "left_anti")
        left = step(left.unionByName(passed.withColumn("prefix", F.col("prefix") + (1 << k))))
    return left


def audit(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """part, prefix, filter (its place in `tables`), kept, removed, redundant, unique_fails, good_lost, toxic_lost: one row for each part, set of filters
    and filter outside the set, zeros included."""
    n = len(tables)
    left = survivors(rows, tables)
    kept = left.groupBy("part", "prefix").agg(F.count("*").alias("left")).withColumnRenamed("prefix", "after")
    ids = None
    for k, table in enumerate(tables.values()):
        own = table.withColumn("filter", F.lit(k))
        ids = own if ids is None else ids.unionByName(own)
    bit = F.expr("shiftleft(1, filter)")
    before = ids.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).where(F.col("prefix").bitwiseAND(bit) == 0)
    keys = ["prefix", "row"]
    standing = left.select(*keys)
    by = ["part", "prefix", "filter"]
    removed = before.join(standing, keys, "left_semi").groupBy(*by)
    removed = removed.agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    redundant = before.join(standing, keys, "left_anti").groupBy(*by).agg(F.count("*").alias("redundant"))
    other = ids.select(F.col("row").alias("r"), F.col("filter").alias("f"))
    alone = ids.join(other, (F.col("row") == F.col("r")) & (F.col("filter") != F.col("f")), "left_anti").groupBy("part", "filter")
    alone = alone.agg(F.count("*").alias("unique_fails"))
    parts = rows.groupBy("part").agg(F.count_if(F.size("failed") == 0).alias("clean"))
    every = parts.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    every = every.where(F.col("prefix").bitwiseAND(bit) == 0).withColumn("after", F.col("prefix") + bit)
    found = every.join(removed, by, "left").join(redundant, by, "left").join(alone, ["part", "filter"], "left").join(kept, ["part", "after"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    return step(found.select(*by, (F.col("clean") + F.coalesce("left", F.lit(0))).alias("kept"), *counts))


def in_all_orders(counts: DataFrame, names: list[str]) -> DataFrame:
    """The report: part, filter_order, step and the counts of `audit`, with `shapley`, a filter's removals summed over all orders."""
    n = len(names)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have {factorial(n)} orders; {MOST_FILTERS} filters at most")
    steps = [
        ("".join(names[k] for k in order), at + 1, sum(1 << k for k in order[:at]), k)
        for order in permutations(range(n))
        for at, k in enumerate(order)
    ]
    # A table fixed by the number of filters: n! * n rows.
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")
    size = F.bit_count("prefix")
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    shares = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * times).alias("shapley"))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = counts.join(F.broadcast(orders), ["prefix", "filter"]).join(shares, ["part", "filter"])
    return found.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in columns])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report on `docs` (doc_id, text, source) and `labels` (doc_id, quality, toxic) for the filters of this module, in all 120 orders."""
    rows, tables = failing_ids(docs, labels)
    return in_all_orders(audit(rows, tables), list(tables))
