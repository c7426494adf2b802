"""Benchmark passages in training documents, found in a positional inverted index. DataFrame functions only.

The index has one posting (document, term, position) per occurrence of a term that the tests ask for. A term is three words in a row: single words like "of"
would fill the index with lists that decide nothing. A phrase is looked up by its rarest term first, whose list, moved by
the term's place in the phrase, gives the starting points; these are intersected with the moved lists of its other terms.

A document is known by (doc_id, hash of its text), so that rows which share a doc_id do not share postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters that are lowered, and what is not part of a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM_WORDS = 3
KEY = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() does the same to ASCII texts and is much faster; other letters than A-Z stay as they are.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    """Equal document, a null doc_id being equal to another, and equal columns `more`."""
    on = left["text_hash"].eqNullSafe(right["text_hash"]) & left["doc_id"].eqNullSafe(right["doc_id"])
    for name in more:
        on = on & (left[name] == right[name])
    return on


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words of every row; other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(F.col("text")).alias("words"))


def phrases(tests: DataFrame, size: int) -> DataFrame:
    """phrase (array of words), item_id: every `size` consecutive words of a test text; a shorter text is one phrase."""
    split = tests.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return split.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("phrase")).distinct()


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """An index of single words: one row (doc_id, text_hash, term, position) for each occurrence of one of `terms` (term, distinct)."""
    return documents.select(*KEY, F.posexplode("words").alias("position", "term")).join(terms, "term", "left_semi")


def _terms(words_column: str, size: int) -> Column:
    """Array of structs (w0, w1, ...): the words from each position on, `size` of them, null beyond the end."""
    names = [f"w{k}" for k in range(size)]
    shifted = [F.slice(words_column, k + 1, F.greatest(F.size(words_column) - k, F.lit(0))).alias(names[k]) for k in range(size)]
    return F.arrays_zip(*shifted)


def _term_rows(rows: DataFrame, keep: list[str], words_column: str, size: int, place: str) -> DataFrame:
    """One row for each term of `size` words: `keep`, its place and its words, with a hash of them."""
    names = [f"w{k}" for k in range(size)]
    out = rows.select(*keep, F.posexplode(_terms(words_column, size)).alias(place, "w")).select(*keep, place, "w.*")
    return out.select(*keep, place, *names, F.xxhash64(*names).alias("h"))


def term_index(documents: DataFrame, distinct: DataFrame, size: int) -> DataFrame:
    """The index for `distinct` (phrase_id, phrase): doc_id, text_hash, term, position. One pass over keyed `documents`; the vocabulary of
    the tests meets them by hash and is then compared word by word. Whether it is broadcast is left to the planner, by its written size."""
    names = [f"w{k}" for k in range(size)]
    vocabulary = cut(_term_rows(distinct, [], "phrase", size, "place").where(F.col(names[-1]).isNotNull()).select("h", *names).distinct())
    asked = vocabulary.select("h", F.concat_ws(" ", *names).alias("term"), *[F.col(n).alias(f"v{n}") for n in names])
    rows = _term_rows(documents, KEY, "words", size, "position").withColumnRenamed("h", "own")
    on = rows["own"] == asked["h"]
    for n in names:
        on = on & (F.col(n) == F.col(f"v{n}"))
    return rows.join(asked, on).select(*KEY, "term", "position")


def _matches_of_size(documents: DataFrame, distinct: DataFrame, size: int) -> DataFrame:
    index = cut(term_index(documents, distinct, size))
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    names = [f"w{k}" for k in range(size)]
    terms = _term_rows(distinct, ["phrase_id", "length"], "phrase", size, "place").where(F.col(names[-1]).isNotNull())
    terms = terms.select("phrase_id", "length", "place", F.concat_ws(" ", *names).alias("term")).join(frequency, "term", "left")
    plan = terms.groupBy("phrase_id", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("plan"))
    # A phrase with a term that never occurs cannot occur. The others start from the rarest term.
    plan = cut(plan.where(F.col("plan")[0]["n"] > 0))
    rarest = plan.select("phrase_id", "length", F.col("plan")[0]["place"].alias("place"), F.col("plan")[0]["term"].alias("term"))
    rest = plan.select("phrase_id", F.size("plan").alias("wanted"), F.explode("plan").alias("t")).select("phrase_id", "wanted", F.col("t.place").alias("place"), F.col("t.term").alias("term"))
    starts = index.join(rarest, "term").select(*KEY, "phrase_id", "length", (F.col("position") - F.col("place")).alias("start"))
    expected = starts.where("start >= 0").join(rest, "phrase_id").select(*KEY, "phrase_id", "length", "wanted", "start", "term", (F.col("start") + F.col("place")).alias("position"))
    lists = index.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("x"), F.col("term").alias("t"), F.col("position").alias("p"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("text_hash")) & (F.col("t") == F.col("term")) & (F.col("p") == F.col("position"))
    # Rows that repeat a document repeat its postings; a start counts its terms once.
    found = expected.distinct().join(lists, same, "left_semi")
    return found.groupBy(*KEY, "phrase_id", "length", "start", "wanted").agg(F.count("*").alias("n")).where("n = wanted").drop("n", "wanted")


def exact_matches(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, text_hash, phrase_id, length, start of every occurrence of `distinct` (phrase_id, phrase) in keyed `documents`."""
    distinct = cut(distinct.withColumn("length", F.size("phrase")))
    # Phrases of fewer words than a term has are looked up by shorter terms, in an index of their own.
    own = F.least("length", F.lit(TERM_WORDS))
    sizes = sorted(r[0] for r in distinct.select(own).distinct().collect()) or [TERM_WORDS]
    found = [_matches_of_size(documents, distinct.where(own == size), size) for size in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_rarity(distinct: DataFrame, frequency: DataFrame) -> DataFrame:
    """phrase_id, phrase, plan: the phrase's words as (n, place, term), rarest in the corpus first."""
    terms = distinct.select("phrase_id", F.posexplode("phrase").alias("place", "term")).join(frequency, "term", "left")
    plan = terms.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("plan"))
    return distinct.join(plan, "phrase_id")


def near_matches(documents: DataFrame, distinct: DataFrame, slack: int) -> DataFrame:
    """doc_id, text_hash, phrase_id, start, end: spans of at most the phrase's length plus `slack` words that hold all its distinct
    words in any order, cut to the first and last of them. The postings of the phrase's rarest term are the anchors; every window
    around an anchor is filled from the index and kept if no term is missing. Work per anchor is the square of the window."""
    terms = cut(distinct.select(F.explode("phrase").alias("term")).distinct())
    index = cut(postings(documents, terms))
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    planned = cut(_by_rarity(distinct, frequency).where(F.col("plan")[0]["n"] > 0))
    first = planned.select("phrase_id", (F.size("phrase") + slack).alias("span"), F.col("plan")[0]["term"].alias("term"), F.size(F.array_distinct("phrase")).alias("wanted"))
    others = planned.select("phrase_id", F.explode(F.array_distinct("phrase")).alias("term"))
    anchors = index.join(first, "term").select(*KEY, "phrase_id", "span", "wanted", F.col("position").alias("anchor"))
    # Every window of `span` words around an anchor is one candidate span; it counts the distinct terms in it.
    windows = anchors.select("*", F.explode(F.sequence(F.greatest(F.col("anchor") - F.col("span") + 1, F.lit(0)), F.col("anchor"))).alias("start"))
    slots = windows.select(*KEY, "phrase_id", "span", "wanted", "start").distinct()
    slots = slots.select("*", F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("position"))
    lists = index.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("position").alias("at"), F.col("term").alias("term"))
    at = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")) & (F.col("at") == F.col("position"))
    hits = slots.join(lists, at).drop("d", "h", "at")
    hits = hits.join(others, ["phrase_id", "term"])
    full = hits.groupBy(*KEY, "phrase_id", "start", "wanted").agg(F.count_distinct("term").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).where("n = wanted")
    return full.select(*KEY, "phrase_id", F.col("low").alias("start"), (F.col("high") + 1).alias("end")).distinct()


def numbered(windows: DataFrame) -> DataFrame:
    """phrase_id, phrase: the distinct phrases; the id is a digest of the words, none of which contains a blank."""
    return windows.select(F.sha2(F.concat_ws(" ", "phrase"), 256).alias("phrase_id"), "phrase").distinct()


def contamination(docs: DataFrame, tests: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit (words inside an occurrence of a window of `tests`),
    n_items (test items with occurring windows), items (their ids as sorted texts).

    Null and empty texts have no words and no windows. A test with a null item_id hits words but is not listed. Rows that repeat a
    doc_id are judged one by one. Empty tables give no rows, or no hits. Other columns are not read.
    """
    documents = keyed(docs)
    windows = cut(phrases(tests, size).withColumn("phrase_id", F.sha2(F.concat_ws(" ", "phrase"), 256)))
    matches = cut(exact_matches(documents, windows.select("phrase_id", "phrase").distinct()))
    covered = matches.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")).distinct()
    hit = covered.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    owners = windows.where("item_id is not null").select("phrase_id", F.col("item_id").cast("string").alias("item"))
    items = matches.select(*KEY, "phrase_id").distinct().join(owners, "phrase_id").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    counted = documents.select(*KEY, F.size("words").cast("long").alias("n_words"))
    out = counted.join(hit, _same(counted, hit), "left").select(counted["doc_id"], counted["text_hash"], "n_words", "n_hit")
    out = out.join(items, _same(out, items), "left").select(out["doc_id"], "n_words", "n_hit", "items")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def clean(docs: DataFrame, tests: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) without a hit by a window of `tests`, with all their columns. Defined for odd rows as in
    `contamination`; an empty table of tests keeps all rows."""
    documents = keyed(docs)
    windows = phrases(tests, size).select("phrase").distinct()
    matches = exact_matches(documents, numbered(windows))
    hit = cut(matches.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("hit_hash"))
    return rows.join(hit, same, "left_anti").select("row.*")
