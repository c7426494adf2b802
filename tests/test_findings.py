"""Cases from the reviews of large runs: few rows, counted by hand or by brute force."""

import math

from pyspark.sql import functions as F


def test_distance_pairs_are_dealt_to_many_tasks(spark):
    """One crowded place with equal rows, beside a sparse one: no task compares many more pairs than told, and none is lost."""
    from wayfold.operators.spatial import as_right, join_distance

    spots = [(i % 190, float(i % 37), float(i * 7 % 41)) for i in range(200)] + [(1000 + i, 5000.0 + 60 * i, 9.0) for i in range(20)] + [(None, 1.0, 1.0), (7, None, 3.0)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    found = join_distance(points, as_right(points), 100.0, strict=True, pairs=500)
    told = found.select("id", "rid", F.spark_partition_id().alias("task")).collect()
    real = [s for s in spots if s[1] is not None]
    wanted = [(str(a[0]), str(b[0])) for a in real for b in real if math.hypot(a[1] - b[1], a[2] - b[2]) < 100.0]
    assert sorted((str(r.id), str(r.rid)) for r in told) == sorted(wanted)
    assert max(sum(r.task == t for r in told) for t in {r.task for r in told}) < len(wanted) / 8


def test_cells_along_paths_are_counted_in_many_tasks(spark):
    """Paths of several segments, one of them back and forth: distinct cells and the total over the segments, in more tasks than one."""
    from wayfold.operators.grid import cells_along_path, count_cells_along

    cells = spark.createDataFrame([(10 * i + j, 10.0 * i, 10.0 * i + 10, 10.0 * j, 10.0 * j + 10) for i in range(10) for j in range(10)], "cell_id long, xmin double, xmax double, ymin double, ymax double")
    rows = [(w % 900, float(w * 7 % 100), float(w * 13 % 100), float(w * 29 % 100), float(w * 31 % 100)) for w in range(3000)]
    rows += [(999, 1.0, 1.0, 55.0, 1.0), (999, 55.0, 1.0, 1.0, 1.0)]
    segments = spark.createDataFrame(rows, "way long, x1 double, y1 double, x2 double, y2 double")
    found = count_cells_along(cells, segments, 10.0, "way", counted=300)
    wanted = {}
    for r in cells_along_path(cells, segments, 10.0).collect():
        wanted.setdefault(r.way, []).append(r.cell_id)
    counted = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r.way: (r.cells, r.total) for r in counted} == {w: (len(set(c)), sum(c)) for w, c in wanted.items()}
    assert {r.way: r.cells for r in counted}[999] == 6
    assert len({r.task for r in counted}) > 3


def test_node_types_write_and_shuffle_what_they_need(spark, monkeypatch):
    """Names and lengths of links are neither written nor read again; ramps alone meet their components."""
    from wayfold import session
    from wayfold.plans import catalog

    catalog.load()
    written, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: written.append(df.columns) or cut(df))
    assert catalog.QUERIES["N12_node_types"](spark, "/root/testdata/sf0.001").count() > 0
    assert written and not {"name", "length", "tsys"} & set(written[0])


def test_links_are_made_once_for_reachability(spark):
    """A ring, a tail and a second ring: the rows are made once, whatever they come from."""
    from wayfold.operators import network

    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pairs = [(i, (i + 1) % 9) for i in range(9)] + [(0, 20), (20, 21), (30, 31), (31, 30)]
    pairs += [(8, 0)] * 3 + [(1, 2)] * 2
    links = spark.createDataFrame(pairs, "from_node long, to_node long").mapInArrow(rows, "from_node long, to_node long")
    reached = network.reachable_nodes(links, seeds=2)
    assert sorted(r.node for r in reached.collect()) == list(range(9))
    assert made.value == len(pairs)


def test_pipeline_hands_long_texts_to_python_in_small_batches(spark):
    """Texts of 100,000 characters: a worker is not given all rows of a task at a time."""
    import pyarrow as pa

    import corpus_pipeline

    corpus_pipeline.secret_stage(spark, spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, n_chars long"), "")
    rows = spark.range(200, numPartitions=1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    batches = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(batches) == 200 and max(batches) * 100_000 <= 2 * corpus_pipeline.BATCH
