"""What keeps large runs within their disk and time."""

import os

from drawlake.operators import cascade, spatial
from drawlake.plans.queries import QUERIES
from drawlake.sources import writers
from drawlake.sources.scratch import shared_folder


def _kept(spark) -> int:
    top = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


def test_dispute_chunks_keeps_no_copy_of_the_readings(spark, sf):
    before = _kept(spark)
    df = QUERIES["dispute_chunks"](spark, sf)
    assert df.count() and _kept(spark) == before
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2 and "DataFilters: [isnotnull(l_suppkey" not in plan  # both readers share an exchange


def test_compare_matches_as_greedy_match(spark):
    schema = "page int, ord bigint, text string, bbox struct<x0:int,y0:int,x1:int,y1:int>"
    box = lambda i, d: (37 * i % 90 + d, 53 * i % 90, 37 * i % 90 + 40 + d, 53 * i % 90 + 30 + i % 5)
    rows = lambda d: [(p, i, "V1", box(i, d)) for p in (1, 2, None) for i in range(40)] + [(3, 1, "V1", None), (4, 1, "V1", (9, 9, 3, 3)), (5 + d, 1, "V1", (0, 0, 9, 9))]
    a, b = spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(3), schema)
    want = sorted(map(tuple, spatial.greedy_match(a, b).select("page", "a_ord", "b_ord", "iou").collect()))
    c = cascade.compare(a, b, keep=False)
    both = c.both.select("ra.page", "ra.ord", "rb.ord", "iou").collect()
    assert want and sorted(tuple(r) for r in both if r[3] is not None) == want
    assert len(both) == 2 * len(rows(0)) - len(want)


def test_caches_of_pages_are_blocks(spark, tmp_path):
    path = str(tmp_path / "cache")
    of = lambda rows: spark.createDataFrame(rows, "page int, v string")
    read = lambda: sorted(map(tuple, spark.read.schema("v string, page int").parquet(path).select("page", "v").collect()), key=repr)
    writers.cache_pages(of([(p, "a") for p in range(600)] + [(-1, "a"), (None, "a")]), path)
    assert len([d for d in os.listdir(path) if "=" in d]) == 5  # five folders, not one for each of 602 pages
    writers.cache_pages(of([(1, "b"), (1, "c"), (700, "b"), (None, "b")]), path)
    writers.cache_pages(of([]), path)
    writers.drop_pages(spark, path, [*range(512, 600), 2, -1, 9999, 700])
    want = [(p, "a") for p in range(512) if p not in (1, 2)] + [(1, "b"), (1, "c"), (None, "b")]
    assert read() == sorted(want, key=repr) and not [d for d in os.listdir(path) if d.startswith("_new")]


def test_verdict_counts_makes_no_folder_for_each_page(spark, sf):
    top = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(top))
    assert QUERIES["verdict_counts"](spark, sf).count()
    made = [x for d in set(os.listdir(top)) - before for x in os.listdir(f"{top}/{d}") if "=" in x]
    assert made == ["block=0"]


def test_verdict_counts_reads_the_lines_once(spark, sf):
    df = QUERIES["verdict_counts"](spark, sf)
    assert df.count() and not [f for f in df.inputFiles() if "lineitem" in f]  # they are read where what is asked is stored, not once more


def test_verdict_counts_broadcasts_no_cache(spark, sf):
    plan = QUERIES["verdict_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan  # small on disk is not small in memory


def test_apply_decisions_checkpoints_no_readings(spark, sf):
    top = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(top))
    assert QUERIES["apply_decisions"](spark, sf).columns == ["page", "category", "value"]
    assert not [d for d in set(os.listdir(top)) - before if d.startswith("rdd-")]
