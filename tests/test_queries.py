import pytest

from drawlake.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["coverage", "resolve_answers", "review_queue", "compare_readers", "nms_regions", "nearest_connector"])
def test_no_cartesian_product(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_queries_read_every_reading(spark, sf):
    from drawlake.plans.proxies import frame

    n = frame(spark, sf, "obs").count()
    assert QUERIES["admin_tables"](spark, sf).count() == n
    order = QUERIES["review_order"](spark, sf)
    assert order.count() == n and {r["priority"] for r in order.select("priority").distinct().collect()} == {0, 1, 2, 3, 4}


def test_review_tiles_are_those_of_the_disputes(spark, sf):
    chunked = {(r["page"], r["tile_id"]) for r in QUERIES["dispute_chunks"](spark, sf).collect()}
    tiles = [(r["page"], r["tile_id"]) for r in QUERIES["review_tiles"](spark, sf).collect()]
    assert chunked and chunked <= set(tiles) and len(tiles) == len(set(tiles))
