import pytest
from compare import agree

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    agree(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_whole_tables_are_batched_and_paired(spark):
    sf = "/root/testdata/sf0.1"  # more than 100 valid pages
    pages, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "benchmark"))
    valid = pages.where("html is not null and trim(html) <> '' and length(html) >= 400").count()
    got = registry.QUERIES["page_batches"](spark, sf)
    assert got.count() == valid > 100 and got.groupBy("batch_no").count().where("count > 16").isEmpty()
    ids = pages.select("page_id").union(items.select("item_id")).distinct().count()
    pairs = registry.QUERIES["capture_pairs_by_id"](spark, sf)
    assert pairs.count() == ids and pairs.where("state <> 'conflict'").count() > 45
