import os

import pytest

from emberline.queries import load, registry
from emberline.schema import Views

load()


@pytest.mark.parametrize("size, n", [("64MB", 64 << 20), ("8m", 8 << 20), ("16k", 16384), ("123", 123), ("1gb", 1 << 30), ("67108864b", 64 << 20)])
def test_sizes(size, n):
    assert registry._bytes(size) == n


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    named = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    monkeypatch.setattr(registry, "PARTITION", 10_000)
    try:
        out = registry.QUERIES["g19_allegiance"](spark, "/root/testdata/sf0.001")
        asked = int(spark.conf.get(named[0]))
        assert asked > 50
        assert "hashpartitioning(event_id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {asked})" in plan
    finally:
        for n in named:
            spark.conf.unset(n)


def test_a_table_that_is_small_as_stored_only_is_not_sent_whole(spark):
    """Packed a few bytes a row, parts were sent whole by way of the driver at 6 and 60 times sf0.1 (F9)."""
    named = "spark.sql.sources.fileCompressionFactor"
    try:
        registry.make_room(spark, "/root/testdata/sf0.1")
        types = Views(spark, "/root/testdata/sf0.1").types
        stored = int(types._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        assert stored > 4 * os.path.getsize("/root/testdata/sf0.1/part.parquet")
    finally:
        spark.conf.unset(named)
