"""Every registered query of the reference's operators against its SQL twin."""

import pytest

from emberline.queries import load

from .oracle import differences

QUERIES, SQL = load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    assert not differences(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")


def test_upsert_is_idempotent(spark, tmp_path):
    from emberline.streaming.sinks import upsert

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/cp")
    path = f"file://{tmp_path}/out"
    write = upsert(["id", "day"], "v", "day", path)
    one = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 2)], "id int, v int, x string, day int")
    two = spark.createDataFrame([(1, 2, "c", 1)], one.schema)
    for i, b in enumerate((one, two, two)):
        write(b, i)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v", "x", "day").collect()) == [(1, 2, "c", 1), (2, 1, "b", 2)]
