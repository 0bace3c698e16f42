"""The shared joins, with more rows on one key than they join plainly."""

from pyspark.sql import functions as F

from emberline.llm import _components
from emberline.llm._common import salted_join
from emberline.llm._components import components


def test_salted_join_with_a_hot_key(spark):
    many = spark.range(120_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(9_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    want = many.join(one, "k").agg(F.count("*"), F.sum("x"), F.sum("id")).first()
    assert salted_join(many, one, "k").agg(F.count("*"), F.sum("x"), F.sum("id")).first() == want
    left = salted_join(many, one, "k", "left").agg(F.count("*"), F.count("x")).first()
    assert tuple(left) == (120_000, want[0])


def test_hubs_of_components(spark):
    """A star of 60000 nodes, a chain, and nodes between, by the way for very many edges."""
    star = spark.range(1, 60_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    small = _components._with_least(star, 2_000_000)
    assert small.select("u", "v", "m").distinct().count() == 60_000 and small.where("m <> 0").count() == 0
    chain = spark.range(100_000, 100_200).select("id", (F.col("id") + 1).alias("v"))
    got = components(star.union(chain))
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 60_001), (100_000, 201)]
