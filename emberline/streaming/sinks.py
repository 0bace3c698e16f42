"""Micro-batch sinks and event-time sessions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import first_per_group
from ..operators.temporal import sessions


def closed_sessions(stream: DataFrame, keys: Sequence[str], at: str, gap: str, lateness: str = "48 hours", *aggs: Column) -> DataFrame:
    """Sessions of a stream, emitted once when the watermark has passed them; the lateness is the publication lock."""
    return sessions(stream.withWatermark(at, lateness), keys, at, gap, *aggs)


def upsert(keys: Sequence[str], version: str, partition: str, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: replaces rows of equal key in the partitions that a batch touches, newest version last.

    Replaying a batch changes nothing. Each batch reads and rewrites only its own partitions; keys include the partition.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, fresh = batch.sparkSession, batch
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            touched = batch.select(partition).distinct()
            old = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi")
            fresh = batch.unionByName(old)
        kept = first_per_group(fresh, keys, F.desc(version)).checkpoint()
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return write


def replace_window(path: str, partition: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch holds whole windows (values of the partition column), each of which replaces what is
    stored of it; other windows stay. Replaying a batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return write


def relay(projectors: Mapping[str, Callable[[DataFrame], None]], dead_letters: Callable[[DataFrame], None], kind: str = "kind", attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: hands the rows of every kind to its projector, which must bear to see rows twice.

    A projector that fails is tried again; the rows of one that keeps failing, and those of a kind without one, go to
    dead_letters with a reason, and the other kinds are delivered all the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        failed = {}
        for name, project in projectors.items():
            for _ in range(attempts):
                try:
                    project(batch.where(F.col(kind) == name))
                    failed.pop(name, None)
                    break
                except Exception as e:  # whatever a projector raises is told in the dead letters
                    failed[name] = str(e)[:500]
        for name, reason in failed.items():
            dead_letters(batch.where(F.col(kind) == name).withColumn("reason", F.lit(reason)))
        dead_letters(batch.where(F.col(kind).isNull() | ~F.col(kind).isin(*projectors)).withColumn("reason", F.lit("no projector")))

    return write
