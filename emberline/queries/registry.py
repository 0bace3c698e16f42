"""Name -> query over (spark, sf_dir), and name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Bytes of stored tables for each partition of a shuffle; partitions are joined up to the second size only.
PARTITION, JOINED = 4 << 20, 16 << 20
#: Bytes of rows for each stored byte, about: a table is sent whole by way of the driver if it is small as rows, not as stored.
PACKED = 8.0


def make_room(spark: SparkSession, sf_dir: str) -> None:
    """Has shuffles start with partitions in proportion to the stored tables, so that a task's share stays as it is when they
    grow, and keeps tables from being sent whole that only look small. More partitions already asked for stay."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)
    if _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) > JOINED:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED)
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < PACKED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(PACKED))


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: a number, and k, m, g or t with or without a b, or b."""
    number = size.strip().lower().removesuffix("b")
    unit = number[-1:] if number[-1:] in "kmgt" else ""
    return int(number.removesuffix(unit)) << 10 * " kmgt".index(unit or " ")


def query(name: str, twin: str | None = None):
    """Registers a function of Views; twin is SQL over the canonical views."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            make_room(spark, sf_dir)
            return build(Views(spark, sf_dir))

        QUERIES[name] = run
        if twin is not None:
            ORACLE_SQL[name] = sql(twin)
        return build

    return register
