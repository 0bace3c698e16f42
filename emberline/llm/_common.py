"""Helpers shared by the corpus operators: the shared work folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 spelling of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and the master is local (as in tests) a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; inside scratch() it is removed at the end."""
    path = f"{shared_dir(spark)}/emberline-{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the intermediate tables written inside: for callers that write their result in it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: the lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """many joined to one (few rows a key) on `key`, with no key in one task whatever its share of many's rows.

    A key is hot if it has at least one in 100 000 rows, and 1000 at least: so there are at most 100 000 hot keys, which
    are broadcast. The rows of a hot key are dealt over salts, and its row of `one` is copied to each of them. Up to
    100 000 rows, which one task can hold, are joined as they are. many is read three times and had better be a written
    table. Null keys match nothing.
    """
    total = many.count() if total is None else total
    if total <= 100_000:
        return many.join(one, key, how)
    least = max(1000, total // 100_000)
    hot = many.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    hot = F.broadcast(hot.select("__key", F.expr(f"(__n + {least - 1}) div {least}").alias("__salts")))
    left = many.join(hot, many[key] == hot["__key"], "left")
    dealt = F.pmod(F.xxhash64(*many.columns), F.col("__salts"))
    left = left.withColumn("__salt", F.coalesce(dealt, F.lit(0)).cast("long")).drop("__key", "__salts")
    right = one.join(hot, one[key] == hot["__key"], "left")
    right = right.withColumn("__salt", F.explode(F.expr("sequence(0L, coalesce(__salts, 1L) - 1L)"))).drop("__key", "__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def zipped(df: DataFrame, column: str) -> DataFrame:
    """df with a text column as zstd-compressed bytes, in which texts take half the room in a shuffle; null stays."""
    return _recoded(df, column, T.BinaryType(), zip_=True)


def unzipped(df: DataFrame, column: str) -> DataFrame:
    return _recoded(df, column, T.StringType(), zip_=False)


def _recoded(df: DataFrame, column: str, to: T.DataType, zip_: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, to if f.name == column else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code = zstandard.ZstdCompressor(level=3).compress if zip_ else zstandard.ZstdDecompressor().decompress
        for b in batches:
            at = b.schema.get_field_index(column)
            values = b.column(at).cast(pa.binary()).to_pylist()
            out = pa.array([None if v is None else code(v) for v in values], pa.binary())
            yield b.set_column(at, column, out if zip_ else out.cast(pa.string()))

    return df.mapInArrow(run, schema)


def lower_ascii(col):
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(col, UPPER, LOWER)
