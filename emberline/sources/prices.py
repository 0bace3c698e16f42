"""Daily price history in CSV files, compressed or not, whose header is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {"date": "date", "region_id": "int", "type_id": "int", "average": "double", "highest": "double", "lowest": "double", "volume": "long", "order_count": "int"}


#: columns of a file that are looked at
WIDTH = 64


def price_history(spark: SparkSession, path: str, skip_bad_files: bool = False) -> DataFrame:
    """The rows below path, each file read by its own header, whatever the order of its columns.

    A file whose header lacks a column of COLUMNS fails the read, or is left out with skip_bad_files (bad_files tells
    which those are). Other columns are ignored; rows that don't parse are left out, as are rows without a date or a type.
    """
    rows, heads = _by_file(spark, path)
    bad = bad_files(spark, path)
    if not skip_bad_files:
        named = [f"{r['file']} has no {', '.join(r['missing'])}" for r in bad.limit(10).collect()]
        if named:
            raise ValueError("; ".join(named))
    fine = heads.where(F.size("missing") == 0).select("file", "head")
    at = lambda c: F.get("v", F.array_position("head", c).cast("int") - 1).try_cast(COLUMNS[c])
    out = rows.where(~F.col("is_head")).join(fine, "file").select(*[at(c).alias(c) for c in COLUMNS])
    return out.where("date is not null and type_id is not null")


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, missing): the files below path that can't be read, and the columns their headers lack."""
    rows, heads = _by_file(spark, path)
    told = rows.select("file").distinct().join(heads, "file", "left")
    return told.select("file", F.coalesce("missing", F.array(*map(F.lit, COLUMNS))).alias("missing")).where(F.size("missing") > 0)


def _by_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All lines as (file, v, is_head), and (file, head, missing): a header is a line that names two columns at least."""
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    lines = spark.read.schema(schema).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = F.array(*map(F.lit, COLUMNS))
    v = F.array(*[f"c{i}" for i in range(WIDTH)])
    rows = lines.select(F.col("_metadata.file_path").alias("file"), v.alias("v"))
    rows = rows.withColumn("is_head", F.size(F.array_intersect("v", names)) >= 2)
    heads = rows.where("is_head").groupBy("file").agg(F.first("v").alias("head"))
    return rows, heads.withColumn("missing", F.filter(names, lambda c: F.array_position("head", c) == 0))


def days_to_load(manifest: DataFrame, loaded: DataFrame, recheck_from: str | None = None) -> DataFrame:
    """(day, reason): days of manifest (day, n) that are missing in loaded (day, n), hold fewer rows, or are to be checked again."""
    both = manifest.select("day", F.col("n").alias("__want")).join(loaded.select("day", F.col("n").alias("__have")), "day", "left")
    reason = F.when(F.col("__have").isNull(), "missing").when(F.col("__have") < F.col("__want"), "short")
    if recheck_from:
        reason = reason.when(F.col("day") >= F.lit(recheck_from).cast("date"), "recheck")
    return both.withColumn("reason", reason).where("reason is not null").select("day", "reason")
