"""Compares registered queries with their SQL twins, as multisets of rows over columns in order of name."""

import sys
import time
from decimal import Decimal

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6)
    return list(map(plain, x)) if isinstance(x, list) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(spark, build, sql, sf_dir):
    df = build(spark, sf_dir)
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    twin = db.sql(sql)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(twin.columns, twin.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    a, b = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
    return "" if ours[1] == theirs[1] else f"{len(ours[1])} and {len(theirs[1])} rows; {len(a)} only here: {sorted(a)[:3]}; {len(b)} only there: {sorted(b)[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as E

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    sql = E.oracle_sql()
    for name, q in E.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        at = time.time()
        try:
            if name in sql:
                said = differences(spark, q, sql[name], sf) or "same"
            else:
                said = f"{q(spark, sf).count()} rows, no twin"
        except Exception as e:
            said = "failed: " + str(e)[:600]
        print(f"{name}: {said} ({time.time() - at:.1f} s)", flush=True)
