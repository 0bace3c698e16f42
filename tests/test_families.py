"""Merging families, against the rule carried out pair by pair."""

import random
import time

from pyspark.sql import functions as F

from emberline.operators import families as M


def plain(sets, counts, least):
    """Compares all pairs in order from the start after each merge."""
    live = [[i, set(s), n, {i}] for i, (s, n) in enumerate(zip(sets, counts))]

    def first():
        for x in range(len(live)):
            for y in range(x + 1, len(live)):
                a, b = live[x][1], live[y][1]
                if (1.0 if not a | b else len(a & b) / len(a | b)) >= least:
                    return x, y
        return None

    while (pair := first()) is not None:
        x, y = pair
        big, small = (x, y) if live[x][2] >= live[y][2] else (y, x)
        live[big] = [live[big][0], live[big][1] | live[small][1], live[big][2] + live[small][2], live[big][3] | live[small][3]]
        del live[small]
    return {i: name for name, _, _, members in live for i in members}


def test_merge_against_the_rule():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(12)
        sets = [set(rng.sample(range(8), rng.randrange(7))) for _ in range(n)]
        counts = [rng.randrange(1, 5) for _ in range(n)]
        for least in (0.4, M.ALIKE):
            assert dict(enumerate(M.merge(sets, counts, least))) == plain(sets, counts, least)


def test_a_chain_of_merges_on_spark(spark):
    rows = [("h", "r", "a", [1, 2, 3], 5, 10, 20), ("h", "r", "b", [1, 2, 3, 4], 2, 5, 9), ("h", "r", "c", [3, 4, 5, 6], 9, 1, 2), ("h", None, "a", [1], 1, 1, 1), ("g", "r", "a", [1, 2, 3], 1, 3, 4), ("g", "r", "e", [], 1, 5, 6), ("g", "r", "f", [], 1, 4, 8)]
    df = spark.createDataFrame(rows, "hull string, role string, fingerprint string, modules array<int>, fits int, first_at int, last_at int")
    got = {(r.hull, r.role, r.fingerprint): (r.modules, r.fits, r.merged, r.first_at, r.last_at) for r in M.merged_families(df).collect()}
    assert got == {("h", "r", "a"): ([1, 2, 3, 4], 7, 2, 5, 20), ("h", "r", "c"): ([3, 4, 5, 6], 9, 1, 1, 2), ("h", None, "a"): ([1], 1, 1, 1, 1), ("g", "r", "a"): ([1, 2, 3], 1, 1, 3, 4), ("g", "r", "f"): ([], 2, 2, 4, 8)}


def test_many_sets_of_few_modules_are_not_compared_one_by_one():
    rng = random.Random(5)
    sets = list({frozenset(rng.sample(range(25), rng.randrange(1, 7))) for _ in range(7000)})
    began = time.process_time()
    ends = M.merge(sets, [1 + i % 7 for i in range(len(sets))])
    assert time.process_time() - began < 8
    assert all(ends[e] == e for e in ends) and len(set(ends)) < len(sets)


def test_more_modules_than_a_word_has_bits():
    rng = random.Random(6)
    for _ in range(20):
        sets = [set(rng.sample(range(70), rng.randrange(60, 70))) if i % 3 else set(rng.sample(range(200), 4)) for i in range(14)]
        counts = [rng.randrange(1, 5) for _ in sets]
        assert dict(enumerate(M.merge(sets, counts, 0.85))) == plain(sets, counts, 0.85)


def test_families_are_read_once(spark):
    df = spark.range(40).select(
        (F.col("id") % 2).alias("hull"), F.lit("r").alias("role"), F.col("id").cast("string").alias("fingerprint"), F.array("id").alias("modules"),
        F.lit(1).alias("fits"), F.timestamp_seconds("id").alias("first_at"), F.timestamp_seconds("id").alias("last_at"),
    )
    out = M.merged_families(df)
    assert out.count() == 40
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
