import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import whitening
from emberline.llm.queries import QUERIES


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=16):
    """n, exact deviations, eigenvalues and components by an eigendecomposition of the covariance."""
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if fine(v)]
    fit = np.array(sorted({x for _, x in xs}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * int(c) - int(t)) / n for c, t in zip(x, s)] for x in fit])
    e, vec = np.linalg.eigh(y.T @ y / n)
    e, vec = e[::-1], vec[:, ::-1]
    out = {}
    for i, x in xs:
        d = [n * int(c) - int(t) for c, t in zip(x, s)]
        w = np.array([c / n for c in d]) @ vec[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((sum(c * c for c in d), w))
    return n, out, e / e.sum()


def check(got, rows, tolerance=1e-6):
    n, want, share = brute(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by_id) == set(want)
    sign = {}
    for i, parts in by_id.items():
        for c, rs in parts.items():
            assert len(rs) == len(want[i])
            for r, (deviation, w) in zip(rs, want[i]):
                assert (r.n, r.deviation) == (n, deviation)
                assert abs(r.explained / share[c - 1] - 1) < 1e-6 and r.identity_error < 1e-8
                if abs(w[c - 1]) > 1e-3:
                    sign.setdefault(c, math.copysign(1, r.whitened * w[c - 1]))
                    assert abs(r.whitened * sign[c] - w[c - 1]) < tolerance * max(1, abs(w[c - 1]))


def test_whole_table_against_eigenvectors(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert len(got) == 16 * len(rows)
    check(got, rows)


def run(spark, rows, **params):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string").repartition(20)
    x = whitening.quantise(df)
    return whitening.whiten(x, whitening.fit_whitening(x, whitening.WhitenParams(**params)))


def flat(df):
    return df.select("vec_id", "n", "deviation", "identity_error", F.posexplode("whitened").alias("at", "whitened"), "explained").select(
        "*", (F.col("at") + 1).alias("component"), F.expr("explained[at]").alias("explained_")
    ).drop("explained").withColumnRenamed("explained_", "explained").collect()


def test_tree_of_factors_repeated_rows_and_bad_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(m, 0.2 * (m + 1)) for m in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(None, rows[4][1])]
    bad = [(1, None), (2, [None] * 6), (3, [float("nan")] * 6), (4, [float("-inf")] + [0.0] * 5), (5, [3e38] * 6)]
    check(flat(run(spark, rows + bad, fanout=2)), [(i, np.float32(v).astype(float).tolist()) for i, v in rows])


def test_lengths_are_spaces_of_their_own(spark):
    rng = random.Random(6)
    two, three = ([(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(100 * d, 100 * d + 60)] for d in (2, 3))
    got = flat(run(spark, two + three + [(9, []), (10, [1.0])]))
    for part in (two, three):
        ids = {i for i, _ in part}
        check([r for r in got if r.vec_id in ids], [(i, np.float32(v).astype(float).tolist()) for i, v in part])
    assert {r.vec_id for r in got} == {i for i, _ in two + three}  # no variance in an empty or a single vector


def test_no_variance_in_a_dimension(spark):
    rows = [(i, [float(i % 7), 2.0, float(i % 7)]) for i in range(50)]
    got = run(spark, rows).collect()
    assert {len(r.whitened) for r in got} == {1} and {r.n for r in got} == {7}
    assert abs(got[0].explained[0] - 1) < 1e-12


def test_deviation_beyond_a_long(spark):
    got = {r.vec_id: r.deviation for r in run(spark, [(0, [2.0**50]), (1, [0.0]), (2, [1.0])]).collect()}
    assert got == {0: None, 1: None, 2: None}
    got = {r.vec_id: r.deviation for r in run(spark, [(0, [2.0**22]), (1, [0.0])]).collect()}
    assert got == {0: (64 * 2**22) ** 2, 1: (64 * 2**22) ** 2}


def test_empty(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(1, None), (2, [])]).collect() == []


def test_bound_of_the_model(spark):
    with pytest.raises(ValueError, match="dimensions"):
        run(spark, [(1, [1.0, 2.0, 3.0])], max_dims=2)
