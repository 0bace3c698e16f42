"""PCA whitening of embeddings by a tall-skinny QR factorisation (TSQR).

Each vector becomes integers, floor(scale * c) + shift. The fit list holds each distinct integer vector once. Its
per-dimension sums are exact, so rows are centred without cancellation: by the nearest integer to the mean first, then by
what is left of it. Every partition factors its centred rows batch by batch, keeping R alone; R factors are merged in a
tree of QR factorisations, and the last R is decomposed by SVD. Its right vectors are the principal axes and its singular
values their scales, so that the covariance matrix is never formed. A second pass over the fit list measures how far the
whitened rows' own covariance (k by k) is from the identity.

A task holds one Arrow batch and one d by d factor; a merging task at most `fanout` factors. What comes to the driver is
the model: the sums, and k axes of d doubles.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an entry whose
integer needs more than 62 bits; empty vectors have no component and so give no row; vectors of another length are a
space of their own, with its own fit list and model; repeated rows count once in the fit list and each get their
result; rows without an id are whitened as well; components without variance (a singular value within rounding of zero)
don't exist, so fewer distinct vectors than components give fewer components, and a single one none; a deviation beyond
a long is null; an empty table gives an empty result; columns other than the id and the vector are not carried. The
lengths of all spaces together may be `max_dims` at most, else a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


@dataclass(frozen=True)
class WhitenParams:
    components: int = 16
    scale: float = 64.0
    shift: int = 1_000_000
    #: R factors merged by one task
    fanout: int = 8
    #: dimensions of all vector lengths together, which bounds the model
    max_dims: int = 1_000_000


@dataclass
class Space:
    """What is known of the vectors of one length."""

    n: int
    #: the integer nearest to each mean, and the sums of x - base
    base: np.ndarray
    rest: list[int]
    axes: np.ndarray | None = None
    scales: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        off = x - self.base
        most = self.n * int(np.abs(off).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * max(len(self.rest), 1) < 1 << 63:
            d = self.n * off - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * off.astype(object) - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def quantise(vectors: DataFrame, params: WhitenParams = WhitenParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the integer vectors that take part."""
    scaled = lambda v: F.lit(params.scale) * v.cast("double")
    fine = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(scaled(v)) < float(1 << 62)))
    known = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("__v"), F.coalesce(fine, F.lit(False)).alias("__fine"))
    x = F.transform("__v", lambda v: F.floor(scaled(v)).cast("long") + F.lit(params.shift))
    return known.where("__fine").select("vec_id", x.alias("x"))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each vector length in a batch of integer lists."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, values[starts[rows][:, None] + np.arange(size)].astype(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sums(fit: DataFrame, max_dims: int) -> dict[int, Space]:
    """Count and exact sums of each vector length."""
    each = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "v"))
    rows = each.groupBy("d", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    known = rows.orderBy("d", "at").limit(max_dims + 1).collect()
    if len(known) > max_dims:
        raise ValueError(f"the vectors' lengths add up to more than {max_dims} dimensions")
    by_size: dict[int, list] = {}
    for r in known:
        by_size.setdefault(r["d"], []).append((r["n"], int(r["s"])))
    out = {}
    for d, told in by_size.items():
        n = told[0][0]
        base = [(2 * s + n) // (2 * n) for _, s in told]
        out[d] = Space(n, np.array(base, np.int64), [s - n * b for (_, s), b in zip(told, base)])
    return out


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factors(fit: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """One R factor of the centred rows for each partition and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        have: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(_column(b, "x")):
                if d:
                    y = spaces[d].centred(x)
                    have[d] = _r(np.vstack([have[d], y]) if d in have else y)
        node = TaskContext.get().partitionId()
        for d, r in have.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "node": [node], "r": [r.tobytes()]}, schema=pa.schema([("d", pa.int32()), ("node", pa.int32()), ("r", pa.binary())]))

    return fit.mapInArrow(run, "d int, node int, r binary")


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node")
    d = int(part["d"].iloc[0])
    r = _r(np.vstack([np.frombuffer(b).reshape(-1, d) for b in part["r"]]))
    return pd.DataFrame({"d": [d], "node": part["node"].iloc[:1], "r": [r.tobytes()]})


def _axes(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """SVD of the last factor: axes that hold variance, their singular values, and the share of the whole."""
    last = _merge(part).iloc[0]
    d = int(last["d"])
    r = np.frombuffer(last["r"]).reshape(-1, d)
    _, s, right = np.linalg.svd(r, full_matrices=False)
    total = (s * s).sum()
    held = min(k, int((s > s[0] * d * 16 * np.finfo(float).eps).sum())) if total > 0 else 0
    axes = right[:held]
    if held:  # either sign is an axis; take the one whose largest entry is positive
        axes = axes * np.sign(axes[np.arange(held), np.abs(axes).argmax(axis=1)])[:, None]
    share = s[:held] ** 2 / total if held else s[:0]
    return pd.DataFrame({"d": [d] * held, "k": range(held), "s": s[:held], "explained": share, "axis": pd.Series(list(axes), dtype=object)})


def fit_whitening(x: DataFrame, params: WhitenParams = WhitenParams()) -> dict[int, Space]:
    """The model of each vector length, from a table (vec_id, x) of integer vectors."""
    fit = materialise(x.select("x").distinct(), "whiten-fit")
    spaces = _sums(fit, params.max_dims)
    if not spaces:
        return {}
    factors = _factors(fit, spaces)
    left = max(1, fit.rdd.getNumPartitions())
    while left > params.fanout:
        grouped = factors.withColumn("node", F.expr(f"node div {params.fanout}").cast("int")).groupBy("d", "node")
        factors, left = grouped.applyInPandas(_merge, "d int, node int, r binary"), -(-left // params.fanout)
    k = params.components
    found = factors.groupBy("d").applyInPandas(lambda p: _axes(p, k), "d int, k int, s double, explained double, axis array<double>")
    by_size: dict[int, list] = {}
    for r in found.collect():
        by_size.setdefault(r["d"], []).append(r)
    for d, space in spaces.items():
        told = sorted(by_size.get(d, []), key=lambda r: r["k"])
        space.axes = np.array([r["axis"] for r in told]).reshape(len(told), d).T
        space.scales = np.array([r["s"] for r in told]) / np.sqrt(space.n)
        space.explained = np.array([r["explained"] for r in told])
    for d, error in _identity_errors(fit, spaces).items():
        spaces[d].identity_error = error
    return spaces


def _identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, for each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(_column(b, "x")):
                if d and spaces[d].axes.size:
                    w = spaces[d].whitened(x)
                    have[d] = have.get(d, 0) + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        for d, sums in have.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "sums": [sums.tolist()]}, schema=pa.schema([("d", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    each = fit.mapInArrow(run, "d int, sums array<double>").select("d", F.posexplode("sums").alias("at", "v"))
    by_size: dict[int, list] = {}
    for r in each.groupBy("d", "at").agg(F.sum("v").alias("v")).orderBy("d", "at").collect():
        by_size.setdefault(r["d"], []).append(r["v"])
    out = {}
    for d, told in by_size.items():
        n, k = spaces[d].n, len(spaces[d].scales)
        mean, second = np.array(told[:k]) / n, np.array(told[k:]).reshape(k, k) / n
        out[d] = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whiten(x: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error): a row for each integer vector, arrays by component."""
    fields = [("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _column(b, "vec_id")
            for d, rows, m in _matrices(_column(b, "x")):
                space = spaces.get(d)
                if space is None or not space.axes.size:
                    continue
                w = pa.array(list(space.whitened(m)), fields[2][1])
                told = [space.n] * len(rows), space.deviations(m), w, [space.explained.tolist()] * len(rows), [space.identity_error] * len(rows)
                cols = [pa.array(v, t) if not isinstance(v, pa.Array) else v for v, (_, t) in zip(told, fields)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *cols], ["vec_id", *(f for f, _ in fields)])

    vec_id = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {vec_id}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
