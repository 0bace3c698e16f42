"""Exact top-k inner-product search with a bit-sliced index.

Vectors are quantised to integers, floor(scale * x). The index holds, for a block of vectors, one bitmap per attribute
and bit: bit i of slice b of attribute d tells whether bit b of row i's value is set (values are stored above the block's
minimum). A query adds, by carry-save adders over whole bitmaps, the slices of every attribute shifted by the bits of
the query's value; the sum's slices are the scores of all rows of the block at once. The top rows are then selected from
the most significant slice downward, and the rows tied at the boundary are resolved by vector id. Blocks report their k
best per query, from which the k best of all are taken.

Query blocks meet index blocks pair by pair; neither side is broadcast, and a task holds one of each.

Defined cases: vectors that are null or hold null or non-finite components take no part, and so do rows without an id;
empty vectors score 0 with one another; components beyond 2^61 once quantised count as 2^61, and scores that don't fit a
long as the nearest long; only vectors of the same length meet; rows equal in id and
vector count once, and a query's own rows are all those with its id; with fewer than k other rows all are returned; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: float = 64.0
    #: vectors in an index block and queries in a query block, on average
    block_rows: int = 60_000
    query_rows: int = 60_000
    #: pairs of blocks to make at least, so that a small table still uses the cluster
    min_pairs: int = 12


def quantise(vectors: DataFrame, params: TopKParams, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): the integer vectors that take part."""
    most = float(1 << 61)
    scaled = lambda v: F.lit(params.scale) * v.cast("double")
    q = F.transform(F.col(vec_col), lambda v: F.floor(F.greatest(F.least(scaled(v), F.lit(most)), F.lit(-most))).cast("long"))
    fine = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    ok = F.col(vec_col).isNotNull() & fine & F.col(id_col).isNotNull()
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


class SlicedBlock:
    """The bit slices of a block of integer vectors, rows in order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order].astype(np.int64)
        self.n = len(self.ids)
        self.words = (self.n + 63) // 64
        self.low = values.min(axis=0)
        above = values - self.low
        self.bits = [int(x).bit_length() for x in above.max(axis=0)]
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(int)
        self.valid = self._pack(np.ones(self.n, np.uint8))
        slices = [self._pack(((above[:, d] >> b) & 1).astype(np.uint8)) for d, n in enumerate(self.bits) for b in range(n)]
        both = slices + [~s & self.valid for s in slices]
        # slices first, their complements after them
        self.slices = np.array(both, np.uint64).reshape(len(both), self.words)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.n] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum, least significant first, and the constant to add to it."""
        at: list[list[int]] = []
        constant, half = 0, len(self.slices) // 2
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            low, n = int(self.low[d]), self.bits[d]
            # a negative factor adds the complement: -u = (2^n - 1 - u) - (2^n - 1)
            constant += q * low if q > 0 else q * (low + (1 << n) - 1)
            start, left, shift = int(self.first[d]) + (0 if q > 0 else half), abs(q), 0
            while left:
                if left & 1:
                    while len(at) < shift + n:
                        at.append([])
                    for b in range(n):
                        at[shift + b].append(start + b)
                left >>= 1
                shift += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        p = 0
        while p < len(at) or carried:
            parts = ([self.slices[at[p]]] if p < len(at) and at[p] else []) + carried
            carried = []
            rows = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, self.words), np.uint64)
            while len(rows) > 2:
                m = len(rows) // 3
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                x ^= c
                rows = np.concatenate([x, rows[3 * m :]]) if len(rows) > 3 * m else x
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0])
            p += 1
        return out, constant

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, the smaller id first among the tied at the boundary; in no order."""
        sums, constant = self.scores(query)
        open_rows = self.valid.copy()
        for i in range(*np.searchsorted(self.ids, [own_id, own_id + 1])):
            open_rows[i >> 6] &= ~np.uint64(1 << (i & 63))
        sure = np.zeros(self.words, np.uint64)
        left = k
        if int(np.bitwise_count(open_rows).sum()) <= k:
            sure, open_rows, left = open_rows, sure, 0
        for s in reversed(sums):
            if not left:
                break
            ones = open_rows & s
            n = int(np.bitwise_count(ones).sum())
            if n > left:
                open_rows = ones
            else:
                sure = sure | ones
                open_rows = open_rows & ~s
                left -= n
        rows = self._rows(sure)
        if left:
            rows = np.concatenate([rows, self._rows(open_rows)[:left]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        wide = len(sums) > 61 or abs(constant) >> 61
        score = np.full(len(rows), constant, object if wide else np.int64)
        for p, s in enumerate(sums):
            ones = ((s[word] >> bit) & np.uint64(1)).astype(np.int64)
            score += ones.astype(object) * (1 << p) if wide else ones << p
        if wide:
            score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], np.int64)
        return self.ids[rows], score

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(vectors: DataFrame, queries: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors and queries: (vec_id, q), as quantise gives them."""
    vectors, queries = vectors.distinct(), queries.distinct()
    n, m = vectors.count(), queries.count()
    index_blocks = max(1, -(-n // params.block_rows))
    query_blocks = max(1, -(-m // params.query_rows), -(-params.min_pairs // index_blocks))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id", "q"), F.lit(count)).cast("int")
    left = vectors.select(
        dealt(index_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "vec_id", "q"
    ).withColumn("dim", F.size("q"))
    right = queries.select(
        dealt(query_blocks).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("block"), "vec_id", "q"
    ).withColumn("dim", F.size("q"))
    k = params.k

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asked):
            block = SlicedBlock(index["vec_id"].to_numpy(np.int64), np.array(index["q"].tolist(), np.int64).reshape(len(index), -1))
            for number, (own, q) in enumerate(zip(asked["vec_id"], asked["q"])):
                ids, scores = block.top(np.asarray(q, np.int64), int(own), k)
                out.append(pd.DataFrame({"query_id": int(own), "q": [np.asarray(q, np.int64).tobytes()] * len(ids), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})

    keys = ["block", "part", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, q binary, vec_id long, score long"
    )
    # rows of one id and different vectors compete as one candidate row each
    best = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
