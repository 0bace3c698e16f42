"""Property-graph operators over edge lists (a, b[, w]): degrees, PageRank, breadth-first hops, catchments, triangles.

Iterations are bounded joins; each writes its frontier through checkpoint(), so plans stay short and executors can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as two directed ones."""
    turned = [F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns]
    return edges.select(F.explode(F.array(F.struct(*edges.columns), F.struct(*turned))).alias("e")).select("e.*")  # read once


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def _folder(df: DataFrame) -> str:
    """The checkpoint folder, set if it isn't yet."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not folder:
            import tempfile

            folder = f"file://{tempfile.mkdtemp()}"  # a session on a single machine
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written once, as Parquet in the checkpoint folder: packed, and a reader takes the columns it needs alone."""
    path = f"{_folder(df)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """Weighted PageRank of an undirected graph with the un-normalised base 1 - d."""
    arcs = cut(both_ways(edges))
    out = arcs.groupBy("a").agg(F.sum("w").alias("total"))
    arcs = cut(arcs.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")))
    rank = out.select(F.col("a").alias("id"), F.lit(1.0 - damping).alias("rank"))
    for i in range(iterations):
        sent = arcs.join(rank, F.col("a") == F.col("id")).groupBy("b").agg(F.sum(F.col("p") * F.col("rank")).alias("s"))
        rank = sent.select(F.col("b").alias("id"), (F.lit(1.0 - damping) + damping * F.col("s")).alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank


def pageranks(edges: DataFrame, graph: Sequence[str], iterations: int = 20, damping: float = 0.85, local_edges: int = 1_000_000) -> DataFrame:
    """(graph..., id, degree, rank) of many graphs, edges (graph..., a, b, w) of longs, each as by degrees() and pagerank().

    Graphs of at most local_edges edges are worked through in a task each, so their edges cross once; larger ones by joins.
    """
    graph = list(graph)
    sizes = edges.groupBy(*graph).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > local_edges).select(*graph))
    some = not large.isEmpty()
    names = [*graph, "id", "degree", "rank"]

    def one(key: tuple, part: pa.Table) -> pa.Table:
        ends, w = [np.concatenate([part[x].to_numpy(), part[y].to_numpy()]) for x, y in ("ab", "ba")], np.tile(part["w"].to_numpy(), 2)
        ids, a = np.unique(ends[0], return_inverse=True)
        b, degree = np.searchsorted(ids, ends[1]), np.bincount(a, w)
        p, rank = w / degree[a], np.full(len(ids), 1.0 - damping)
        for _ in range(iterations):
            rank = 1.0 - damping + damping * np.bincount(b, p * rank[a], len(ids))
        return pa.table([*(pa.repeat(k, len(ids)) for k in key), pa.array(ids), pa.array(degree), pa.array(rank)], names=names)

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in graph)
    rest = edges.join(F.broadcast(large), graph, "left_anti") if some else edges
    out = rest.select(*graph, "a", "b", "w").groupBy(*graph).applyInArrow(one, f"{kinds}, id long, degree double, rank double")
    if not some:
        return out
    node = lambda c: F.struct(*graph, F.col(c).alias("id"))
    wide = cut(edges.join(F.broadcast(large), graph, "left_semi").select(node("a").alias("a"), node("b").alias("b"), "w"))
    ranked = pagerank(wide, iterations, damping).join(degrees(wide).select("id", F.col("strength").alias("degree")), "id")
    return out.unionByName(ranked.select("id.*", "degree", "rank"))


def hops(edges: DataFrame, seeds: Sequence[int], most: int) -> DataFrame:
    """(id, hops) of every node within `most` undirected steps of a seed."""
    seen = edges.sparkSession.createDataFrame([(int(s), 0) for s in seeds], "id long, hops int")
    return _spread(edges, seen, most, "hops")


def _spread(edges: DataFrame, seen: DataFrame, most: int, depth: str) -> DataFrame:
    arcs, front = cut(both_ways(edges.select("a", "b")).distinct()), seen  # or every step would work out the edges anew
    for step in range(1, most + 1):
        front = cut(
            arcs.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
            .join(seen, "id", "left_anti").withColumn(depth, F.lit(step))
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """One row (hops, path): a shortest path, of equals the one whose nodes are smallest from the end backwards; none if out of reach."""
    arcs = cut(both_ways(edges.select("a", "b")).distinct())
    front = edges.sparkSession.createDataFrame([(int(start), [int(start)])], "id long, path array<long>")
    seen = front
    for _ in range(most):
        if not seen.where(F.col("id") == end).isEmpty():
            break
        step = arcs.join(front.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min_by("path", "a").alias("path"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where(F.col("id") == end).select((F.size("path") - 1).alias("hops"), "path")


def catchments(edges: DataFrame, hubs: DataFrame, most: int = 30) -> DataFrame:
    """(id, hub, jumps): the nearest hub of each node within reach; ties go to the smaller hub."""
    arcs = cut(both_ways(edges.select("a", "b")).distinct())
    seen = hubs.select("id", F.col("id").alias("hub"), F.lit(0).alias("jumps"))
    front = seen
    for step in range(1, most + 1):
        reached = arcs.join(front.select(F.col("id").alias("a"), "hub"), "a").groupBy(F.col("b").alias("id")).agg(F.min("hub").alias("hub"))
        front = cut(reached.join(seen, "id", "left_anti").withColumn("jumps", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): edges point from the endpoint of lower degree, which bounds every fan-out by the square root of the edges."""
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    deg = both_ways(plain).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    e = plain.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    e = e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = e.join(e.select("u", F.col("v").alias("x")), "u").where("v <> x")
    close = wedge.join(e.select(F.col("u").alias("v"), F.col("v").alias("x")), ["v", "x"])
    return close.select(F.explode(F.array("u", "v", "x")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


#: Neighbours in a row, nodes of a slab, arcs of a part of one, and sums that a task holds at once, about.
_NEAR, _NODES, _ARCS, _SUMS = 1000, 2000, 200_000, 4_000_000


class _Slabs:
    """The neighbours of all nodes, by slabs of nodes with neighbouring ids, and sums over them.

    Ids given in order keep the parts of a graph together, so the sums of a slab are over few nodes, however many slabs
    there are. A slab with many arcs is dealt over parts by its nodes.
    """

    def __init__(self, arcs: DataFrame):
        near = cut(arcs.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("near")))
        self.nodes = near.select("id")
        steps = -(-near.count() // _NODES)
        at = [i / steps for i in range(1, steps)]
        self.bounds = sorted(set(near.agg(F.percentile_approx("id", at, 10 * steps)).first()[0])) if at else []
        sizes = near.groupBy(self._slab().alias("slab")).agg(F.sum(F.size("near")).alias("n")).collect()
        sizes = {r.slab: r.n for r in sizes}
        self.parts = [-(-sizes.get(i, 1) // _ARCS) for i in range(len(self.bounds) + 1)]
        pieces = F.expr(f"transform(sequence(0, (size(near) - 1) div {_NEAR}), i -> slice(near, i * {_NEAR} + 1, {_NEAR}))")
        none = lambda kind: F.lit(None).cast(kind)
        self.near = near.select(self._key(), none("long").alias("source"), "id", none("double").alias("x"), F.explode(pieces).alias("near"))

    def _slab(self):
        return F.size(F.filter(F.array(*map(F.lit, self.bounds)), lambda b: b < F.col("id"))) if self.bounds else F.lit(0)

    def _key(self):
        first = [sum(self.parts[:i]) for i in range(len(self.parts))]
        of = lambda numbers: F.get(F.array(*map(F.lit, numbers)), self._slab())
        return (of(first) + F.pmod(F.xxhash64("id"), of(self.parts))).alias("key")

    def sent(self, rows: DataFrame) -> DataFrame:
        """(source, id, x): for each source, the sum of the x > 0 of a node's neighbours. rows: source, id, x."""
        rows = rows.select(self._key(), "source", "id", "x", F.lit(None).cast("array<long>").alias("near"))
        met = self.near.unionByName(rows).repartition(sum(self.parts), "key")
        met = met.sortWithinPartitions("key", F.col("source").asc_nulls_first())
        return met.mapInArrow(_sums, "source long, id long, x double").groupBy("source", "id").agg(F.sum("x").alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a key come first and are held, its rows then pass by source, a batch at a time."""
    key, held, index = None, [], None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        arc = np.asarray(batch.column("source").is_null())
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(arc.astype("int8")) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if lo == hi:
                continue
            if keys[lo] != key:
                key, held, index = keys[lo], [], None
            part = batch.slice(lo, hi - lo)
            if arc[lo]:
                near = part.column("near")
                held.append((part.column("id").to_numpy(), np.diff(near.offsets.to_numpy()), near.flatten().to_numpy()))
                continue
            if index is None:
                index, held = _indexed(*map(np.concatenate, zip(*held))), []
            for source, id_, x in _products(index, *(part.column(c).to_numpy() for c in ("source", "id", "x"))):
                yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(id_), pa.array(x)], names=["source", "id", "x"])


def _indexed(ids: np.ndarray, sizes: np.ndarray, near: np.ndarray) -> tuple:
    """(nodes, where each one's neighbours start, how many they are, places of the neighbours in the last, distinct neighbours)"""
    known, to = np.unique(near, return_inverse=True)
    owner = np.repeat(ids, sizes)
    order = np.argsort(owner, kind="stable")
    nodes, start, n = np.unique(owner[order], return_index=True, return_counts=True)
    return nodes, start, n, to[order], known


def _products(index: tuple, source: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    nodes, start, n, to, known = index
    at = np.searchsorted(nodes, ids)
    sources, row = np.unique(source, return_inverse=True)
    wide = max(1, _SUMS // len(known))
    for first in range(0, len(sources), wide):
        lo, hi = np.searchsorted(row, [first, first + wide])  # rows come by source
        sums = np.zeros(min(wide, len(sources) - first) * len(known))
        steps = np.cumsum(n[at[lo:hi]]) // _SUMS
        for step in np.unique(steps):
            a, b = lo + np.searchsorted(steps, [step, step + 1])
            m = n[at[a:b]]
            arcs = np.repeat(start[at[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            sums += np.bincount(np.repeat((row[a:b] - first) * len(known), m) + to[arcs], np.repeat(x[a:b], m), len(sums))
        hit = np.flatnonzero(sums)
        yield sources[first + hit // len(known)], known[hit % len(known)], sums[hit]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with the least node that these edges lead to, where that is another."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        for ends in (x, y, least[x], least[y]):
            np.minimum.at(least, ends, low)
        least = least[least]
    least = least[least]
    moved = np.flatnonzero(least != np.arange(len(ids)))
    return ids[moved], ids[least[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As few edges as join what those of a task join."""
    held, n, known = [], 0, 0
    merged = lambda: _stars(*map(np.concatenate, zip(*held)))
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += len(batch)
        if n > _ARCS + 2 * known:
            held = [merged()]
            n = known = len(held[0][0])
    if held:
        a, b = merged()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def parts(edges: DataFrame) -> DataFrame:
    """(id, part): the least node that a node reaches. Edges of neighbouring ids are joined in tasks first; what is left of
    them, about an edge a node, is walked."""
    near = edges.select("a", "b").where("a <> b").repartitionByRange("a").mapInArrow(_forest, "a long, b long")
    arcs = cut(both_ways(near).distinct())
    found = cut(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("part")))
    while True:
        met = arcs.join(found.select(F.col("id").alias("b"), "part"), "b").select(F.col("a").alias("id"), "part")
        now = found.unionByName(met).groupBy("id").agg(F.min("part").alias("part"))
        jump = found.select(F.col("id").alias("part"), F.col("part").alias("further"))
        now = cut(now.join(jump, "part", "left").select("id", F.least("part", "further").alias("part")))
        if now.join(found, ["id", "part"], "left_anti").isEmpty():
            return now
        found = now


#: Nodes of a part that a task holds as a matrix.
_DENSE = 2000


def _by_matrix(part: pa.Table) -> pa.Table:
    """betweenness() of a part, its levels as products of matrices, some sources at a time."""
    ids, at = np.unique(np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()]), return_inverse=True)
    n, half = len(ids), len(at) // 2
    near = np.zeros((n, n))
    near[at[:half], at[half:]] = near[at[half:], at[:half]] = 1.0
    total, wide = np.zeros(n), max(1, _SUMS // 4 // n)
    for lo in range(0, n, wide):
        front = np.eye(n)[lo : lo + wide]
        paths, depth, level = front.copy(), np.where(front > 0, 0, -1), 0
        while True:
            front = np.where(depth < 0, front @ near, 0.0)
            if not front.any():
                break
            level += 1
            paths += front
            depth[front > 0] = level
        owed = np.zeros_like(paths)
        for d in range(level, 1, -1):
            passed = np.divide(1 + owed, paths, out=np.zeros_like(paths), where=depth == d) @ near
            owed += np.where(depth == d - 1, paths * passed, 0.0)
        total += owed.sum(0)
    return pa.table([pa.array(ids), pa.array(total / 2)], names=["id", "betweenness"])


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 42) -> DataFrame:
    """(id, betweenness): shortest paths between other nodes that lead by a node, each pair of ends counted once.

    All nodes are sources, unless a number is asked for: then those first by md5 of "id:seed" are, and the sums are over
    their paths alone, half of each as if the other end were a source too. Ids are longs. A part of the graph of up to
    _DENSE nodes is worked through in a task of its own; larger ones, and sources that were asked for, slab by slab.
    """
    edges = kept(edges.select("a", "b").where("a <> b"))
    if sources is not None:
        return _by_slabs(edges, sources, seed)
    known = parts(edges)
    large = cut(known.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _DENSE).select("part"))
    told = edges.join(known.select(F.col("id").alias("a"), "part"), "a")
    some = not large.isEmpty()
    small = told.join(large, "part", "left_anti") if some else told
    out = small.groupBy("part").applyInArrow(_by_matrix, "id long, betweenness double")
    return out.unionByName(_by_slabs(told.join(large, "part", "left_semi"), None, seed)) if some else out


def _by_slabs(edges: DataFrame, sources: int | None, seed: int) -> DataFrame:
    """Path counts spread forward from all sources at once, a level a step, and dependencies flow back level by level.

    A level is sources x nodes rows at most; a step adds up its arcs slab by slab, so what is sent is a row per source,
    reached node and slab next to it, not per arc. Neighbours of a level lie in it or beside it: only two levels are
    looked up to find new nodes.
    """
    slabs = _Slabs(both_ways(edges.select("a", "b").where("a <> b")))
    chosen = slabs.nodes.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(sources) if sources is not None else slabs.nodes
    levels = [cut(chosen.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))]
    while not levels[-1].isEmpty():
        found = slabs.sent(levels[-1].withColumnRenamed("paths", "x")).withColumnRenamed("x", "paths")
        for old in levels[-2:]:
            found = found.join(old.select("source", "id"), ["source", "id"], "left_anti")
        levels.append(cut(found))
    levels.pop()
    total = slabs.nodes.withColumn("owed", F.lit(0.0))
    owed = levels[-1].withColumn("owed", F.lit(0.0)) if levels else None
    for level in levels[-2:0:-1]:
        passed = slabs.sent(owed.select("source", "id", ((1 + F.col("owed")) / F.col("paths")).alias("x")))
        owed = cut(level.join(passed, ["source", "id"], "left").withColumn("owed", F.coalesce(F.col("paths") * F.col("x"), F.lit(0.0))).drop("x"))
        total = total.unionByName(owed.select("id", "owed"))
    return total.groupBy("id").agg((F.sum("owed") / 2).alias("betweenness"))
