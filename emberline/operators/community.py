"""Communities of weighted graphs, many graphs (battles) at once, and the sub-fleets made from them.

Louvain's method: nodes move to the neighbouring community with the largest gain of modularity until none does, then
communities become nodes, and so on. Graphs of at most `local_edges` edges are grouped and worked through one node after
another in a task each. Larger ones are first made smaller where they lie: in rounds over all their edges, every node
sees its best move by joins and groupings, and half of the nodes (by hash, another half each round) make it; then edges
between communities are added up. Both count the same gain, so only the order of moves differs.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


@dataclass(frozen=True)
class LouvainParams:
    #: passes over the nodes of a level, and the least gain of modularity that goes on
    iterations: int = 10
    tolerance: float = 1e-4
    #: edges of a graph that one task holds
    local_edges: int = 1_000_000
    #: rounds of joint moves before a large graph is contracted, and contractions at most
    rounds: int = 8
    levels: int = 10


def modularity(edges: pd.DataFrame, community: dict) -> float:
    """Modularity of a partition of an undirected graph (a, b, w); an edge from a node to itself counts once."""
    total = edges["w"].sum()
    inside, strength = {}, {}
    for a, b, w in edges[["a", "b", "w"]].itertuples(index=False):
        for x in (a, b):
            strength[community[x]] = strength.get(community[x], 0.0) + w
        if community[a] == community[b]:
            inside[community[a]] = inside.get(community[a], 0.0) + w
    return sum(inside.get(c, 0.0) / total - (k / (2 * total)) ** 2 for c, k in strength.items())


def _moved(nodes: list, near: dict, loops: dict, twice: float, p: LouvainParams) -> dict:
    """node -> community (a node's name) after passes of local moves in order of the nodes."""
    strength = {n: sum(near[n].values()) + 2 * loops.get(n, 0.0) for n in nodes}
    home, total = {n: n for n in nodes}, dict(strength)
    for _ in range(p.iterations):
        gained = 0.0
        for n in nodes:
            links: dict = {}
            for other, w in near[n].items():
                links[home[other]] = links.get(home[other], 0.0) + w
            here, k = home[n], strength[n]
            total[here] -= k
            gain = lambda c: links.get(c, 0.0) - k * total[c] / twice  # noqa: B023, E731
            best, most = here, gain(here)
            for c in sorted(links):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            gained += (most - gain(here)) * 2 / twice
            total[best] += k
            home[n] = best
        if gained < p.tolerance:
            break
    return home


def louvain(edges: pd.DataFrame, p: LouvainParams = LouvainParams()) -> dict:
    """node -> community of one graph (a, b, w); a community is called by its smallest node."""
    pairs: dict = {}
    for a, b, w in edges[["a", "b", "w"]].itertuples(index=False):
        key = (a, b) if a <= b else (b, a)
        pairs[key] = pairs.get(key, 0.0) + w
    belongs = {n: n for pair in pairs for n in pair}
    twice = 2 * sum(pairs.values())
    while True:
        nodes = sorted({n for pair in pairs for n in pair})
        near: dict = {n: {} for n in nodes}
        loops = {}
        for (a, b), w in sorted(pairs.items()):
            if a == b:
                loops[a] = w
            else:
                near[a][b] = near[b][a] = w
        home = _moved(nodes, near, loops, twice, p)
        first: dict = {}
        for n in nodes:  # in order, so the first is the smallest
            first.setdefault(home[n], n)
        home = {n: first[c] for n, c in home.items()}
        if all(n == c for n, c in home.items()):
            break
        belongs = {n: home[c] for n, c in belongs.items()}
        merged: dict = {}
        for (a, b), w in pairs.items():
            x, y = sorted((home[a], home[b]))
            merged[x, y] = merged.get((x, y), 0.0) + w
        pairs = merged
    least: dict = {}
    for n, c in belongs.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in belongs.items()}


def _joint_moves(edges: DataFrame, p: LouvainParams) -> DataFrame:
    """(graph, id, community): where nodes are after rounds in which half of them move at a time."""
    apart = edges.where("a <> b")
    arcs = apart.unionByName(apart.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    ends = edges.select("graph", F.explode(F.array("a", "b")).alias("id"), "w")
    nodes = cut(ends.groupBy("graph", "id").agg(F.sum("w").alias("k")))
    twice = nodes.groupBy("graph").agg(F.sum("k").alias("twice"))
    home = nodes.withColumn("community", F.col("id"))
    for turn in range(p.rounds):
        total = home.groupBy("graph", "community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
        at = home.select("graph", F.col("id").alias("b"), "community")
        links = arcs.join(at, ["graph", "b"]).groupBy("graph", F.col("a").alias("id"), "community").agg(F.sum("w").alias("link"))
        # a node's own community is an option even if no neighbour is in it
        options = links.unionByName(home.select("graph", "id", "community", F.lit(0.0).alias("link"))).groupBy("graph", "id", "community").agg(F.sum("link").alias("link"))
        mine = home.select("graph", "id", "k", F.col("community").alias("here"))
        told = options.join(mine, ["graph", "id"]).join(total, ["graph", "community"]).join(twice, "graph")
        stays = F.col("community") == F.col("here")
        others = F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)
        told = told.withColumn("gain", F.col("link") - F.col("k") * others / F.col("twice"))
        alone = told.where(stays & (F.col("size") == 1)).select("graph", "id", F.lit(True).alias("alone"))
        best = told.groupBy("graph", "id").agg(
            F.max(F.struct("gain", (-F.col("community")).alias("least"), "size")).alias("best"),
            F.max(F.when(stays, F.col("gain"))).alias("now"),
        )
        free = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        # of two single nodes that want each other, the larger one moves
        swap = F.coalesce("alone", F.lit(False)) & (F.col("best.size") == 1) & (-F.col("best.least") > F.col("id"))
        goes = free & (F.col("best.gain") > F.col("now") + 1e-12) & ~swap
        moves = best.join(alone, ["graph", "id"], "left").where(goes).select("graph", "id", (-F.col("best.least")).alias("to"))
        moves = cut(moves)
        if moves.isEmpty() and turn:
            break
        home = cut(home.join(moves, ["graph", "id"], "left").select("graph", "id", "k", F.coalesce("to", "community").alias("community")))
    return home.select("graph", "id", "community")


def communities(edges: DataFrame, p: LouvainParams = LouvainParams()) -> DataFrame:
    """(graph, id, community) of undirected weighted graphs (graph, a, b, w) with integer nodes.

    Edges given more than once add up; a community is called by its smallest member; edges with a null end, null graph
    or without a positive weight don't count.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    fine = edges.where("graph is not null and a is not null and b is not null and w > 0")
    now = cut(fine.groupBy("graph", a.alias("a"), b.alias("b")).agg(F.sum("w").cast("double").alias("w")))
    belongs = now.select("graph", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(p.levels):
        large = now.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.local_edges).select("graph")
        if large.isEmpty():
            break
        part = now.join(large, "graph", "left_semi")
        home = _joint_moves(part, p)
        to = lambda c: home.select("graph", F.col("id").alias(c), F.col("community").alias(f"to_{c}"))
        met = part.join(to("a"), ["graph", "a"]).join(to("b"), ["graph", "b"])
        merged = met.groupBy("graph", F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).agg(F.sum("w").alias("w"))
        merged = cut(merged)
        if merged.count() == part.count():
            break  # no move is left that gains
        belongs = cut(
            belongs.join(home.select("graph", F.col("id").alias("community"), F.col("community").alias("to")), ["graph", "community"], "left")
            .select("graph", "id", F.coalesce("to", "community").alias("community"))
        )
        now = cut(now.join(large, "graph", "left_anti").unionByName(merged))
    large = now.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.local_edges).select("graph")
    id_type = edges.schema["a"].dataType.simpleString()
    graph_type = edges.schema["graph"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        found = louvain(part, p)
        return pd.DataFrame({"graph": part["graph"].iloc[0], "was": list(found), "to": list(found.values())})

    local = now.join(large, "graph", "left_anti").groupBy("graph").applyInPandas(one, f"graph {graph_type}, was {id_type}, to {id_type}")
    whole = belongs.join(local, (belongs["graph"] == local["graph"]) & (belongs["community"] == local["was"]), "left")
    whole = whole.select(belongs["graph"], "id", F.coalesce("to", "community").alias("community"))
    names = whole.groupBy("graph", "community").agg(F.min("id").alias("name"))
    return whole.join(names, ["graph", "community"]).select("graph", "id", F.col("name").alias("community"))


def sub_fleets(members: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Members (by..., actor_id, community, skipped) with sub_fleet, method, was_orphan and community_size.

    Communities of at least `least` are ranked from 0 by size, then by smallest member; the members of smaller ones are
    orphans and join sub-fleet 0, as all do if no community is large enough. A member without a community is one of its
    own. Where every member of a group was skipped as too few for a graph, the group is sub-fleet 0 as it is.
    """
    named = lambda alone, c: F.struct(F.lit(alone).alias("alone"), F.col(c).cast("long").alias("name"))
    own = F.when(F.col("community").isNull(), named(1, "actor_id")).otherwise(named(0, "community"))
    rows = members.withColumn("__c", own)
    sizes = rows.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("community_size"), F.min("actor_id").alias("__first"), F.min("skipped").alias("__skipped"))
    small = sizes.groupBy(*by).agg(F.min("__skipped").alias("__small"))
    large = sizes.where(F.col("community_size") >= least)
    # a row per promoted community is left here
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("community_size"), "__first")) - 1
    ranked = large.select(*by, "__c", rank.alias("__rank"))
    told = rows.join(sizes.drop("__first", "__skipped"), [*by, "__c"]).join(small, by).join(ranked, [*by, "__c"], "left")
    orphan = F.col("__rank").isNull()
    method = F.when(F.col("__small"), "small_tier").when(orphan, "orphan").otherwise("community")
    return told.select(
        *by, "actor_id", F.when(F.col("__small"), 0).otherwise(F.coalesce("__rank", F.lit(0))).cast("long").alias("sub_fleet"),
        method.alias("method"), (orphan & ~F.col("__small")).alias("was_orphan"), "community_size",
    )
