"""Scores, bands and classes: weighted sums and ordered rules over columns that joins and grouped sums have made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _count() -> Column:
    return F.count(F.lit(1))


def ladder(value: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first step, from the top, whose bound the value reaches."""
    out = F.lit(below)
    for least, name in reversed(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def first_rule(rules: Sequence[tuple[Column, Column | str]], other: str) -> Column:
    """The outcome of the first rule that holds."""
    out = F.lit(other)
    for holds, then in reversed(rules):
        out = F.when(holds, F.lit(then) if isinstance(then, str) else then).otherwise(out)
    return out


def weighted(weights: Mapping[str, float]) -> Column:
    """Sum of columns by weight; null counts as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) * F.lit(w) for c, w in weights.items()), F.lit(0.0))


def colocation(touched: DataFrame) -> DataFrame:
    """(a, b, shared, avoided, parallel, avoidance, parallel_share): cells where both parties were active, those of them
    without an event of both, and those of these where they were in different places.

    touched: (event_id, who, cell, place); a cell is a region and hour, so it holds few parties, which meet in pairs.
    """
    here = touched.groupBy("who", "cell").agg(F.collect_set("place").alias("places"))
    both = here.toDF("a", "cell", "pa").join(here.toDF("b", "cell", "pb"), "cell").where("a < b")
    seen = touched.select("event_id", "who", "cell").distinct()
    engaged = seen.toDF("event_id", "a", "cell").join(seen.select("event_id", F.col("who").alias("b")), "event_id").where("a < b")
    engaged = engaged.select("a", "b", "cell").distinct().withColumn("engaged", F.lit(True))
    avoided = F.col("engaged").isNull()
    apart = avoided & (F.size("pa") > 0) & (F.size("pb") > 0) & ~F.arrays_overlap("pa", "pb")
    out = both.join(engaged, ["a", "b", "cell"], "left").groupBy("a", "b").agg(
        _count().alias("shared"), F.count_if(avoided).alias("avoided"), F.count_if(apart).alias("parallel")
    )
    return out.withColumns({"avoidance": F.col("avoided") / F.col("shared"), "parallel_share": F.col("parallel") / F.col("shared")})


#: The parts of every role's prior.
PRIOR_PARTS = {
    "fc": {"hull_command": 0.60, "said_fc": 0.25, "attested": 0.15},
    "logi": {"hull_logi": 0.70, "said_logi": 0.20, "unhurt": 0.10},
    "mainline": {"hull_mainline": 0.50, "in_main": 0.20, "share": 0.15, "said_mainline_dps": 0.15},
    "command": {"hull_command": 0.70, "said_command": 0.30},
    "bomber": {"hull_bomber": 0.80, "said_bomber": 0.20},
    "tackle": {"hull_tackle": 0.70, "said_tackle": 0.30},
}


def role_priors(rows: DataFrame, said: DataFrame, attested: DataFrame, least: int = 5) -> DataFrame:
    """(who, battles, fc, logi, ...) of those with enough battles.

    rows: (who, hull, in_main, share), one a battle; said: (who, role, n), how often a role was inferred; attested: (who).
    """
    hulls = ("command", "logi", "mainline", "bomber", "tackle")
    roles = ("fc", "logi", "mainline_dps", "command", "bomber", "tackle")
    per = rows.groupBy("who").agg(
        _count().alias("battles"), *[(F.count_if(F.col("hull") == h) / _count()).alias(f"hull_{h}") for h in hulls],
        (F.count_if("in_main") / _count()).alias("in_main"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("share"),
    ).where(F.col("battles") >= least)
    told = said.groupBy("who").agg(*[F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(f"said_{r}") for r in roles])
    known = attested.select("who").distinct().withColumn("attested", F.lit(1.0))
    all_ = per.join(told, "who", "left").join(known, "who", "left").withColumn("unhurt", 1 - F.col("share"))
    all_ = all_.withColumns({f"said_{r}": F.col(f"said_{r}") / F.col("battles") for r in roles})
    clamped = lambda parts: F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted(parts)))
    return all_.select("who", "battles", *[clamped(parts).alias(role) for role, parts in PRIOR_PARTS.items()])


#: The weights of a system's threat and its tiers.
THREAT_WEIGHTS = {
    "cluster": 1.0, "escalation": 1.5, "battle_linkage": 1.0, "density": 0.05, "reliability": 0.05, "corridor": 0.05, "dscan": 0.4,
    "capital": 1.5, "logistics": 0.3, "doctrine_threat": 0.5, "escalation_propensity": 1.0,
}
THREAT_TIERS = ((7.0, "strategic"), (4.0, "hot"), (2.0, "contested"), (0.5, "watch"))


def threat(components: DataFrame, weights: Mapping[str, float] = THREAT_WEIGHTS) -> DataFrame:
    """components with raw, threat (the highest raw score is 10, or less if under 1) and tier."""
    rows = components.withColumn("raw", weighted({c: w for c, w in weights.items() if c in components.columns}))
    top = rows.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("top")).scalar()
    rows = rows.withColumn("threat", F.col("raw") * 10.0 / top)
    return rows.withColumn("tier", ladder(F.round("threat", 4), THREAT_TIERS, "safe"))


def lane_metrics(runs: DataFrame, now: Column) -> DataFrame:
    """A row per lane of runs (lane, status, started_at, ms): counts of the last day, nearest-rank p95, age of the oldest
    running one, throughput and state.

    The rank is found on the counts of equal durations, so a busy lane is summed before it meets in a task.
    """
    recent = F.col("started_at") >= now - F.expr("interval 24 hours")
    ok, bad, running = (F.col("status") == s for s in ("succeeded", "failed", "running"))
    done = runs.where(ok & recent & F.col("ms").isNotNull()).groupBy("lane", "ms").agg(_count().alias("n"))
    lane = W.partitionBy("lane")
    ranked = done.withColumns({"upto": F.sum("n").over(lane.orderBy("ms")), "m": 19 * (F.sum("n").over(lane) - 1)})
    q, r = F.expr("m div 20"), F.col("m") % 20
    at = q + ((r > 10) | ((r == 10) & (q % 2 == 1))).cast("long")  # 0.95 (n - 1), halves to even
    p95 = ranked.where(F.col("upto") > at).groupBy("lane").agg(F.min("ms").alias("p95"))
    out = runs.groupBy("lane").agg(
        F.count_if(running).alias("running"), F.count_if(ok & recent).alias("succeeded"), F.count_if(bad & recent).alias("failed"),
        F.floor(F.avg(F.when(ok & recent, F.col("ms")))).alias("mean"), F.min(F.when(running, F.unix_timestamp("started_at"))).alias("since"),
    )
    out = out.join(p95, "lane", "left").withColumn("oldest", F.unix_timestamp(now) - F.col("since")).drop("since")
    n, f = F.col("succeeded"), F.col("failed")
    state = first_rule(
        [((f > 0) & (n == 0), "failed"), (F.col("oldest") > 3600, "starved"), (F.col("running") >= 4, "backlogged"), ((f > 0) & (5 * f >= n + f), "degraded")],
        "healthy",
    )
    return out.withColumns({"throughput": n / 24, "state": state})


def fused_incidents(signals: DataFrame, gap_seconds: int = 900) -> DataFrame:
    """Signals of one place (null is one place too) no further apart than the gap, as incidents with type, severity and confidence.

    signals: (place, kind, started_at, ended_at, reporter, character, cluster_id, quality, ships); quality is null, strong or strategic.
    """
    s, e = F.unix_timestamp("started_at"), F.unix_timestamp("ended_at")
    w = W.partitionBy("place").orderBy("started_at", "ended_at", "kind")
    new = F.coalesce((s - F.max(e).over(w.rowsBetween(W.unboundedPreceding, -1)) > gap_seconds).cast("int"), F.lit(1))
    marked = signals.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    told = marked.groupBy("place", "island").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.collect_set("kind").alias("kinds"), _count().alias("n"),
        F.countDistinct("reporter").alias("reporters"), F.countDistinct("character").alias("characters"), F.countDistinct("cluster_id").alias("clusters"),
        F.max(F.when(F.col("quality") == "strategic", 2).when(F.col("quality") == "strong", 1).otherwise(0)).alias("best"), F.max("ships").alias("ships"),
    )
    has = lambda *k: F.arrays_overlap("kinds", F.array(*map(F.lit, k)))
    one = lambda k: (F.size("kinds") == 1) & has(k)
    hostile, kinds, reporters, clusters = has("hostile_cluster"), F.size("kinds"), F.col("reporters"), F.col("clusters")
    kind = first_rule(
        [
            (has("fleet_formup") & has("hostile_cluster", "combat_spike", "escalation"), "fleet_op"), (has("escalation"), "engagement"),
            (hostile & has("combat_spike", "disengagement"), "engagement"), (hostile, "hostile_contact"), (has("combat_spike"), "combat"),
            (has("disengagement"), "disengagement"), (has("fleet_formup"), "fleet_op"), (one("crash_symptom") | one("unknown"), "telemetry_gap"),
        ],
        "mixed",
    )
    severity = first_rule(
        [
            ((reporters >= 10) & (F.col("characters") >= 10), "coalition_level"), (hostile & has("combat_spike", "escalation") & has("disengagement"), "escalation"),
            (hostile & (F.coalesce("ships", F.lit(0)) >= 150), "escalation"), (F.col("best") == 2, "strategic"), ((kinds >= 3) & (F.col("best") >= 1), "strategic"),
            ((F.col("best") == 1) | (kinds >= 2), "tactical"),
        ],
        "noise",
    )
    sure = first_rule([((reporters >= 5) | (clusters >= 3), "high"), ((reporters >= 3) | (clusters >= 2), "medium"), ((reporters >= 2) | (kinds >= 2), "low")], "insufficient")
    return told.withColumns({"type": kind, "severity": severity, "confidence": sure}).drop("island", "kinds", "best", "ships")


def route_classes(routes: DataFrame) -> DataFrame:
    """Routes (n, characters, seconds, span_days, from_escalates, to_escalates, strategic) with three scores and class."""
    n, who, one = F.col("n"), F.col("characters"), F.lit(1.0)
    a, b, zero = F.col("from_escalates"), F.col("to_escalates"), F.lit(0.0)
    scores = {
        "staging": F.when((F.col("seconds") <= 90) & (who >= 3) & (n >= 4), F.least(one, n / 50 + who / 30)).otherwise(zero),
        "reinforcement": F.when(b & ~a, F.least(one, 0.3 + n / 30)).when(a & ~b, F.least(one, 0.2 + n / 40)).otherwise(zero),
        "escalation": F.when(a & b, F.least(one, 0.5 + F.col("strategic") / 20)).otherwise(zero),
    }
    rules = [
        (F.col("escalation") >= 0.5, "escalation_path"), (F.col("staging") >= 0.5, "staging"), (F.col("reinforcement") >= 0.4, "reinforcement"),
        ((F.col("span_days") >= 14) & (n >= 3) & (who >= 2), "deployment_migration"), (n >= 2, "transit"),
    ]
    return routes.withColumns(scores).withColumn("class", first_rule(rules, "unclassified"))


#: The weights of the signals of a hypothesis.
SIGNAL_WEIGHTS = {
    "review_priority_score": 2.0, "hostile_triangle": 2.0, "community_hostile_pct": 2.0, "asymmetric_pair": 1.5, "recent_hostile_join": 2.0, "graph_centrality": 1.0,
    "longitudinal_exposure": 1.5, "incident_overlap": 2.5, "corridor_overlap": 2.0, "synchronized_timing": 1.5, "corp_cadence_anomaly": 2.0,
}


def hypotheses(signals: DataFrame, prior: DataFrame, weights: Mapping[str, float] = SIGNAL_WEIGHTS) -> DataFrame:
    """(who, score, domains, confidence, severity): signals (who, kind, domain, strength) weighed; what stays low is left out.

    prior: (who, prior), an earlier score that makes a strong new one critical. Kinds without a weight count nothing.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")]
    rows = signals.where(weight.isNotNull()).groupBy("who").agg(F.sum(weight * F.col("strength")).alias("score"), F.countDistinct("domain").alias("domains"))
    rows = rows.where((F.col("domains") >= 2) & (F.col("score") >= 3)).join(prior, "who", "left")
    high = (F.col("domains") >= 3) & (F.col("score") >= 4)
    known = F.coalesce(F.col("prior") >= 0.4, F.lit(False))
    severity = first_rule([(high & known, "critical"), (F.col("score") >= 4, "elevated")], "watch")
    return rows.select("who", "score", "domains", F.when(high, "high").otherwise("medium").alias("confidence"), severity.alias("severity"))


#: The weights of the review priority.
REVIEW_WEIGHTS = {
    "affiliation": 0.28, "hostile_overlap": 0.24, "bridge": 0.12, "churn": 0.08, "joined": 0.08, "seeded": 0.10, "inner_bridge": 0.05, "small_ring": 0.05,
}


def review_priority(rows: DataFrame) -> DataFrame:
    """rows (who, affiliation, hostile_overlap, bridge, churn, inner_pct, recent_join, seeds, is_seed, ring, leader) with
    signals, score and band. Leaders are exempt: score 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = rows.withColumns(
        {
            "joined": flag(F.col("recent_join")), "seeded": F.least(F.lit(1.0), F.coalesce("seeds", F.lit(0)) / 20), "inner_bridge": flag(F.col("inner_pct") >= 0.95),
            "small_ring": flag(F.col("ring").between(5, 50)),
        }
    )
    tests = [
        F.col("affiliation") >= 0.85, F.col("hostile_overlap") >= 0.85, F.col("bridge") >= 0.95, F.col("recent_join"), F.col("churn") >= 0.95, F.col("seeds") >= 10,
        (F.col("inner_bridge") == 1) & ~F.coalesce("is_seed", F.lit(False)),
    ]
    signals = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    out = out.withColumns({"signals": signals, "score": weighted(REVIEW_WEIGHTS)})
    n, score, leader = F.col("signals"), F.col("score"), F.coalesce("leader", F.lit(False))
    band = first_rule(
        [(leader, "leadership_exempt"), ((n >= 3) | (score >= 0.75), "critical"), ((n >= 2) | (score >= 0.55), "high"), ((n >= 1) | (score >= 0.35), "elevated")],
        "below_threshold",
    )
    return out.withColumn("band", band).select("who", "signals", F.when(leader, 0.0).otherwise(F.round("score", 4)).alias("score"), "band")


def composition(ships: DataFrame, roles: Sequence[str], uncounted: Sequence[str] = ("pod", "shuttle")) -> DataFrame:
    """A row per snapshot of ships (snapshot, role, n): ships by role, pilots, ratios of logistics and tackle."""
    role = F.when(F.col("role").isin(*roles), F.col("role")).otherwise("dps")
    of = lambda r: F.sum(F.when(role == r, F.col("n")).otherwise(0)).alias(r)
    out = ships.groupBy("snapshot").agg(*map(of, roles), F.sum(F.when(role.isin(*uncounted), 0).otherwise(F.col("n"))).alias("pilots"))
    fighting = F.greatest(F.lit(1), F.col("pilots") - F.col("support"))
    return out.withColumns({"logistics_ratio": F.col("logistics") / fighting, "tackle_ratio": F.col("tackle") / fighting})


def doctrine_match(ships: DataFrame, doctrines: DataFrame, top: int = 8) -> DataFrame:
    """(snapshot, doctrine, share, confidence): the doctrine (id, ship, confidence) of the highest share times confidence
    among those of a snapshot's (snapshot, ship, n) most frequent ships."""
    w = W.partitionBy("snapshot")
    rank = F.row_number().over(w.orderBy(F.desc("n"), "ship"))
    seen = ships.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": rank}).where(F.col("rank") <= top)
    best = doctrines.groupBy("ship").agg(F.max(F.struct("confidence", (-F.col("id")).alias("id"))).alias("d"))
    met = seen.join(best, "ship").withColumn("score", F.col("share") * F.col("d.confidence"))
    one = met.groupBy("snapshot").agg(F.max(F.struct("score", F.col("d.id").alias("id"), "share")).alias("x"))
    return one.select("snapshot", (-F.col("x.id")).alias("doctrine"), F.col("x.share").alias("share"), F.least(F.lit(1.0), 1.5 * F.col("x.score")).alias("confidence"))


def inferred_bloc(viewers: DataFrame, labels: DataFrame) -> DataFrame:
    """(viewer, bloc, confidence, reason) of viewers (viewer, alliance, corporation) by labels (kind, entity, bloc)."""
    told = labels.groupBy("kind", "entity").agg(F.min("bloc").alias("low"), F.max("bloc").alias("high"))
    of = lambda kind, p: told.where(F.col("kind") == kind).select(F.col("entity").alias(kind), F.col("low").alias(f"{p}low"), F.col("high").alias(f"{p}high"))
    rows = viewers.join(of("alliance", "a"), "alliance", "left").join(of("corporation", "c"), "corporation", "left")
    one_a, one_c = F.coalesce(F.expr("alow = ahigh"), F.lit(False)), F.coalesce(F.expr("clow = chigh"), F.lit(False))
    some_a, some_c = F.col("alow").isNotNull(), F.col("clow").isNotNull()
    reason = first_rule(
        [
            (one_a & one_c & (F.col("alow") != F.col("clow")), "labels disagree"), (one_a, "alliance"), (some_a, "alliance ambiguous"), (one_c, "corporation"),
            (some_c, "corporation ambiguous"),
        ],
        "no label",
    )
    bloc = F.when(one_a, F.col("alow")).when(~some_a & one_c, F.col("clow"))
    sure = F.when(F.col("reason") == "labels disagree", "medium").when(F.col("bloc").isNotNull(), "high").otherwise("unresolved")
    return rows.withColumns({"reason": reason, "bloc": bloc}).select("viewer", "bloc", sure.alias("confidence"), "reason")


def seeds(rows: DataFrame, least_history: int = 2) -> DataFrame:
    """(who) of rows (who, history, met) with enough history, or met at least as often as the value at nine tenths, and once.

    The value is found on the counts of equal ones: a row per distinct number.
    """
    n = rows.groupBy("met").agg(_count().alias("n"))
    ranked = n.withColumns({"upto": F.sum("n").over(W.orderBy("met")), "total": F.sum("n").over(W.partitionBy())})
    least = ranked.where(F.col("upto") > F.expr("total * 9 div 10")).agg(F.greatest(F.min("met"), F.lit(1)).alias("least")).scalar()
    return rows.where((F.col("history") >= least_history) | (F.col("met") >= least)).select("who").distinct()


def seed_neighbours(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """(who, n, best): how many seeds are among the peers of edges (who, peer, score), and the highest score to one."""
    met = edges.join(seed.select(F.col("who").alias("peer")), "peer", "left_semi")
    return met.groupBy("who").agg(F.countDistinct("peer").alias("n"), F.max("score").alias("best"))


def _near(top: int, cutoff: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(q) or not len(c):
            return pd.DataFrame({"id": [], "peer": [], "score": []}).astype({"id": np.int64, "peer": np.int64})
        a, b = np.stack(q["z"].to_list()), np.stack(c["z"].to_list())
        score = np.round(a @ b.T, 9)
        ids, peers = q["id"].to_numpy(), c["id"].to_numpy()
        score[ids[:, None] == peers[None, :]] = -2.0
        order = np.lexsort((np.broadcast_to(peers, score.shape), -score), axis=1)[:, :top]
        best = np.take_along_axis(score, order, 1)
        i, j = np.nonzero(best >= cutoff)
        return pd.DataFrame({"id": ids[i], "peer": peers[order[i, j]], "score": best[i, j]})

    return run


def similar(rows: DataFrame, features: Sequence[str], top: int = 100, cutoff: float = 0.60, block_rows: int = 2000) -> DataFrame:
    """(id, peer, score, rank): the most similar rows of each by the cosine of their z-scores (population deviation, 1e-6 at least).

    Exact, block against block: a task holds two blocks, whatever the number of rows, and gives `top` a row.
    """
    stats = rows.agg(_count(), *[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    z = [(F.coalesce(F.col(c), F.lit(0)) - F.lit(stats[1 + 2 * i])) / F.lit(max(stats[2 + 2 * i] or 0.0, 1e-6)) for i, c in enumerate(features)]
    blocks = -(-stats[0] // block_rows) or 1
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select("id", F.array(*z).alias("z")).withColumn("z", F.transform("z", lambda x: F.try_divide(x, length))).where("z[0] is not null")
    unit = unit.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = [unit.select("id", "z", F.lit(asks).alias("asks"), F.col("own" if asks else "other").alias("q"), F.col("other" if asks else "own").alias("c")) for asks in (True, False)]
    found = sides[0].unionByName(sides[1]).groupBy("q", "c").applyInPandas(_near(top, cutoff), "id long, peer long, score double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "peer"))).where(F.col("rank") <= top)


def fingerprints(rows: DataFrame, least: int = 2, camp_days: int = 3) -> DataFrame:
    """Style of those who appear at least twice: the highest of six ratios, if it is 0.3 or more.

    rows: (who, place, at, incident, escalated, disengaged, bait, big_logi, fast), one an appearance, flags being booleans.
    """
    gap = F.unix_timestamp("at") - F.lag(F.unix_timestamp("at")).over(W.partitionBy("who", "place").orderBy("at"))
    rows = rows.withColumn("camp", F.col("place").isNotNull() & F.coalesce(gap <= camp_days * 86400, F.lit(False)))
    flags = ("escalated", "disengaged", "bait", "big_logi", "fast", "camp")
    per = rows.groupBy("who").agg(_count().alias("n"), F.countDistinct("incident").alias("incidents"), *[F.count_if(f).alias(f) for f in flags]).where(F.col("n") >= least)
    some, n = F.greatest(F.lit(1), F.col("incidents")), F.col("n")
    ratios = {
        "rapid_escalator": F.col("escalated") / some, "heavy_logi_anchor": F.col("big_logi") / n, "conservative_disengager": F.col("disengaged") / some,
        "bait_specialist": F.col("bait") / some, "corridor_camper": F.col("camp") / (n - 1), "fast_responder": F.col("fast") / n,
    }
    per = per.withColumns({name: F.least(F.lit(1.0), r) for name, r in ratios.items()}).withColumn("top", F.greatest(*ratios))
    style = first_rule(
        [(F.col("top") >= 0.3, first_rule([(F.col(r) == F.col("top"), r) for r in ratios], "")), (n >= 5, "generalist")],
        "undetermined",
    )
    score = F.when(F.col("top") >= 0.3, F.col("top")).otherwise(0.0)
    return per.select("who", "n", "incidents", *ratios, style.alias("style"), score.alias("score"), ladder(n, ((30, "high"), (10, "medium"), (4, "low")), "insufficient").alias("confidence"))


def sides(pilots: DataFrame, kills: DataFrame, allegiance: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(battle, who, side) of parties: A has most pilots, B of those on the field met A most often in kills; the others join
    the side that their kills and losses, or else earlier allegiances, support at least three times and more than twice as often.

    pilots: (battle, who, n); kills: (battle, killer, victim, n) between different parties; allegiance: (who, other, allied,
    opposed). Ties go to the smaller id; a battle without a B gives nothing; who can't be told is C.
    """
    a = pilots.groupBy("battle").agg(F.max(F.struct("n", (-F.col("who")).alias("w"))).alias("x")).select("battle", (-F.col("x.w")).alias("a"))
    ends = F.explode(F.array(F.struct(F.col("killer").alias("who"), F.col("victim").alias("other")), F.struct(F.col("victim").alias("who"), F.col("killer").alias("other"))))
    met = kills.where("killer <> victim").select("battle", ends.alias("e"), "n").select("battle", "e.*", "n").groupBy("battle", "who", "other").agg(F.sum("n").alias("n"))
    field = pilots.select("battle", "who")
    foes = met.join(a, "battle").where("other = a and who <> a").join(field, ["battle", "who"], "left_semi")
    b = foes.groupBy("battle", "a").agg(F.max(F.struct("n", (-F.col("who")).alias("w"))).alias("x")).select("battle", "a", (-F.col("x.w")).alias("b"))
    # met counts kills of each by the other, so what was against B supports A
    every = field.unionByName(met.select("battle", "who")).distinct().join(b, "battle")
    against = lambda end: F.sum(F.when(F.col("other") == F.col(end), F.col("n")).otherwise(0))
    told = every.join(met, ["battle", "who"], "left").groupBy("battle", "who", "a", "b").agg(against("b").alias("for_a"), against("a").alias("for_b"))
    clear = lambda x, y: (F.col(x) >= least) & (F.col(x) > 2 * F.col(y))
    rules = [(F.expr("who = a"), "A"), (F.expr("who = b"), "B"), (clear("for_a", "for_b"), "A"), (clear("for_b", "for_a"), "B")]
    if allegiance is not None:
        of = lambda end, p: allegiance.select("who", F.col("other").alias(end), F.col("allied").alias(f"{p}ally"), F.col("opposed").alias(f"{p}opp"))
        told = told.join(of("a", "a_"), ["who", "a"], "left").join(of("b", "b_"), ["who", "b"], "left").join(field.withColumn("on_field", F.lit(True)), ["battle", "who"], "left")
        told = told.fillna(0, ["a_ally", "a_opp", "b_ally", "b_opp"]).withColumns({"was_a": F.col("a_ally") + F.col("b_opp"), "was_b": F.col("b_ally") + F.col("a_opp")})
        rules += [(F.col("on_field") & clear("was_a", "was_b"), "A"), (F.col("on_field") & clear("was_b", "was_a"), "B")]
    return told.select("battle", "who", first_rule(rules, "C").alias("side"))


def sell_advice(rows: DataFrame, runway_days: int = 14) -> DataFrame:
    """rows (type_id, listings, sell_listings, rate, listing_days, units_sold, daily_fill, regional_volume, open_units, age_days)
    with velocity, confidence, band and the quantity to list: a runway of the daily fill, or of a twentieth of the region's
    volume, less what is listed already."""
    days, n, rate = F.col("listing_days"), F.col("listings"), F.col("rate")
    velocity = F.when(days < 7, "fast").when(days <= 21, "medium").when(days.isNotNull(), "slow")
    age = F.greatest(F.lit(0), F.col("age_days"))
    recent = F.when(age <= 7, 1.0).when(age <= 30, 0.7).when(age <= 60, 0.4).otherwise(0.2)
    sure = 0.4 * F.least(F.lit(1.0), n / 10) + 0.4 * F.least(F.lit(1.0), F.col("units_sold") / 200) + 0.2 * recent
    band = first_rule(
        [
            ((n < 1) & (F.col("sell_listings") >= 1), "observing"), ((n < 1) | rate.isNull(), "low_data"), ((rate >= 0.7) & (n < 2), "test_more"),
            ((rate >= 0.7) & (F.col("velocity") == "slow"), "slow_capital"), (rate >= 0.7, "stock_more"), ((rate <= 0.3) & (n >= 2), "reduce"),
        ],
        "hold",
    )
    fill = F.when(F.col("daily_fill") > 0, F.col("daily_fill")).when(F.col("regional_volume") > 0, F.col("regional_volume") * 0.05)
    wanted = F.ceil(fill * runway_days) - F.coalesce("open_units", F.lit(0))
    out = rows.withColumns({"velocity": velocity, "sure": sure}).withColumns({"band": band, "confidence": ladder(F.round("sure", 9), ((0.7, "high"), (0.4, "medium")), "low")})
    return out.withColumn("quantity", F.when(F.col("band").isin("stock_more", "test_more", "slow_capital") & (wanted > 0), wanted))
