"""Circles of opponents, against a plain reading of the rule over days."""

import itertools
import math
import random

from emberline.operators import cliques as Q
from emberline.operators.cliques import circles
from emberline.queries import chain
from emberline.schema import Views


def plain(meetings, p):
    """target -> (members, size, shared, weight), with sets of days."""
    out = {}
    for target in {t for t, _, _ in meetings}:
        days = {}
        for t, o, d in meetings:
            if t == target and o != t:
                days.setdefault(o, set()).add(d)
        top = sorted(days, key=lambda o: (-len(days[o]), o))[: p.top]
        share = lambda *m: [len(days[a] & days[b]) for a, b in itertools.combinations(m, 2)]  # noqa: B023, E731
        seeds = [(share(a, b)[0], -a, -b) for a, b in itertools.combinations(sorted(top), 2)]
        if not seeds or max(seeds)[0] < p.least_days:
            continue
        _, a, b = max(seeds)
        members = [-a, -b]
        while len(members) < p.most_members:
            fit = [(sum(share(*members, c)) - sum(share(*members)), -c) for c in top if c not in members and min(share(*members, c)) >= p.least_days]
            if not fit:
                break
            members.append(-max(fit)[1])
        if len(members) >= 3:
            out[target] = (members, len(members), min(share(*members)), float(sum(share(*members))))
    return out


def test_against_the_rule(spark):
    rng = random.Random(8)
    for p in (Q.CircleParams(), Q.CircleParams(top=5, least_days=1, most_members=4), Q.CircleParams(least_days=3)):
        rows = [(rng.randrange(12), rng.randrange(14), rng.randrange(9)) for _ in range(1500)] + [(50, 1, 1), (50, 2, 1), (51, 51, 2)]
        rows += rows[:40]
        df = spark.createDataFrame(rows, "target long, opponent long, day int")
        got = {r.target: (list(r.members), r.size, r.shared_days, r.weight) for r in Q.circles(df, p).collect()}
        assert got == plain(rows, p)
        assert got


def test_nothing_met(spark):
    assert Q.circles(spark.createDataFrame([], "target long, opponent long, day int")).collect() == []


def test_no_opponent_and_no_member_is_left_out(spark, monkeypatch):
    """Only the first ten opponents and five members counted (F10)."""
    p = Q.CircleParams(top=None, least_days=1, most_members=math.inf)
    df = spark.createDataFrame([(100, o, 1) for o in range(40)], "target long, opponent long, day int")
    assert [tuple(r) for r in Q.circles(df, p).collect()] == [(100, list(range(40)), 40, 1, 780.0)]
    rng = random.Random(9)
    rows = [(rng.randrange(6), rng.randrange(40), rng.randrange(30)) for _ in range(1200)] + [(50, 1, 1), (50, 2, 1)]
    for least, pairs in ((1, 10**6), (2, 10**6), (1, 0), (2, 300)):
        p = Q.CircleParams(top=None, least_days=least, most_members=math.inf)
        monkeypatch.setattr(Q, "LOCAL_PAIRS", pairs)
        got = {r.target: (list(r.members), r.size, r.shared_days, r.weight) for r in Q.circles(spark.createDataFrame(rows, "target long, opponent long, day int"), p).collect()}
        assert got == plain(rows, p)
        assert max(x[1] for x in got.values()) > 5 or least > 1


def test_large_targets_by_joins_as_the_rule(spark, monkeypatch):
    monkeypatch.setattr(Q, "LOCAL_PAIRS", 0)
    test_against_the_rule(spark)


def test_the_query_takes_all(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "circles", lambda met, p: seen.append(p) or circles(met, p))
    chain.circles(Views(spark, "/root/testdata/sf0.001"))
    assert seen[0].top is None and seen[0].most_members == math.inf
