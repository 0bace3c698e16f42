"""Names in messages, against a plain reading of the rule."""

import random
import re

from emberline.operators import entities as N
from emberline.queries import load

NAMES = [("Sid Matthews", 1, "character"), ("Matthews", 2, "character"), ("Red Moon", 3, "corporation"), ("Red Moon Rising", 4, "alliance"), ("moon", 5, "alliance"), ("Gate", 6, "alliance"), ("12345", 7, "corporation"), ("ab", 8, "corporation"), ("MOON", 9, "corporation"), ("X-7 base", 10, "corporation")]
SYSTEMS = [("X-7", 70), ("J123456", 71), ("1DQ1-A", 72)]


def plain(message):
    tokens = [t for t in re.split(N.BREAKS, re.sub(N.SCAN, " ", re.sub(N.LINK, " ", message))) if t]
    used, out = set(), []
    for i, t in enumerate(tokens):
        hit = [s for s in SYSTEMS if s[0] == t and re.search(N.SYSTEM, t)]
        if hit:
            out.append((t, "system", hit[0][1], hit[0][0], "system_code", "high", i))
            used.add(i)
    for n in (3, 2, 1):
        for i in range(len(tokens) - n + 1):
            token = " ".join(tokens[i : i + n])
            if used & set(range(i, i + n)) or token.lower() in N.STOPWORDS or (n == 1 and (len(token) < 3 or token.isdigit())):
                continue
            hit = sorted((e, name, kind) for name, e, kind in NAMES if name.lower() == token.lower())
            if hit:
                e, name, kind = hit[0]
                out.append((token, kind, e, name, "exact_name", "high" if n > 1 else "medium", i))
                used |= set(range(i, i + n))
    return out


def run(spark, messages):
    df = spark.createDataFrame([(i, m, "x") for i, m in enumerate(messages)], "event_id long, message string, token string")
    got = N.resolve(df, spark.createDataFrame(NAMES, "name string, entity_id long, category string"), spark.createDataFrame(SYSTEMS, "name string, id long")).collect()
    return {i: sorted(tuple(r)[1:] for r in got if r.event_id == i) for i in range(len(messages))}


def test_against_the_rule(spark):
    rng = random.Random(3)
    pieces = ["Sid", "Matthews", "Red", "Moon", "Rising", "moon", "gate", "12345", "ab", "X-7", "base", "J123456", "1DQ1-A", "1dq1-a", "warp", "https://dscan.info/v/ab1"]
    messages = ["".join(rng.choice(pieces) + rng.choice([" ", ", ", "  ", " - ", "/"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    messages += ["", None, " ,.; ", "moon " * 5000]
    got = run(spark, messages)
    assert got == {i: sorted(plain(m or "")) for i, m in enumerate(messages)}


def test_links(spark):
    message = "<url=showinfo:1377//1>Sid M</url> in <url=showinfo:5//72>somewhere</url> <url=showinfo:99//5></url> <url=showinfo:0//4>x</url> Matthews"
    got = run(spark, [message])[0]
    assert got == sorted([
        ("Sid M", "character", 1, "Sid Matthews", "showinfo_link", "high", 0), ("somewhere", "system", 72, "1DQ1-A", "showinfo_link", "high", 1),
        ("showinfo:99/5", "unknown", 5, "", "showinfo_link", "high", 2), ("Matthews", "character", 2, "Matthews", "exact_name", "medium", 1),
    ])


def test_no_messages(spark):
    df = spark.createDataFrame([], "event_id long, message string")
    assert N.resolve(df, spark.createDataFrame(NAMES, "name string, entity_id long, category string"), spark.createDataFrame(SYSTEMS, "name string, id long")).collect() == []


def test_texts_are_cut_once_and_only_words_that_begin_a_name_make_runs(spark):
    df = spark.createDataFrame([(i, "no word here begins any known one " * 20) for i in range(50)] + [(50, "red moon rising, red moon")], "event_id long, message string")
    runs = N.resolve(df, spark.createDataFrame(NAMES, "name string, entity_id long, category string"), spark.createDataFrame(SYSTEMS, "name string, id long"))
    assert sorted((r.event_id, r.id, r.token_offset) for r in runs.collect()) == [(50, 3, 3), (50, 4, 0)]
    plan = load()[0]["d3_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 2  # the texts' words, and the links of those that may hold one
    assert "ExistingRDD" not in plan and "BuildLeft" not in plan


def test_longer_names_than_runs_and_heads_of_several_lengths(spark):
    names = [("a b c d", 1, "character"), ("aaa", 2, "character"), ("AAA bbb", 3, "corporation"), ("aaa bbb ccc", 4, "alliance"), (None, 5, "alliance"), ("", 6, "alliance"), ("x-7", 7, "corporation")]
    df = spark.createDataFrame([(0, "aaa bbb"), (1, "a b c d"), (2, "Aaa Bbb Ccc aaa"), (3, "x-7 X-7"), (4, "bbb aaa")], "event_id long, message string")
    got = N.resolve(df, spark.createDataFrame(names, "name string, entity_id long, category string"), spark.createDataFrame(SYSTEMS, "name string, id long"))
    assert sorted((r.event_id, r.token_offset, r.id, r.method) for r in got.collect()) == [
        (0, 0, 3, "exact_name"), (2, 0, 4, "exact_name"), (2, 3, 2, "exact_name"), (3, 0, 7, "exact_name"), (3, 1, 70, "system_code"), (4, 1, 2, "exact_name"),
    ]
