from fractions import Fraction

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import mixing


def fluid(rates, counts, slot):
    """Amounts of the fluid schedule after `slot` slots, by exact bisection over the break points."""
    at, done = Fraction(0), Fraction(0)
    left = sorted({Fraction(c, a) for a, c in zip(rates, counts)})
    for end in left:
        rate = sum(a for a, c in zip(rates, counts) if Fraction(c, a) > at)
        if done + rate * (end - at) >= slot:
            tau = at + (slot - done) / rate
            return [min(a * tau, Fraction(c)) for a, c in zip(rates, counts)]
        done, at = done + rate * (end - at), end
    return [Fraction(c) for c in counts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), min_size=1, max_size=7))
def test_every_source_stays_within_one_block(pairs):
    rates = tuple(a for a, _ in pairs)
    counts = tuple(min(a, c) for a, c in pairs)
    plan = mixing.earliest_deadline_first(rates, counts)
    assert [p[0] for p in plan] == list(range(sum(counts)))
    done = [0] * len(rates)
    for slot, release, deadline, s, k in plan:
        assert release <= slot < deadline and k == done[s]
        done[s] += 1
        assert all(abs(d - f) < 1 for d, f in zip(done, fluid(rates, counts, slot + 1)))


def rows(n=600):
    out = [(i, "a" if i % 3 else ["b", "c", None][i // 3 % 3], f"t{i}", "x") for i in range(n)]
    return out + [(5, "a", "again", "x"), (None, "a", None, "x"), (None, None, "", "x")]


def test_mix_keeps_every_row_and_the_order(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string, slot string")
    params = mixing.MixParams(weights={"a": 2.0}, block_rows=4, bucket_rows=20)
    out = mixing.mix(docs, params)
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, (r[:3] for r in rows())))
    keys = [(r.cycle, r.slot, r.offset) for r in got]
    assert keys == sorted(keys)
    blocks = {}
    for r in got:
        blocks.setdefault((r.cycle, r.slot), set()).add((r.source, r.source_block))
    assert all(len(x) == 1 for x in blocks.values())
    assert all(r.release <= r.slot < r.deadline for r in got)
    # a whole cycle gives each source its weight
    first = [s for (c, _), x in sorted(blocks.items()) if c == 0 for s, _ in x]
    assert first.count("a") == 16 and first.count("b") == 8 and first.count(None) == 8


def test_positions_against_a_schedule_made_slot_by_slot(spark):
    """Sources that run out in different cycles: an independent schedule by the definition, over all blocks at once."""
    sizes = {"a": 90, "b": 31, "c": 8, None: 3}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    params = mixing.MixParams(weights={"a": 1.5, "b": 1.0, "c": 0.5}, default_weight=0.25, blocks_per_weight=4, block_rows=3)
    rates = {"a": 6, "b": 4, "c": 2, None: 1}
    blocks = {s: -(-n // 3) for s, n in sizes.items()}
    want, cycle = [], 0
    while any(blocks[s] > cycle * rates[s] for s in sizes):
        live = [s for s in (None, "a", "b", "c") if blocks[s] > cycle * rates[s]]
        counts = [min(rates[s], blocks[s] - cycle * rates[s]) for s in live]
        of = [rates[s] for s in live]
        at = lambda k, a: sum(min(Fraction(r * k, a), Fraction(c)) for r, c in zip(of, counts))  # noqa: B023, E731
        todo = {(s, k): (at(k, of[i]) // 1, -(-at(k + 1, of[i]) // 1)) for i, s in enumerate(live) for k in range(counts[i])}
        for slot in range(len(todo)):
            ready = [x for x in todo if todo[x][0] <= slot]
            s, k = min(ready, key=lambda x: (todo[x][1], live.index(x[0]), x[1]))
            release, deadline = todo.pop((s, k))
            want.append((str(s), cycle, slot, cycle * rates[s] + k, release, deadline))
        cycle += 1
    got = mixing.positions(docs, params)
    rows = {(str(r.source), r.cycle, r.slot, r.source_block, r.release, r.deadline) for r in got.collect()}
    assert sorted(rows) == sorted(want)
    assert got.count() == sum(sizes.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0


@pytest.mark.parametrize("weights, rates", [({"a": 0.01}, {"a": 2}), ({"a": 1 / 3, "b": 0.5}, {"a": 8, "b": 12}), ({"a": Fraction(2, 7)}, {"a": 16}), ({"a": 0.5, "b": 4}, {"a": 4, "b": 32})])
def test_rates_are_in_exact_proportion(weights, rates):
    got, other = mixing.MixParams(weights=weights).rates()
    assert got == rates and all(Fraction(got[s], other) == Fraction(str(w)).limit_denominator(100) for s, w in weights.items())


@pytest.mark.parametrize("weights", [{"a": 0.0}, {"a": -1.0}, {"a": 1 / 9973, "b": 1 / 9967}])
def test_weights_that_cannot_be_kept_are_refused(weights):
    with pytest.raises(ValueError):
        mixing.MixParams(weights=weights).rates()


def test_small_weight(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "t") for i in range(1000)], "doc_id long, source string, text string")
    got = mixing.positions(docs, mixing.MixParams(weights={"a": 0.02}, block_rows=1)).where("cycle = 0").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"a": 4, "b": 200}
