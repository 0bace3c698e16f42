import pytest

from emberline.operators.bursts import fold
from emberline.plans.ir import Entity, Plan, PlanError, parse

SHIP = Entity("attacker", "type")


@pytest.mark.parametrize(
    "plan",
    [
        Plan("top_n"),
        Plan("trend"),
        Plan("top_n", subject=SHIP, filters=(Entity("victim", "segment"),)),
        Plan("top_n", subject=SHIP, limit=0),
        Plan("top_n", subject=SHIP, limit=-1),
        Plan("top_n", subject=SHIP, limit=1001),
        Plan("dance"),
        Plan("count", version="2"),
    ],
)
def test_refused(plan):
    with pytest.raises(PlanError):
        plan.checked()


def test_defaults_and_round_trip():
    assert Plan("top_n", subject=SHIP).checked().group_by == SHIP
    assert Plan("count", "sum_isk").checked().metric == "count"
    p = Plan("top_n", subject=SHIP, filters=(Entity("victim", "alliance", "in", [1, 2]), Entity("victim", "segment", "ne", "X")))
    assert Plan.from_json(p.to_json()) == p and Plan.from_json(p.to_json()).key() == p.key()


@pytest.mark.parametrize("text, intent", [("Top 3 ships?", "top_n"), ("how many kills in the last 2 days", "count"), ("path from 1 to 2", "path"), ("neighbors of 4", "neighbors"), ("why", None)])
def test_questions(text, intent):
    p = parse(text)
    assert (p and p.intent) == intent


def test_burst_window_restarts_and_cools_down():
    rows = [(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "b"), (5, "c"), (60, "a"), (61, "b"), (62, "c")]
    whole, _ = fold([t for t, _ in rows], [a for _, a in rows], ([], None), 10, 3, 3, 30)
    assert whole == [(2, 3, 3), (62, 3, 3)]
    first, state = fold([t for t, _ in rows[:4]], [a for _, a in rows[:4]], ([], None), 10, 3, 3, 30)
    second, _ = fold([t for t, _ in rows[4:]], [a for _, a in rows[4:]], state, 10, 3, 3, 30)
    assert first + second == whole
