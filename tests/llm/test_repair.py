import hashlib
import itertools
import random
import re
import zlib

from emberline.llm import repair as R
from emberline.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """All the fields of one conversation, by trying every edit sequence in order of cost and audit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    best = None

    def walk(i, out, audit, cost, inserts):
        nonlocal best
        if cost > (best[0] if best else 3 * len(rows)):  # deleting all is a repair
            return
        if i == len(rows) and LEGAL.fullmatch("".join(r[:1] for r, _ in out)) and all(r[:1] for r, _ in out):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, list(out))
        if inserts < 2:
            for role in ("user", "assistant"):
                walk(i, out + [(role, "")], audit + "I", cost + 2, inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            late = faults[i] == "truncated"
            walk(i + 1, out, audit + "D", cost + 3, 0)
            if faults[i] not in ("blank", "duplicate"):
                walk(i + 1, out + [(role, text)], audit + "K", cost + late, 0)
                for new in ("user", "assistant"):
                    walk(i + 1, out + [(new, text)], audit + "R", cost + 2 + late, 0)

    walk(0, [], "", 0, 0)
    cost, audit, out = best
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def fields(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_against_every_edit_sequence(spark):
    rng = random.Random(2)
    texts = ["Yes.", "no", "", " \t", "So?", "and"]
    convs = {}
    for c in range(250):
        turn = rng.randrange(3)
        rows = []
        for _ in range(rng.randrange(1, 5)):
            rows.append((rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 3])
        convs[c] = rows
    df = spark.createDataFrame([(c, *r, 1, "x") for c, rows in convs.items() for r in rows], "conv_id long, turn int, role string, text string, copies int, gaps string")
    got = {r.conv_id: fields(r) for r in R.repair_conversations(df).collect()}
    assert got == {c: brute(rows) for c, rows in convs.items()}


def plain(codes):
    """(cost, audit) by dynamic programming from the end, audits and all."""
    table = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for code in reversed(codes):
        now = [min((c + table[a][0], e + table[a][1]) for c, e, a in R._edits(code, s)) for s in range(4)]
        for _ in range(2):
            now = [min([now[s], *((2 + now[t][0], "I" + now[t][1]) for t in R.FOLLOWS[s] if t in R.ROLES)]) for s in range(4)]
        table = now
    return table[0]


def test_windows_and_search_agree_with_dynamic_programming():
    rng = random.Random(7)
    for n, window in itertools.product([0, 1, 2, 5, 17, 60], [1, 2, 3, 7, 2048]):
        for _ in range(20):
            codes = bytes(rng.choice([0, 1, 2, 2, 3, 3, 5, 6, 7, 9, 10, 11]) for _ in range(n))
            assert R.repair(codes, window) == plain(codes)


def test_long_conversation():
    codes = bytes([1] + [2, 3, 2, 2 + 4, 3, 3 + 8] * 20_000)
    cost, audit = R.repair(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost == 20_000 * (1 + 3 + 2)


def damaged(rows):
    out = {}
    for c, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
        text, role = say(text), say(role)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(c, [])
        out[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice(["Hi.", "what", "Oh!", None])) for c in range(600) for t in range(rng.randrange(1, 4))]
    rows += [(None, None, None, "a."), (None, 1, "assistant", None), (5000, None, "user", "x" * 200_000 + "."), (5000, 2, "assistant", "ok.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: fields(r) for r in QUERIES["op12_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: brute(r) for c, r in damaged(rows).items()}
    assert any(not r for r in damaged(rows).values())  # some lost all rows


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_repair"](spark, str(tmp_path)).collect() == []


def test_one_message_repeated(spark):
    rows = [(1, 0, "user", "Hi.", 1)] + [(1, t, "assistant", "Yes.", 1) for t in range(1, 3000)] + [(1, 7, "assistant", "Yes.", 1)]
    got = R.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")).collect()
    assert [(r.duplicate, r.cost, r.repaired_turns) for r in got] == [(2999, 3 * 2999, 2)]
