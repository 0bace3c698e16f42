import random
import re

import numpy as np
import pytest

from emberline.llm import _bytes, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa Lam mu nu xi pi rho é ß".split()) + str(rng.randrange(9))
    rows = []
    passage = [word() for _ in range(50)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = word()
        return words

    for g in range(12):
        base = [word() for _ in range(rng.randrange(5, 160))]
        rows += [(len(rows) * 7 % 1009, " ".join(edited(base, rng.randrange(4))), 0) for _ in range(rng.randrange(1, 9))]
    base = [word() for _ in range(120)]
    rows += [(2000 + i, " ".join(edited(base, rng.randrange(6))), 0) for i in range(90)]
    rows += [(3000 + i, " ".join(passage + [word() for _ in range(rng.randrange(0, 40))]), 0) for i in range(70)]
    rows += [(4000 + i, "the same TEXT again and again here" + " " * i, 0) for i in range(9)]
    rows += [(5000, None, 0), (5001, "", 0), (5002, " \t\n", 0), (5003, "two words", 0), (5004, "Two\nwords", 0), (5005, "two words more", 0)]
    rows += [(5006, "a b c d e f g h", 0), (5007, "a b c d e f g h i", 0), (5008, "a b c d e", 0), (5009, "x\x0ba b\x1cc d", 0)]
    rows += [(None, rows[3][1], 0), rows[5], (rows[6][0], rows[40][1], 0)]
    rng.shuffle(rows)
    return rows


VARIANTS = [
    jaccard.JaccardParams(),
    jaccard.JaccardParams(heavy_least=3, frequent=40, frequent_least=3, short_list=4, list_rows=10),
    jaccard.JaccardParams(heavy_least=3, short_list=1, broadcast_ids=0, block_rows=8, orders=1, steps=2),
    jaccard.JaccardParams(heavy_least=3, short_list=2, block_rows=16, orders=0, steps=1),
]


@pytest.mark.parametrize("seed, params", list(enumerate(VARIANTS)))
def test_against_brute_force(spark, seed, params):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, params).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    comps = {d: c for d, _, c in brute(rows) if d is not None}
    got = [(r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None]
    # an id that repeats with another text is one document, of which each text stays once
    assert len(got) == len(set(got)) and {d for d, _ in got} == set(comps.values())
    assert set(got) == {(d, t) for d, t, _ in rows if d is not None and comps[d] == d}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(60)]
    told = jaccard._Parities([jaccard._parity(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (told.differ(i, j) <= real).all() and (told.differ(i, j) > 0).any()


def test_a_long_passage_in_documents_that_differ(spark):
    rng = random.Random(8)
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passage = fresh(300)
    rows = [(i, " ".join(fresh(rng.randrange(20, 45)) + passage + fresh(rng.randrange(20, 45)))) for i in range(150)]
    rows += [(1000 + i, " ".join(fresh(3) + passage + fresh(rng.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    params = jaccard.JaccardParams(heavy_least=3, frequent=1000, frequent_least=1000)
    for p in (params, jaccard.JaccardParams(heavy_least=3, frequent=10, frequent_least=5, list_rows=40, block_rows=20)):
        assert sorted((tuple(r) for r in jaccard.jaccard_components(docs, p).collect()), key=str) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(60_000)]
    other = [w if i % 50 else "x" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "quite another text stands here now", "y"), (2, "a b c d e f g", "z"), (1, "a b c d e f g", "x")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __n string"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(set(rows[:2]))


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_differ_by_structure_alone(spark):
    """Thue-Morse words and their complements, which hashes by powers modulo 2^64 can't tell apart."""
    rows = []
    for k in (10, 11, 12):
        word = "a"
        for _ in range(k):
            word += word.translate(str.maketrans("ab", "ba"))
        rows += [(2 * k, word), (2 * k + 1, word.translate(str.maketrans("ab", "ba")))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}


def test_blanks_and_case_of_bytes():
    one, two, three = _bytes.shingles(["A\x0bb\x0c\tÉ D e".encode(), "a b É d E".encode(), "a b é d e".encode()])
    assert one.tolist() == two.tolist() != three.tolist()
    assert [len(x) for x in _bytes.shingles([b"", b" \n", "a\u00a0b\u2003c".encode(), b"a b c d e f"])] == [0, 0, 1, 2]
