import hashlib
import random

import numpy as np
import pytest

from emberline.llm import suffix_dedup as sd


def brute(rows, window):
    least: dict[bytes, int] = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if doc is None:
            continue
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if doc is not None:
            for i in range(len(raw) - window + 1):
                if least[raw[i : i + window]] < doc:
                    gone[i : i + window] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioutnsrhld") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(6, 60)) for _ in range(6)]
    base = prose(200)
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            parts += [p[a:b] if rng.random() < 0.7 else p, prose(rng.randrange(0, 12))]
        rows.append((i * 3 % 61, " ".join(parts), 1))
    for i in range(25):  # near copies
        words = base.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words), 1))
    same = prose(40)
    rows += [(200 + i, same, 1) for i in range(6)]
    rows += [(300, None, 1), (301, "", 1), (302, "ab" * 200, 1), (303, "ab" * 120, 1), (304, "x" * 49, 1), (305, "x" * 49, 1)]
    rows += [(306, passages[0] + "\0\0" + passages[1], 1), (307, "é" * 90 + passages[2], 1), (308, "é" * 70, 1)]
    rows += [(None, base, 1), rows[3], (rows[4][0], base, 1), (-5, base[100:400], 1)]
    return rows


@pytest.mark.parametrize("seed, per_partition", [(1, 150_000), (2, 40), (3, 7)])
def test_against_brute_force(spark, seed, per_partition):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3)
    params = sd.SuffixParams(partition_rows=per_partition)
    out = sd.suffix_dedup(docs, params, keep_text=True).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == [r[:5] for r in brute(rows, params.window)]


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    last = rng.integers(0, 50, 500)
    order = sd.multikey_quicksort(tokens, last)
    assert [(*tokens[i], last[i]) for i in order] == sorted((*t, x) for t, x in zip(tokens, last))


def test_many_texts_under_one_id(spark):
    """Rows that repeat an id are told apart by their whole texts."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("aeioutns") for _ in range(5)) for _ in range(n))
    shared = prose(30)
    rows = [(9, f"{prose(4)} {shared} {i}", 1) for i in range(400)] + [(1, shared, 1), (9, prose(20), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int")
    out = sd.suffix_dedup(docs).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == [r[:5] for r in brute(rows, 50)]


def test_very_long_text(spark):
    rng = random.Random(7)
    long_one = " ".join("".join(rng.choice("aeioutns") for _ in range(6)) for _ in range(60_000))
    rows = [(1, long_one[1000:3000], 1), (2, long_one, 1), (3, long_one[:200_000] + "x" + long_one[200_000:], 1)]
    out = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == [r[:5] for r in brute(rows, 50)]
