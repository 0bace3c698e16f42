import base64
import hashlib
import random
import time

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from emberline.llm import bpe, queries  # noqa: E402


def texts():
    random.seed(1)
    rows = [(-1, None), (-2, ""), (-3, " " * 500 + "x"), (-4, "ab" * 3000), (-5, "it's 12345   \n\n\t don't 日本語 🎉🎉 naïve")]
    rows += [(i, "".join(random.choice("etaoin shrdlu'\n1é") for _ in range(random.randrange(400)))) for i in range(60)]
    return rows + [(7, "again"), (7, "again"), (-9, "".join(random.choice("etaoinshr") for _ in range(900)))]


def test_as_the_library_encodes(spark):
    lines = map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    rows = [(*r, 1) for r in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.encode_decode(docs, queries.bpe_params(), keep_ids=True).collect()
    want = []
    for i, text, _ in rows:
        ids = encoding.encode_ordinary(text or "")
        raw = (text or "").encode()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids, raw))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.token_ids), bytes(r.decoded)) for r in out]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("long_piece", [2, 10_000])
def test_both_recursions_as_the_library(long_piece):
    """Each piece of up to some hundred bytes through either recursion, and long ones through that for them."""
    params = queries.bpe_params()
    codec = bpe.Codec(bpe.BpeParams(params.ranks, params.pattern, long_piece=long_piece))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(4)
    letters = ["etaoinshr", "ab", "a", "thein", "éüß日本語"]
    pieces = {"".join(random.choice(random.choice(letters)) for _ in range(random.randrange(1, 60))) for _ in range(400)}
    if long_piece == 2:
        pieces |= {"".join(random.choice("etaoinshr") for _ in range(6000)), "ab" * 3000, "a" * 5001}
    codec.learn(pieces)
    for p in pieces:
        assert np.frombuffer(codec.ids[p], "<u4").tolist() == encoding._encode_single_piece(p), p


@pytest.mark.parametrize("window", [1, 3, 64])
def test_windows_are_stitched(window):
    """Seams that fail, next to one another and in text that repeats itself, and seams within a character."""
    params = queries.bpe_params()
    codec = bpe.Codec(bpe.BpeParams(params.ranks, params.pattern, long_piece=20, window=window))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(window)
    parts = [list("etaoinshrdlucmfw"), ["the", "in", "ation", "x"], list("ACGT"), list("éüß日本語naive"), list("ab"), ["a"], ["abcab"]]
    pieces = {"".join(random.choices(p, k=random.randrange(1, 2000))) for p in parts for _ in range(6)}
    codec.learn(pieces)
    for p in pieces:
        ids = codec.ids[p]
        assert np.frombuffer(ids, "<u4").tolist() == encoding._encode_single_piece(p), p
        assert codec.decoded[ids] == p.encode()


def test_a_megabyte_without_a_blank():
    codec = bpe.Codec(queries.bpe_params())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(5)
    piece = "".join(random.choices("etaoinshrdlucmfw", k=1_000_000))
    start = time.monotonic()
    codec.learn({piece})
    assert time.monotonic() - start < 60
    assert np.frombuffer(codec.ids[piece], "<u4").tolist() == encoding._encode_single_piece(piece)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), queries.bpe_params()).count() == 0
