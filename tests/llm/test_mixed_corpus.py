"""The order of the mix and the token ids in the result of the whole pipeline."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from emberline.llm import mixing, queries  # noqa: E402
from tests.llm.test_pipeline import fixture  # noqa: E402


def test_run_comes_in_the_order_of_the_mix_and_the_corpus_holds_ids(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(fixture(), schema).write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    whole = corpus_pipeline.corpus
    monkeypatch.setattr(corpus_pipeline, "corpus", lambda *a: made.append(whole(*a)) or made[-1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = made[0].collect()
    place = {(r.source, r.doc_id): (r.cycle, r.slot, r.offset) for r in mixing.positions(spark.createDataFrame(got), queries.MIX).collect()}
    assert len(place) == len(got) == len(rows) > 60
    order = [place[r.source, r.doc_id] for r in got]
    assert order == sorted(order) and [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    for r in rows:
        assert (r.cycle, r.slot, r.offset) == place[r.source, r.doc_id] and len(r.token_ids) == r.n_tokens
        assert hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest() == r.ids_sha256
