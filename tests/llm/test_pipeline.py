import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from emberline.llm import mixing, queries  # noqa: E402
from tests.llm.test_jaccard import brute as components_of  # noqa: E402


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(4, 14)))
    shared = [[line() for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(120):
        lines = [line() for _ in range(rng.randrange(8, 16))]
        if i % 4 == 0:
            lines[3:3] = rng.choice(shared)
        rows.append((i * 7, "\n".join(lines), rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src1", "src9", None])))
    for i in range(12):  # near copies
        words = rows[5][1].split(" ")
        words[rng.randrange(len(words))] = "other"
        rows.append((2000 + i, " ".join(words), "en", "src0"))
    words = [word() for _ in range(90)]
    for i in range(9):  # near copies without a line in common
        rows.append((2500 + i, " ".join([*words[:40], f"w{i}", *words[40:]]), "de", "src1"))
    rows += [(3000 + i, rows[8][1], "en", "src0") for i in range(5)]
    rows += [(4000, None, "en", "src1"), (4001, "", None, None), (4002, "#$% " * 80, "en", "src0"), (4003, "short", "en", "src1")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeated_runs(rows):
    """Line dedup by its definition, over whole texts in memory."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    chunks = {}
    for doc, text in rows:
        lines = text.split("\n")
        out, now, before = [], [], ""
        for x in lines:
            now.append(x)
            h = md5(x)
            if md5(before + h)[0] in "01234567":
                out.append(now)
                now = []
            before = h
        chunks[doc] = out + ([now] if now else [])
    worded = lambda c: sum(bool(WORD.search(x)) for x in c)
    first = {}
    for doc in sorted(chunks):
        for k, c in enumerate(chunks[doc]):
            first.setdefault("\n".join(c), (doc, k))
    left = {}
    for doc, cs in chunks.items():
        gone, run = set(), []
        for k, c in [*((k, c) for k, c in enumerate(cs) if worded(c)), (None, None)]:
            if c is not None and first["\n".join(c)] != (doc, k):
                run.append(k)
                continue
            if sum(worded(cs[i]) for i in run) >= 2 or sum(len(WORD.findall("\n".join(cs[i]))) for i in run) > 50:
                gone.update(run)
            run = []
        left[doc] = "\n".join("\n".join(c) for k, c in enumerate(cs) if k not in gone)
    return left


def test_run_against_brute_force(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in db.sql(f"select doc_id from ({queries.ORACLE_SQL['op10_quality_rules']}) where kept").fetchall()}
    assert 4002 not in kept and len(kept) > 120
    texts = without_repeated_runs([(r[0], r[1]) for r in rows if r[0] in kept])
    assert any(texts[r[0]] != r[1] for r in rows if r[0] in kept)
    one = {d for d, _, c in components_of(list(texts.items())) if d == c}
    assert len(one) < len(texts)
    lines = map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    want = []
    for doc, _, lang, source, _ in rows:
        if doc in one:
            ids = encoding.encode_ordinary(texts[doc])
            want.append((doc, lang, source, len(texts[doc]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[doc].encode()).hexdigest(), ids))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [(r.doc_id, r.lang, r.source, r.n_chars, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.token_ids)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    places = [(r.cycle, r.slot, r.offset) for r in rows]
    assert places == sorted(places)


def test_mixing_orders_the_written_files(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    place = {r.doc_id: (r.cycle, r.slot, r.offset) for r in mixing.positions(docs, queries.MIX).collect()}
    order = [place[r.doc_id] for r in out.collect()]
    assert order == sorted(order) and len(order) == len(rows)


def stages(spark, docs, sf_dir, folder):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/{i}")
        if i < 4:
            assert sorted(docs.columns) == sorted(before.columns)
    return docs


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: "\n".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(4)) for _ in range(10)) for _ in range(n))
    long_one, some = text(2000), text(20)
    rows = [(1, long_one), (2, None), (3, ""), (4, some), (4, some), (None, text(9)), (None, None), (5, text(12)), (5, text(12))]
    named = [(i, t, "en", ["src0", None][k % 2], 0, f"a{k}", "b", "c", "d", "e", "f") for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string, cycle string, n_lines string, n_words string, kept string, component_id string"
    out = stages(spark, spark.createDataFrame(named, schema), "", tmp_path).collect()
    ids = sorted(str(r.doc_id) for r in out)
    assert ids == ["1", "4", "5", "5", "None"]
    assert all((r.n_lines, r.n_words, r.kept, r.component_id) == ("c", "d", "e", "f") for r in out)
    assert next(r for r in out if r.doc_id == 1).decoded_sha256 == hashlib.sha256(long_one.encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stages(spark, docs, "", tmp_path).count() == 0


def test_filters_never_split_texts(spark):
    """A filter pushed below the measures would build each text's arrays over and over."""
    from emberline.llm import quality

    docs = spark.createDataFrame([(1, "a b " * 20_000, "en", "x")], "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs)
    plan = quality.sketch(measured)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split" in x]
    assert quality.sketch(measured).collect() == []  # half of its words repeat


def test_a_run_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(fixture()[:20], schema).write.parquet(f"{tmp_path}/documents.parquet")
    calls = []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError(name)
            return docs

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", fails=True)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.corpus(spark, str(tmp_path), "one")
    assert corpus_pipeline.corpus(spark, str(tmp_path), "one").count() == 20
    assert calls == ["a", "b", "c", "c"]
