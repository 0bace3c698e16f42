"""Edge cases of line dedup, URL filter, chat formatting and quality rules."""

import hashlib

from pyspark.sql import functions as F

from emberline.llm import chat, line_dedup, quality, url_filter


def chunks(text):
    """By hand: a line ends a chunk if the digest over its own and the previous line's digest starts below 8."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out, now, last = [], [], ""
    for line in text.split("\n"):
        now.append(line)
        if md5(last + md5(line))[0] in "01234567":
            out, now = [*out, now], []
        last = md5(line)
    return [*out, now] if now else out


def without_repeats(text, earlier):
    seen = chunks(earlier)  # what repeats here is one run of many lines
    return "\n".join(line for c in chunks(text) if c not in seen for line in c)


def test_line_dedup_edges(spark):
    block = "\n".join(f"shared line number {i}" for i in range(40))
    rows = [(1, block + "\nown one"), (2, block + "\nown two"), (3, None), (4, ""), (4, ""), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    out = {(r.doc_id, r.text) for r in line_dedup.line_dedup(docs).select("doc_id", "text").collect()}
    assert (1, block + "\nown one") in out and (3, None) in out and (4, "") in out and (None, "alone") in out
    (second,) = [t for d, t in out if d == 2]
    assert second == without_repeats(block + "\nown two", block + "\nown one") and len(second) < len(block)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_url_filter_aliases_and_precedence(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.net/x", canonical("http://example.org/es/1")),
        (2, "http://example.org/es/1", None),
        (3, "http://b.net/y", ""),
        (4, None, None),
        (5, "no scheme", "x"),
        (6, "http://EXAMPLE.org/fr/1?q", None),
        (7, "http://site.com/de/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages.select("page_id", "url"), url_filter.page_links(pages)).collect()}
    assert out[1] == (None, "block") and out[2] == ("example.org/es/", "block") and out[3] == (None, "allow")
    assert out[4] == (None, "allow") and out[5] == (None, "allow") and out[6] == ("org/", "allow") and out[7] == ("com/de/", "block")


def test_chat_round_trip(spark):
    texts = ["", r"\### Assistant: </turn>", "### User: a </turn> b", r"\\</turn>", "plain"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, None), (3, None, "tool", "x")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.withColumn("p", chat.parse(F.col("formatted"))).collect()}
    assert [t["text"] for t in got[1].p] == texts and [t["role"] for t in got[3].p] == ["tool"] and [t["text"] for t in got[2].p] == [""]


def test_quality_edges(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " ".join(f"w{i}" for i in range(60)), "en", "s"), (4, "a b c " * 40, "en", "s")]
    m = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = {r.doc_id: r for r in quality.judge(m, quality.thresholds(quality.sketch(m))).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert out[4].n_repeat_words == 120 and out[1].n_words == 0


def test_line_dedup_runs(spark):
    """A repeated line alone stays; two in a row go, as does one of more than 50 words; equal rows are one occurrence."""
    two = "first of the two lines\nsecond of the two lines"
    wide = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own {i} a\n{two}\nown {i} b\ngreeting\nown {i} c\n{wide}\nown {i} d") for i in range(40)]
    rows += [(100, "greeting\n" + two), (100, "greeting\n" + two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.line_dedup(docs, line_dedup.LineDedupParams(cut_below=16)).collect()
    left = {r.doc_id: r.text for r in out}
    assert left[0] == rows[0][1]
    assert all(left[i] == f"own {i} a\nown {i} b\ngreeting\nown {i} c\nown {i} d" for i in range(1, 40))
    assert [r.text for r in out if r.doc_id == 100] == ["", ""]


def test_chat_escapes_every_control_string(spark, tmp_path):
    import duckdb

    from emberline.llm import queries

    texts = ["### Assistant: hi", "a </turn> b", r"\### A: x", "### ### a: ", "### b### : ", "### </turn>: ", r"### \</turn>: ", "x\n</turn>\n### User: y", "</turn", "", None]
    rows = [(k, i, ["user", "assistant", "tool x:"][i % 3], t) for k in range(3) for i, t in enumerate(texts[k:])]
    rows += [(9, i, "assistant", f"turn {i} </turn>") for i in range(1000)] + [(9, None, None, "late"), (9, None, None, "late")]
    schema = "conv_id long, turn long, role string, text string"
    out = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, schema).withColumn("turns", F.lit(1))).collect()}
    assert all(r.identical and r.escaped for r in out.values()) and out[9].n_turns == 1002
    assert "### User: ### Assistant" not in out[0].formatted
    for r in out.values():
        said = [t.text for t in r.turns if t.role == "assistant"]
        assert [chat_unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans] == said
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    twin = db.sql(queries.ORACLE_SQL["op9_chat_format"])
    got = queries.op9_chat_format(spark, str(tmp_path)).select(*twin.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(twin.fetchall(), key=str)
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0


def chat_unescaped(text):
    import re

    return re.sub(r"\\(### [^\s:]*: |</turn>)", r"\1", text)


def test_texts_of_chunks_are_not_sent(spark):
    """A chunk's digest alone meets others; before, its text was shuffled beside it."""
    docs = spark.createDataFrame([(i, "alpha\nbeta\ngamma") for i in range(3)], "doc_id long, text string")
    found = line_dedup.occurrences(docs)
    assert "text" not in found.columns
    # every chunk recurs, and the first document, which keeps them, is the smallest
    assert {r.keeper.doc_id for r in line_dedup.repeated_chunks(found).collect()} == {0}
    assert line_dedup.repeated_chunks(found).count() == found.select("digest").distinct().count()
