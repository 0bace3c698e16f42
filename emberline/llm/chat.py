"""Chat formatting with a grammar round trip.

A conversation is rendered as turns `### <role>: <text>` closed by a line `</turn>`. The rendered text is parsed again
by a deterministic parser and the recovered turns are compared with the source. A conversation whose turns do not come
back as they went in, or that holds a control string inside a text, gets those strings escaped with a backslash, is
rendered again and parsed again; escaping is reversible, so that settles it, and the last comparison is told for every
conversation (identical).
The loss mask holds the spans of the assistant's texts in the formatted string.

Grammar: a conversation splits at "\\n</turn>\\n"; each piece is "### ", a role without blank or colon, ": ", the text.
Inside a text, a backslash before a control string is an escape and drops off.

Defined cases: null text and null role count as empty strings; a null conv_id is a conversation of its own; turns sort
by (turn, role, text) with nulls first, so ties and repeated rows keep a fixed order; an empty table gives an empty
result; columns other than conv_id, turn, role and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
CONTROL = r"(### [^\s:]*: |</turn>)"
CLOSE = "\n</turn>\n"
#: Turns whose lengths are added up at a time.
BLOCK = 256
_NAMED = {"user": "User", "assistant": "Assistant", "system": "System"}


def _role_out(role: Column) -> Column:
    """The three usual roles have names; any other is written as @ and its URL encoding, which has no blank or colon."""
    out = F.concat(F.lit("@"), F.url_encode(role))
    for plain, named in _NAMED.items():
        out = F.when(role == plain, F.lit(named)).otherwise(out)
    return out


def _role_in(name: Column) -> Column:
    out = F.url_decode(F.substring(name, 2, 1 << 30))
    for plain, named in _NAMED.items():
        out = F.when(name == named, F.lit(plain)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\" + CONTROL), F.lit("$1"))


def _render(turns: Column, body) -> Column:
    piece = lambda t: F.concat(F.lit("### "), _role_out(t["role"]), F.lit(": "), body(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, piece), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, raw, text>>: the turns of a formatted conversation, raw as they stand in it."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda p: F.regexp_extract(p, r"^### ([^\s:]*): ", 1)

    def turn(p: Column) -> Column:
        raw = F.substr(p, F.length(head(p)) + F.lit(7))
        return F.struct(_role_in(head(p)).alias("role"), raw.alias("raw"), unescape(raw).alias("text"))

    return F.transform(pieces, turn)


def _same(parsed: Column, turns: Column) -> Column:
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"], t["text"]))
    return plain(parsed) == plain(turns)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, turns (recovered from formatted), loss_spans, escaped, identical: one row per conversation.

    loss_spans are array<struct<start, end>>, code points from 0, end exclusive, of the assistant's texts as they stand
    in formatted.
    """
    grouped = (
        conversations.select(
            "conv_id",
            F.struct(
                "turn",
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("source"))
    )
    plain = grouped.withColumn("formatted", _render(F.col("source"), lambda t: t)).withColumn(
        "turns", parse(F.col("formatted"))
    )
    holds = F.exists("source", lambda t: t["text"].rlike(CONTROL))
    told = plain.withColumn("escaped", holds | ~_same(F.col("turns"), F.col("source")))
    again = told.withColumn(
        "formatted", F.when(F.col("escaped"), _render(F.col("source"), escape)).otherwise(F.col("formatted"))
    ).withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("turns")))
    sure = again.withColumn("identical", _same(F.col("turns"), F.col("source")))
    # lengths of what stands before each text, then running sums: in steps of BLOCK turns, and inside these
    head = lambda t: F.length(_role_out(t["role"])) + F.lit(6)
    size = lambda t: head(t) + F.length(t["raw"]) + F.lit(len(CLOSE))
    sure = sure.withColumn("__sizes", F.transform("turns", size))
    blocks = F.expr(
        f"transform(sequence(0, (size(__sizes) - 1) div {BLOCK}),"
        f" b -> aggregate(slice(__sizes, b * {BLOCK} + 1, {BLOCK}), 0L, (n, x) -> n + x))"
    )
    sure = sure.withColumn("__blocks", blocks).withColumn(
        "__before", F.expr("aggregate(__blocks, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x))")
    )
    starts = F.expr(
        f"transform(__sizes, (x, i) -> __before[i div {BLOCK}]"
        f" + aggregate(slice(__sizes, i - i % {BLOCK} + 1, i % {BLOCK}), 0L, (n, y) -> n + y))"
    )
    spans = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            t["role"].alias("role"),
            (F.get("__starts", i) + head(t)).alias("start"),
            (F.get("__starts", i) + head(t) + F.length(t["raw"])).alias("end"),
        ),
    )
    return (
        sure.withColumn("__starts", starts)
        .withColumn("__spans", spans)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "formatted",
            F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
            F.transform(
                F.filter("__spans", lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"], s["end"])
            ).alias("loss_spans"),
            "escaped",
            "identical",
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, read from the formatted string by its spans."""
    cut = lambda s: unescape(F.substr(formatted, s["start"] + F.lit(1), s["end"] - s["start"]))
    return F.array_join(F.transform(spans, cut), "")
