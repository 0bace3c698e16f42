"""Personal data, and the words that give it away: information-theoretic sanitisation with built-in functions alone.

Values (email, IP address, card, phone) are found by pattern, leftmost and without overlap per kind; those that fail
their check are dropped. Each value is an entity to protect. The corpus then tells how strongly a word reveals one:

1. Around each value, up to the next one of its kind and `reach` code points at most, every word counts as seen with it.
2. A word's surprise about an entity is what is left to learn of it: log2 of the word's occurrences in the corpus over
   those beside the entity, which is the entity's information content less their pointwise mutual information.
3. A word is generalised where at most `generalise_bits` are left, removed where at most `remove_bits` are, if the mutual
   information is `least_bits` at least (a value that is nearly everywhere is not revealed by anything) and the evidence
   is independent: `support` different texts at least, and no pair of neighbouring words in more than one of `support` of
   them, so that copies and near copies of one text prove nothing.

Words are runs free of blanks, without punctuation around them and A-Z in lower case, of three letters or more. Words
inside a value found stay with it. Spans are code points, end exclusive.

No text is shuffled: groupings carry words and digests, with counts added up before they are dealt. Words to look for are
broadcast only up to `broadcast_words`, beyond that the corpus is counted by word first.

Defined cases: null text has no spans and stays null; texts of any length are searched whole, with patterns that don't
backtrack over long runs; equal texts get equal spans, whatever their rows; a table without values, or an empty one,
has no terms to hide; other columns are carried as they are, also if they are called like the added ones (which then
replace them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, lower_ascii, materialise, salted_join

#: Fixed patterns of the kinds, in order; possessive and anchored at run starts, which changes no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these holds no value of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM = r"^\p{L}[\p{L}\p{M}'-]{2,}$"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Elements whose running sum or maximum is taken at a time.
BLOCK = 256
#: Code points in which a text is laid out to cut pieces from it, as finding a place in a text is a walk from its start.
CHUNK = 4096


@dataclass(frozen=True)
class PiiParams:
    #: code points on either side of a value in which words count as seen with it
    reach: int = 200
    support: int = 3
    generalise_bits: float = 1.0
    remove_bits: float = 0.25
    least_bits: float = 4.0
    #: words, and spans, broadcast at most
    broadcast_words: int = 100_000
    broadcast_spans: int = 500_000


def _before(values: str, op: str) -> Column:
    """For each element of an array column, the sum (or with greatest the maximum) of those before it; 0 at first."""
    add = {"sum": "n + x", "greatest": "greatest(n, x)"}[op]
    last = {"sum": "element_at(a, -1) + x", "greatest": "greatest(element_at(a, -1), x)"}[op]
    both = {"sum": "{0} + {1}", "greatest": "greatest({0}, {1})"}[op]
    blocks = f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> aggregate(slice({values}, b * {BLOCK} + 1, {BLOCK}), 0L, (n, x) -> {add}))"
    heads = f"aggregate({blocks}, array(0L), (a, x) -> array_append(a, {last}))"
    inner = f"aggregate(slice({values}, i - i % {BLOCK} + 1, i % {BLOCK}), 0L, (n, x) -> {add})"
    each = f"transform({values}, (v, i) -> {both.format(f'h[i div {BLOCK}]', inner)})"
    return F.expr(f"transform(array({heads}), h -> {each})[0]")


def _luhn(digits: Column) -> Column:
    value = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: value(F.coalesce(d.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """How a value is compared: without case or separators."""
    if kind in ("card", "phone"):
        return F.regexp_replace(value, "[^0-9]", "")
    return lower_ascii(value)


def _pieces(df: DataFrame, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """df with __p_name: array<struct<value, start, left, right>>, the matches of pattern in text and the texts around them."""
    m, g, z = f"__m_{name}", f"__g_{name}", f"__z_{name}"
    there = F.lit(True) if needs is None else F.col("text").rlike(needs)
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(none))
    left, right = F.slice(g, F.lit(1), F.size(m)), F.slice(g, F.lit(2), F.size(m))
    # a match stands behind its gap and all gaps and matches before that
    df = df.withColumn(z, F.zip_with(left, m, lambda a, v: (F.length(a) + F.length(v)).cast("long")))
    starts = F.zip_with(_before(z, "sum"), left, lambda s, a: s + F.length(a))
    # columns stay outside of lambda functions, or they could be computed anew for each element
    whole = F.arrays_zip(F.col(m).alias("value"), starts.alias("start"), left.alias("left"), right.alias("right"))
    empty = F.array().cast("array<struct<value:string,start:bigint,left:string,right:string>>")
    # a filter further up must not be pushed below this: it would copy the expressions into one another, lambdas and all
    stays = F.monotonically_increasing_id() >= 0
    return df.withColumn(f"__p_{name}", F.when(stays & (F.size(m) > 0), whole).otherwise(empty))


def _held(kind: str) -> Column:
    """The matches of a kind that pass its check, out of the column that _pieces adds."""

    def span(p: Column) -> Column:
        start, end = p["start"], p["start"] + F.length(p["value"])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["value"].alias("value"), p["left"].alias("left"), p["right"].alias("right"))

    return F.transform(F.filter(f"__p_{kind}", lambda p: _holds(kind, p["value"])), span)


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def find_values(docs: DataFrame) -> DataFrame:
    """docs with __values: array<struct<kind, start, end, value, left, right>>, by kind and start; empty for null text.

    left and right are the texts up to the next matches of the kind.
    """
    out = docs
    for kind, pattern in PATTERNS.items():
        out = _pieces(out, kind, pattern, NEEDS[kind]).withColumn(f"__v_{kind}", _held(kind))
    values = F.concat(*[F.coalesce(F.col(f"__v_{k}"), F.array().cast(out.schema["__v_email"].dataType)) for k in PATTERNS])
    return out.select(*docs.columns, values.alias("__values"))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: lower_ascii(F.regexp_replace(w, EDGES, "")))


def _seen_with(docs: DataFrame, params: PiiParams) -> DataFrame:
    """(kind, value, term, before, after, rows): each word beside a value of a distinct text, and how many rows have it."""
    reach = params.reach
    near = F.transform(
        "__values",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            F.coalesce(*[F.when(s["kind"] == k, _entity(k, s["value"])) for k in PATTERNS]).alias("value"),
            # the word at the edge may be cut off
            F.when(F.length(s["left"]) > reach, F.regexp_replace(F.right(s["left"], F.lit(reach)), f"^{WORD}", "")).otherwise(s["left"]).alias("left"),
            F.when(F.length(s["right"]) > reach, F.regexp_replace(F.left(s["right"], F.lit(reach)), WORD + r"\z", "")).otherwise(s["right"]).alias("right"),
        ),
    )
    texts = docs.where(F.size("__values") > 0).select(F.sha2("text", 256).alias("digest"), near.alias("near"))
    texts = texts.groupBy("digest").agg(F.first("near").alias("near"), F.count(F.lit(1)).alias("rows"))
    each = texts.select("rows", F.explode("near").alias("v")).select(
        "rows", "v.kind", "v.value", F.concat(F.array(F.lit("^")), _words(F.col("v.left")), F.array(F.lit("@")), _words(F.col("v.right")), F.array(F.lit("$"))).alias("w")
    )
    at = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("term"), F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after")))
    return each.select("rows", "kind", "value", F.explode(at).alias("t")).select("rows", "kind", "value", "t.*").where(F.col("term").rlike(TERM))


def _corpus_counts(docs: DataFrame, terms: DataFrame, params: PiiParams) -> DataFrame:
    """(term, n): occurrences of the terms in all rows; the row with a null term counts all other words."""
    words = docs.select(F.explode(_words(F.col("text"))).alias("word")).where(F.col("word").rlike(TERM))
    if terms.count() <= params.broadcast_words:
        met = words.join(F.broadcast(terms), F.col("word") == F.col("term"), "left")
        return met.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(terms, F.col("word") == F.col("term"), "left").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """(term, bits, mutual, kind, value): the words that reveal a value, and the one they reveal most.

    docs has text and __values.
    """
    seen = _seen_with(docs, params).groupBy("kind", "value", "term", "before", "after")
    seen = seen.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts"))
    pairs = seen.groupBy("kind", "value", "term").agg(F.sum("rows").alias("beside"), F.sum("texts").alias("texts"), F.max("texts").alias("most"))
    pairs = materialise(pairs, "pii-pairs")
    sure = pairs.where((F.col("texts") >= params.support) & (F.col("most") * params.support <= F.col("texts")))
    terms = materialise(sure.select("term").distinct(), "pii-terms")
    counts = materialise(_corpus_counts(docs, terms, params), "pii-counts")
    total = counts.agg(F.sum("n").alias("total"))
    entity = pairs.groupBy("kind", "value").agg(F.sum("beside").alias("around"))
    told = sure.join(counts.where("term is not null"), "term").join(entity, ["kind", "value"]).crossJoin(F.broadcast(total))
    told = told.withColumn("bits", F.greatest(F.log2(F.col("n") / F.col("beside")), F.lit(0.0)))
    told = told.withColumn("mutual", F.log2(F.col("total") / F.col("around")) - F.col("bits"))
    told = told.where((F.col("bits") <= params.generalise_bits) & (F.col("mutual") >= params.least_bits))
    best = F.min_by(F.struct("bits", "mutual", "kind", "value"), F.struct("bits", "kind", "value"))
    return told.groupBy("term").agg(best.alias("b")).select("term", "b.*")


def _term_spans(docs: DataFrame, terms: DataFrame, params: PiiParams) -> DataFrame:
    """(digest, __terms): where the disclosing words stand outside the values, for each text that holds any."""
    few = terms.count() <= params.broadcast_words
    wanted = F.broadcast(terms) if few else terms
    words = docs.select(F.sha2("text", 256).alias("digest"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    holders = materialise(words.join(wanted, "term", "left_semi").select("digest").distinct(), "pii-holders")
    with_digest = docs.select(F.sha2("text", 256).alias("digest"), "text", "__values")
    held = with_digest.join(holders, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"), F.first("__values").alias("__values"))
    spread = _pieces(held, "word", WORD)
    word = lambda p: F.struct(
        # punctuation around a word is no part of it
        (p["start"] + F.length(F.regexp_extract(p["value"], r"^[^\p{L}\p{N}]*", 0))).alias("start"),
        lower_ascii(F.regexp_replace(p["value"], EDGES, "")).alias("term"),
        F.regexp_replace(p["value"], EDGES, "").rlike(r"^\p{Lu}").alias("name"),
    )
    words = spread.select("digest", F.explode(F.transform("__p_word", word)).alias("w")).select("digest", "w.*")
    found = words.join(wanted, "term").select(
        "digest", "start", (F.col("start") + F.length("term")).alias("end"), F.when(F.col("bits") <= params.remove_bits, "remove").otherwise("generalise").alias("action"), "name"
    )
    values = held.select("digest", F.explode("__values").alias("v")).select("digest", "v.start", "v.end")
    inside = found.join(values.select(F.col("digest").alias("__d"), F.col("start").alias("__a"), F.col("end").alias("__b")),
                        (F.col("digest") == F.col("__d")) & (F.col("start") < F.col("__b")) & (F.col("end") > F.col("__a")), "left_anti")
    return inside.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action", "name"))).alias("__terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sanitised(df: DataFrame) -> DataFrame:
    """df with the text of __spans (kind, start, end, label; by start) replaced by their labels; overlaps count as one."""
    df = df.withColumn("__ends", F.transform("__spans", lambda s: s["end"]))
    size = F.lit(CHUNK)
    many = (F.length("text") / size).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), many), lambda i: F.substring(F.col("text"), i * size + 1, size))

    def cut(c: Column, start: Column, end: Column) -> Column:
        first = (start / size).cast("int")
        near = F.array_join(F.slice(c, first + 1, (end / size).cast("int") - first + 1), "")
        return F.substring(near, (start - first * size + 1).cast("int"), (end - start).cast("int"))

    def replaced(c: Column) -> Column:
        piece = lambda s, upto: F.when(s["start"] >= upto, F.concat(cut(c, upto, s["start"]), s["label"])).otherwise("")
        return F.array_join(F.zip_with("__spans", _before("__ends", "greatest"), piece), "")

    rest = F.substring(F.col("text"), (F.array_max("__ends") + 1).cast("int"), F.lit(1 << 30))
    done = F.concat(F.get(F.transform(F.array(chunks), replaced), F.lit(0)), rest)
    return df.withColumn("sanitised", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "sanitised")


def sanitise(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_spans, spans (kind:start:end, comma-joined) and sanitised text.

    The method's spans are of the kinds generalise and remove and follow the values' spans.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").cast("string").alias("text"))
    found = find_values(packed)
    terms = materialise(disclosing_terms(found, params), "pii-disclosing")
    if terms.isEmpty():
        hidden = found.withColumn("__terms", F.array().cast("array<struct<start:bigint,end:bigint,action:string,name:boolean>>"))
    else:
        spans = materialise(_term_spans(found, terms, params), "pii-spans")
        total = spans.agg(F.sum(F.size("__terms"))).first()[0] or 0
        dealt = found.withColumn("digest", F.sha2("text", 256))
        hidden = dealt.join(F.broadcast(spans), "digest", "left") if total <= params.broadcast_spans else salted_join(dealt, spans, "digest", "left")
    values = F.transform("__values", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(*[F.when(s["kind"] == k, F.lit(v)) for k, v in LABELS.items()]).alias("label")))
    label = lambda s: F.when(s["action"] == "remove", "").when(s["name"], "[NAME]").otherwise("[TERM]")
    term = lambda s: F.struct(s["action"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))
    more = F.transform(F.coalesce("__terms", F.array().cast(hidden.schema["__terms"].dataType)), term)
    order = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["label"].alias("label"))
    out = hidden.withColumn("__base", values).withColumn("__more", more)
    by_kind = F.concat(F.col("__base"), *[_of_kind("__more", k) for k in ("generalise", "remove")])
    out = out.withColumn("spans", _joined(by_kind)).withColumn("__spans", F.array_sort(F.transform(F.concat("__base", "__more"), order)))
    counts = {f"n_{k}": F.size(_of_kind("__base", k)).cast("long") for k in PATTERNS}
    out = _sanitised(out.withColumns(counts).withColumn("base_spans", _joined(F.col("__base"))))
    kept = [F.col(f"__row.{c}") for c in docs.columns if c.lower() not in ADDED]
    return out.select(*kept, *ADDED)
