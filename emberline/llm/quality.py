"""Quality rules with adaptive thresholds.

Fixed base rules count words, symbols, repeated lines and repeated word windows. On top of them every
(lang, source) group gets its own thresholds: each metric of the documents that pass the base rules goes into a
mergeable quantile sketch (a high-dynamic-range histogram: buckets with a relative width of at most 1/32 whose
counts simply add up, so partial sketches merge in any order and the outcome never depends on task order).
The quartiles read from a group's sketch give an outlier fence, q3 + spread * (q3 - q1) + slack, and the documents
are joined to their group's fences and filtered.

Defined cases: null text has no words (it fails the base rules); an empty table gives an empty result; null lang or
source is a group like any other; repeated rows are judged one by one, alike; columns that carry the name of a metric
are replaced by the metric, all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import SPACE, WORD, materialise


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_pct: int = 50
    spread: int = 3
    #: metric -> what a fence has besides the spread, in thousandths. A group of uniform documents has no spread at
    #: all, so the slack says how far from its group a document must be to count as an outlier.
    slack: tuple = (("symbol_rate", 300), ("dup_line_rate", 300), ("repeat_rate", 300), ("mean_word_len", 4000))
    #: thresholds are broadcast up to this many groups and joined by a shuffle beyond.
    broadcast_groups: int = 20_000


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = r"[#*$%&|<>]"


def measure(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Adds the base counts, base_failed and the rates (in thousandths) to every row."""
    text = F.col("text")
    out = docs.withColumn("__w", F.filter(F.split(text, f"{SPACE}+"), lambda x: x != ""))
    out = out.withColumn("__w", F.coalesce("__w", F.array().cast("array<string>")))
    out = out.withColumn(
        "__h",
        F.expr("transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (x, i) -> xxhash64(x, __w[i + 1], __w[i + 2]))"),
    )
    # Most documents repeat no window: one pass over a set of longs settles those.
    out = out.withColumn(
        "__s",
        F.expr(
            "if(size(array_distinct(__h)) = size(__h), null,"
            " sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i))))"
        ),
    )
    out = out.withColumn(
        "__p",
        F.expr(
            "filter(transform(__s, (e, j) -> if(e.h <=> get(__s, j - 1).h or e.h <=> get(__s, j + 1).h, e.i, null)),"
            " p -> p is not null)"
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("__l", lines)
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.coalesce(F.length(text) - F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(_SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": F.coalesce(F.size("__l") - F.size(F.array_distinct("__l")), F.lit(0)).cast("long"),
            "n_repeat_words": F.coalesce(
                F.expr("size(array_distinct(flatten(transform(__p, p -> array(p, p + 1, p + 2)))))"), F.lit(0)
            ).cast("long"),
            "__n_lines": F.coalesce(F.size("__l"), F.lit(0)).cast("long"),
        }
    )
    # size(null) is -1 where the legacy setting holds
    out = out.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))
    out = out.withColumn("n_dup_lines", F.greatest("n_dup_lines", F.lit(0)))

    def rate(top: str, below: str) -> Column:
        return F.expr(f"if({below} > 0, ({top} * 1000) div {below}, 0)")

    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < params.min_words)
            | (100 * F.col("n_repeat_words") > params.max_repeat_pct * F.col("n_words")),
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "__n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "mean_word_len": rate("word_chars", "n_words"),
        }
    )
    return out.drop("__w", "__h", "__s", "__p", "__l", "__n_lines")


def measured_table(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """measure(docs) without the text, written once: the sketch and the judgement both read it."""
    return materialise(measure(docs, params).drop("text"), "quality")


def sketch(measured: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, metric, bucket, n): the groups' histograms; those of two tables merge by adding n."""
    names = [m for m, _ in params.slack]
    # the test sits behind a generator: as a plain filter the optimizer would push it below measure's projections and
    # put whole arrays in the place of their names
    stacked = ", ".join(f"'{m}', if(base_failed, null, {m})" for m in names)
    rows = measured.select("lang", "source", F.expr(f"stack({len(names)}, {stacked}) as (metric, v)")).where("v is not null")
    # values under 64 have a bucket each; above, the six leading bits name the bucket
    shift = "greatest(length(bin(v)) - 6, 0)"
    return (
        rows.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketches: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per (lang, source): q1, q3 and the fences of every metric."""
    keys = ["lang", "source", "metric"]
    w = W.partitionBy(*keys).orderBy("bucket")
    ranked = sketches.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    quartiles = ranked.groupBy(*keys).agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
    )
    aggs = []
    for metric, slack in params.slack:
        mine = F.col("metric") == metric
        room = params.spread * (F.col("q3") - F.col("q1")) + slack
        aggs += [
            F.max(F.when(mine, F.col("q3") + room)).alias(f"{metric}_max"),
            F.max(F.when(mine, F.col("q1") - room)).alias(f"{metric}_min"),
        ]
    return quartiles.groupBy("lang", "source").agg(*aggs)


def judge(measured: DataFrame, fences: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Adds kept: whether the row passes the base rules and its group's fences."""
    fences = fences.toDF(*[f"__f_{c}" for c in fences.columns])
    side = F.broadcast(fences) if fences.limit(params.broadcast_groups + 1).count() <= params.broadcast_groups else fences
    on = measured["lang"].eqNullSafe(side["__f_lang"]) & measured["source"].eqNullSafe(side["__f_source"])
    fits = F.lit(True)
    for metric, _ in params.slack:
        fits = fits & (F.col(metric) <= F.col(f"__f_{metric}_max"))
    fits = fits & (F.col("mean_word_len") >= F.col("__f_mean_word_len_min"))
    joined = measured.join(side, on, "left")
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & fits, F.lit(False))).drop(*fences.columns)
