"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Quality rules drop documents, line dedup rewrites texts, the Jaccard join keeps one document of each near-duplicate
component, mixing orders the rows (and the written files) by the target weights, and byte-level BPE encodes them. The
encoded rows carry their token ids and their place in the mix, as a reader of Parquet files need not keep the order they
were written in.

Defined cases, for every stage: null text has no words, so the quality rules drop it, and the later stages pass it
through (no lines, no links, no tokens); an empty text likewise; texts of any length are taken whole; repeated rows are
judged alike, and the Jaccard join keeps one row of an id and text; rows with a null doc_id are kept by it; null lang and
null source are groups like any other; an empty table gives an empty corpus; extra columns pass through all stages
whatever they are called, but for the last, whose own columns replace those of the same name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, jaccard, line_dedup, mixing, quality
from emberline.llm._common import exists, read, remove, scratch, shared_dir
from emberline.llm.queries import MIX, bpe_params

#: Rows in this order are the mix.
PLACE = ("cycle", "slot", "offset")


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator works on, beside the row as it came: whatever else is in it clashes with nothing."""
    return docs.select(F.struct(*docs.columns).alias("__row"), *names)


def _mixed(docs: DataFrame, keep_zipped: bool = False) -> DataFrame:
    """The mixed rows, packed but for the text."""
    rest = [c for c in docs.columns if c != "text"]
    return mixing.mix(docs.select(F.struct(*rest).alias("__row"), "source", "doc_id", "text"), MIX, keep_zipped)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured = quality.measured_table(_packed(docs, "text", "lang", "source"))
    return quality.judge(measured, quality.thresholds(quality.sketch(measured))).where("kept").select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*rest).alias("__row"), "doc_id", "text")
    out = line_dedup.line_dedup(row)
    now = {c: F.col(f"__row.{c}") for c in rest} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[now[c].alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _mixed(docs).select(*[F.col(c if c == "text" else f"__row.{c}") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [f"__row.{c}" for c in docs.columns if c.lower() not in (*PLACE, "text")]
    mixed = _mixed(docs, keep_zipped=True).select(*rest, "text", *PLACE)
    return bpe.encode_decode(mixed, bpe_params(), keep_ids=True, zipped=True, keep_bytes=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the hash order of the mix, nor BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def corpus(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The finished corpus, as written: every document's columns, place in the mix, digests and token_ids.

    A run that failed goes on behind its last finished stage if it is called again with its run_id. A stage's table is
    removed once the next one is written.
    """
    folder = f"{shared_dir(spark)}/emberline-pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{folder}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    done = max((i for i, path in enumerate(paths) if exists(spark, f"{path}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else read(spark, sf_dir, "documents")
    for i in range(done + 1, len(STAGES)):
        with scratch(spark):
            STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
        docs = spark.read.parquet(paths[i])
        if i:
            remove(spark, paths[i - 1])
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in the order of the mix."""
    return corpus(spark, sf_dir).orderBy(*PLACE)
