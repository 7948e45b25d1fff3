"""The corpus pipeline: documents in, token ids out, one written table per stage.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns token ids.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, langid, linededup, simhash
from lectern.llm.common import shared_folder, table
from lectern.llm.queries import remainder, tokenizer_path

#: SQL expresses neither the language model nor connected near copies nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those no language is more likely than not for."""
    model = langid.fit(docs, remainder(4) != 2)
    # Under other names, so that columns of the prediction's names stay.
    given = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    found = langid.predict(docs.toDF(*given.values()), model, text=given["text"])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*[F.col(g).alias(c) for c, g in given.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines and halves of lines out of texts; every document stays. n_chars follows the text."""
    out = linededup.drop_recurring(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped") + F.col("__cut") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text as token ids (binary, little-endian unsigned 32-bit), their number, and whether decoding
    gives the text again."""
    back = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return back.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
