"""Inputs of the engine derived from the driver tables: predictions, pages, OCR lines, messages, files, telemetry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions

NF = "Not found in document."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def misread(text):
    """What a reader makes of every third page: two letters come back as digits."""
    return F.translate(text, "lO", "1o")


def ocr_text(doc_id, text):
    return F.when(doc_id % 3 == 0, misread(text)).otherwise(text)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided predictions: one question per document about six words somewhere in its text (fewer in a short one), four runs."""
    return predictions_of(table(spark, sf_dir, "documents"))


def predictions_of(documents: DataFrame) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    # A generator computes the words once; as plain columns every later filter on an answer would repeat the split.
    d = documents.select("doc_id", "source", "lang", "text", F.explode(F.array(w)).alias("ws"))
    start = F.when(F.size("ws") >= 6, F.lit(1) + F.pmod(F.col("doc_id") * 7, F.size("ws") - 5)).otherwise(F.lit(1)).cast("int")
    six = F.slice("ws", start, 6)
    words = F.inline(F.transform(F.array(six), lambda a: F.struct(*[F.coalesce(F.get(a, F.lit(i)), F.lit("")).alias(f"w{i + 1}") for i in range(6)])))
    d = d.select("doc_id", "source", "lang", "text", words)
    word = lambda i: F.col(f"w{i}")
    gold = F.rtrim(F.concat_ws(" ", word(1), word(2), word(3)))
    second = F.rtrim(F.concat_ws(" ", word(4), word(5)))
    k, o = F.col("doc_id") % 10, F.col("doc_id") % 7
    read_wrong = F.translate(gold, "leo", "1c0")
    return d.select(
        F.concat(F.lit("EXP-000"), (F.col("doc_id") % 4 + 1).cast("string")).alias("exp_id"),
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"),
        F.concat(F.lit("What does "), word(2), F.lit(" "), word(4), F.lit(" say?")).alias("question"),
        F.when(F.col("doc_id") % 5 == 0, F.array(gold, second)).otherwise(F.array(gold)).alias("gold"),
        F.when(k == 0, NF).when(k == 1, F.lit(None).cast("string")).when(k == 2, read_wrong).when(k == 3, word(1))
        .otherwise(gold).alias("vlm_pred"),
        F.when(o == 0, NF).when(o == 1, F.lit(None).cast("string")).when(o == 2, read_wrong)
        .when(o == 3, F.replace(gold, F.lit(" "), F.lit(""))).when(o == 4, F.rtrim(F.concat_ws(" ", word(4), word(5), word(6))))
        .otherwise(gold).alias("ocr_pred"),
        (100 + (F.col("doc_id") * 37) % 900).cast("double").alias("vlm_ms"),
        (200 + (F.col("doc_id") * 53) % 3000).cast("double").alias("ocr_ms"),
        F.array("source", "lang").alias("types"),
        F.col("doc_id"), F.col("text").alias("layer_text"), ocr_text(F.col("doc_id"), F.col("text")).alias("ocr_text"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many pages: the document is the source, its pages are the rows of that source in order."""
    d = table(spark, sf_dir, "documents")
    numbered = positions(d.select("source", "doc_id"), ["source"], "doc_id", "page")
    return (d.select("doc_id", "text").join(numbered, "doc_id")
            .select(F.col("source").alias("doc"), F.col("page").cast("long").alias("page"), "doc_id",
                    F.col("text").alias("layer_text"), ocr_text(F.col("doc_id"), F.col("text")).alias("ocr_text")))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of ``doc_pages`` without the texts."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return positions(d, ["source"], "doc_id", "page").select(
        F.col("source").alias("doc"), F.col("page").cast("long").alias("page"), "doc_id", "n_chars")


def doc_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the documents of many pages: every benchmark item is asked of one of twenty sources."""
    b = table(spark, sf_dir, "benchmark")
    words = F.btrim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    return b.select(F.concat(F.lit("ask-"), F.col("item_id").cast("string")).alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc"),
                    F.concat(F.lit("What is the "), words, F.lit("?")).alias("question"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR line boxes in pixels. One page per document row; every fifth line is a table row of three boxes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = ocr_text(F.col("doc_id"), F.col("text"))
    ln = d.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    cells = F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    ln = ln.select("doc_id", "pos", "text", F.explode(cells).alias("cell"))
    x0 = 10.0 + 800.0 * F.col("cell")
    return ln.select(
        "doc_id", (F.col("pos") * 3 + F.col("cell")).cast("long").alias("line_no"), "text",
        (F.lit(0.80) + ((F.col("doc_id") * 13 + F.col("pos") + F.col("cell")) % 20) / F.lit(100.0)).alias("score"),
        x0.alias("x0"), (30.0 * F.col("pos")).alias("y0"),
        (x0 + 7.0 * F.length("text")).alias("x1"), (30.0 * F.col("pos") + 20.0).alias("y1"))


def message_key() -> Column:
    """One number for (conv_id, turn), in their order: turns take the lower 32 bits."""
    return F.col("conv_id") * F.lit(1 << 32) + F.col("turn")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, system turns included. Each conversation is about one of forty file contents."""
    c = table(spark, sf_dir, "conversations")
    item = (F.col("conv_id") * 3 + F.col("turn")) % 5
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    about = F.col("conv_id") * 1000 + F.col("turn")  # only makes messages differ
    ocr_answer = (F.when(F.col("conv_id") % 6 == 0, F.lit(None).cast("string"))
                  .when(F.col("conv_id") % 6 == 1, NF).otherwise(F.col("text")))
    return c.select(
        "conv_id", message_key().alias("seq"), F.col("turn").cast("long").alias("turn"), "role",
        F.when(user, F.concat(F.lit("What is item "), item.cast("string"), F.lit("?"))).otherwise(F.col("text")).alias("content"),
        F.md5((F.col("conv_id") % 40).cast("string")).alias("sha256"),
        F.timestamp_seconds(F.lit(1700000000) + about).alias("created_at"),
        F.when(assistant, F.col("text")).alias("vlm_answer"), F.when(assistant, ocr_answer).alias("ocr_answer"),
        F.when(assistant & (about % 13 == 0), "timeout").alias("error"),
        F.when(F.col("conv_id") % 3 == 0, "both").otherwise("vlm").alias("mode"),
        (F.col("conv_id") % 2 == 0).alias("short"), (F.col("conv_id") % 4).cast("string").alias("prompt_version"),
        F.when(F.col("conv_id") % 7 == 0, 3).otherwise(6).alias("page_cap"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    named = F.col("conv_id") % 11 != 0
    return (m.groupBy("conv_id", "sha256").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
            .select("conv_id", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
                    F.when(named, F.col("conv_id") % 40).alias("doc_id"),
                    F.when(named & (F.col("conv_id") % 5 != 0), F.col("sha256")).alias("doc_sha256"),
                    "created_at", "updated_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files: sixty contents, each uploaded many times."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 60).cast("string"), F.lit(".pdf")).alias("filename"),
        (1 + F.col("doc_id") % 9).alias("n_pages"), F.col("n_chars").alias("size_bytes"),
        F.md5((F.col("doc_id") % 60).cast("string")).alias("sha256"),
        F.timestamp_seconds(F.lit(1690000000) + F.col("doc_id") * 61).alias("created_at"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("metric"), F.col("value").alias("value_ms"), F.col("ts").cast("timestamp").alias("ts"), "user_id")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a trust score and whether the recommended answer was right."""
    r = table(spark, sf_dir, "labels")
    return r.select(
        F.concat(F.lit("EXP-000"), (F.col("doc_id") % 3 + 1).cast("string")).alias("exp_id"), F.col("doc_id").alias("idx"),
        F.when(F.col("doc_id") % 8 != 0, ((F.col("doc_id") * 61) % 1001) / F.lit(1000.0)).alias("trust"),
        F.when(F.col("doc_id") % 8 == 0, "not rated").otherwise("medium").alias("trust_level"),
        F.when(F.col("doc_id") % 8 != 0, F.col("quality") == 1).alias("recommended_correct"),
        (F.col("toxic") == 0).alias("agree"))


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer two-sided answers: an assistant message read by two readers who differ in known ways."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    about = F.col("conv_id") * 1000 + F.col("turn")  # only makes asks differ
    k = about % 7
    amount = (1000 + about % 97).cast("string")
    other = (2000 + about % 89).cast("string")
    a = F.concat(F.col("text"), F.lit(" The total is $1,"), F.lpad((about % 1000).cast("string"), 3, "0"), F.lit(".50. It took "),
                 amount, F.lit(" days."))
    swapped = F.concat(F.translate(F.col("text"), "e", "c"), F.lit(" The total is "), F.lit("1"),
                       F.lpad((about % 1000).cast("string"), 3, "0"), F.lit(".5.\nIt took "), other, F.lit(" days."))
    b = (F.when(k == 0, NF).when(k == 1, a).when(k == 2, swapped).when(k == 3, F.col("text"))
         .when(k == 4, F.concat(F.lit("1. "), F.lower(F.col("text")), F.lit("\n- Total: "), amount, F.lit("\n"), other))
         .when(k == 5, F.concat(F.lit("- "), amount)).otherwise(F.concat(F.reverse(F.col("text")), F.lit(" Done! 12%"))))
    return c.select(message_key().alias("qid"), F.when(about % 10 == 0, NF).when(k == 5, other).otherwise(a).alias("vlm"), b.alias("ocr"))
