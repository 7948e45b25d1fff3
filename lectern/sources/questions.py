"""Question sets as JSON lines: {"qid", "question", "answers" | "answer", "image" | "doc", "page" (1-based), "types"}."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "qid string, question string, answers array<string>, answer string, image string, doc string, page int, types array<string>"


def _plain(path: Column) -> Column:
    """One spelling of local paths, which listings and file metadata write differently."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every line with its 0-based number in its file. Large files are split freely: lines are numbered
    within a block and shifted by the lines of the file's earlier blocks."""
    raw = spark.read.text(path).select("value", _plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("o"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    shift = raw.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("path", "block").orderBy("o")
    return raw.withColumn("i", F.row_number().over(inside) - 1).join(shift, ["path", "block"]).select(
        "path", (F.col("shift") + F.col("i")).alias("line"), "value")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, line, qid, question, answers, file, page, types). Blank lines are skipped, a record without an id is named by its
    line, pages become 0-based, missing lists become empty; ``limit`` takes the first records by file and line."""
    r = numbered_lines(spark, path).where(F.btrim("value") != "").withColumn("r", F.from_json("value", SCHEMA))
    none = F.array().cast("array<string>")
    answers = F.when(F.size("r.answers") > 0, F.col("r.answers")).when(F.col("r.answer").isNotNull(), F.array("r.answer")).otherwise(none)
    out = r.select(
        "path", "line", F.coalesce("r.qid", F.col("line").cast("string")).alias("qid"), F.col("r.question").alias("question"),
        answers.alias("answers"), F.coalesce(F.nullif("r.image", F.lit("")), F.nullif("r.doc", F.lit(""))).alias("file"),
        (F.coalesce("r.page", F.lit(1)) - 1).alias("page"), F.coalesce("r.types", none).alias("types"))
    return out if limit is None else out.orderBy("path", "line").limit(limit)


def question_errors(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Records without a source, or whose source is not among ``files(file)``."""
    none = questions.where("file IS NULL").withColumn("error", F.lit("neither image nor doc"))
    gone = questions.where("file IS NOT NULL").join(files.select("file").distinct(), "file", "left_anti").withColumn(
        "error", F.concat(F.lit("missing file "), "file"))
    return none.unionByName(gone.select(*none.columns))


def dataset_catalog(spark: SparkSession, root: str, names: str = "*.jsonl") -> DataFrame:
    """Every JSON-lines file of these names below ``root`` with its number of records, files without any included."""
    def below(reader):
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", names)

    files = below(spark.read.format("binaryFile")).load(root).select(_plain(F.col("path")).alias("path"))
    lines = below(spark.read).text(root).where(F.btrim("value") != "").groupBy(_plain(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("n"))
    return files.join(lines, "path", "left").na.fill(0, ["n"])


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same n rows for the same seed on any cluster: smallest hash of (seed, key). Each task keeps only its own n."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)
