"""Writing results out."""
from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_COLUMNS = ("qid", "question", "gold", "vlm_pred", "ocr_pred", "vlm_em", "vlm_anls", "ocr_em", "ocr_anls", "vlm_ms", "ocr_ms",
               "answer_in_ocr", "pipelines_agree", "better", "vlm_cause", "ocr_cause", "answer_region", "why_vlm", "why_ocr")


def csv_projection(items: DataFrame) -> DataFrame:
    """The 19 export columns in their order. Written explanations are not produced, so their columns name the cause."""
    c = set(items.columns)
    opt = lambda n: F.col(n) if n in c else F.lit(None).cast("string")
    return items.select(
        "qid", "question", F.to_json("gold").alias("gold"), "vlm_pred", "ocr_pred", F.col("vlm_scores.em").alias("vlm_em"),
        F.col("vlm_scores.anls").alias("vlm_anls"), F.col("ocr_scores.em").alias("ocr_em"), F.col("ocr_scores.anls").alias("ocr_anls"),
        "vlm_ms", "ocr_ms", "answer_in_ocr", F.col("agree").alias("pipelines_agree"), opt("better").alias("better"),
        opt("vlm_cause").alias("vlm_cause"), opt("ocr_cause").alias("ocr_cause"), opt("bucket").alias("answer_region"),
        opt("vlm_cause").alias("why_vlm"), opt("ocr_cause").alias("why_ocr"))


def export_items_csv(items: DataFrame, path: str) -> None:
    csv_projection(items).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_items_csv`` wrote; an empty text is a quoted one, NULL is nothing between two commas."""
    numbers = {"vlm_em", "vlm_anls", "ocr_em", "ocr_anls", "vlm_ms", "ocr_ms"}
    kind = lambda c: "double" if c in numbers else "boolean" if c in ("answer_in_ocr", "pipelines_agree") else "string"
    schema = ", ".join(f"{c} {kind(c)}" for c in CSV_COLUMNS)
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").option("nullValue", "\u0000").csv(path)


def export_run_json(items: DataFrame, runs: DataFrame, path: str, run: str = "exp_id") -> None:
    """Per run, JSON lines of its items in its own folder, and one record with its config and metrics; no run is gathered."""
    items.write.mode("overwrite").partitionBy(run).json(f"{path}/items")
    runs.write.mode("overwrite").json(f"{path}/runs")


def read_run_items(spark: SparkSession, path: str, schema: str, run: str = "exp_id") -> DataFrame:
    """Every exported item, with its run's config and metrics."""
    items = spark.read.schema(f"{schema}, {run} string").json(f"{path}/items")
    return items.join(F.broadcast(spark.read.json(f"{path}/runs")), run, "left")  # one record per run


def read_run_json(spark: SparkSession, path: str, run: str = "exp_id") -> DataFrame:
    """The run records with the number of their exported items."""
    counts = spark.read.json(f"{path}/items").groupBy(run).agg(F.count("*").alias("items"))
    return spark.read.json(f"{path}/runs").join(counts, run, "left").na.fill(0, ["items"])


def export_markdown(blocks: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Blocks as text, in order: ranges of the sort keys become files, each sorted."""
    spread = blocks.repartitionByRange(files, *order) if files else blocks.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------------------------------------------------ snapshots
MANIFEST = "manifest"


def _digest(df: DataFrame) -> DataFrame:
    """(file, rows, checksum) of the files of a table just written: the checksum adds up a hash of every row."""
    cols = [F.to_json(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema.fields]
    rows = df.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*cols).cast("decimal(38,0)").alias("h"))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.sum("h").alias("checksum"))


def snapshot(tables: dict[str, DataFrame], path: str, stamp: str) -> str:
    """A dated copy of all tables below ``path``; returns its folder. A manifest of files, row counts and checksums is written last,
    as one file that appears whole or not at all; a copy without it is no snapshot (``read_snapshot``)."""
    root, listed = f"{path.rstrip('/')}/snapshot-{stamp}", None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
        own = _digest(df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")).agg(F.collect_list(F.struct("file", "rows", "checksum")).alias("files")).select(
            F.lit(name).alias("table"), F.lit(df.schema.json()).alias("schema"), "files")
        listed = own if listed is None else listed.unionByName(own)
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{MANIFEST}")
    return root


def read_snapshot(spark: SparkSession, root: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a complete snapshot: only files that the manifest lists are read. A copy whose manifest was never written is
    refused, as is one whose files are gone, and with ``verify`` one whose files do not have the listed rows."""
    try:
        listed = spark.read.parquet(f"{root}/{MANIFEST}").collect()  # a row for each table, with the names of its files
    except AnalysisException as e:
        raise ValueError(f"{root} is not a complete snapshot") from e
    out = {}
    for r in listed:
        schema = StructType.fromJson(json.loads(r["schema"]))
        paths = [f"{root}/{r['table']}/{f['file']}" for f in r["files"]]
        try:
            df = out[r["table"]] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        except AnalysisException as e:
            raise ValueError(f"{root}: files of {r['table']} are gone") from e
        if verify and paths:
            found = {x["file"]: (x["rows"], x["checksum"]) for x in _digest(df).collect()}
            if found != {f["file"]: (f["rows"], f["checksum"]) for f in r["files"]}:
                raise ValueError(f"{root}: files of {r['table']} are not as listed")
    return out
