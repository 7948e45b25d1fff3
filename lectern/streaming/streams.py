"""Structured Streaming forms: telemetry windows, resumable scoring, page arrivals, upload deduplication, sessions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import work_dir  # noqa: F401
from ..sources.keyed import KeyedTable


def read_folder(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there into a Parquet folder and stops; run again with the same folders to continue."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def marker(spark: SparkSession, folder: str, like: DataFrame, ts: str, at) -> None:
    """Writes one row to ``folder``, all NULL but for the time ``ts``: read together with a stream (``with_markers``), it moves the
    stream's watermark to ``at``, so that windows and sessions which ended before come out."""
    row = spark.range(1).select(*[(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])
    row.write.mode("append").parquet(folder)


def with_markers(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and the rows that ``marker`` writes to ``folder`` while it runs or afterwards."""
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


def run_closed(stream: DataFrame, process: Callable[[DataFrame], DataFrame], ts: str, last, folder: str) -> DataFrame:
    """Runs ``process`` over all that ``stream`` has, then closes it: a marker far enough beyond ``last``, the last event's time, ends
    every window and session. Returns what was written. Run again with the same folder, it writes nothing twice."""
    spark = stream.sparkSession
    marks = f"{folder}/markers"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(marks)
    done = process(with_markers(stream, marks))
    run_available(done, f"{folder}/out", f"{folder}/checkpoint")
    marker(spark, marks, stream, ts, last)
    run_available(done, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(done.schema).parquet(f"{folder}/out")


# ------------------------------------------------------------------------------------------------ telemetry
def telemetry_windows(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", accuracy: int = 10000) -> DataFrame:
    """Per metric and window: n, mean, p50 and p95. The watermark closes windows and drops later events; the quantiles come from a
    sketch that tasks merge, so a window's state has a fixed size however many events fall into it. They are values of events,
    exact up to ``accuracy`` events in a window, beyond that within n / accuracy ranks."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w, "metric").agg(
        F.count("*").alias("n"), F.sum("value_ms").alias("total"), F.percentile_approx("value_ms", [0.5, 0.95], accuracy).alias("_q"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "metric", "n", (F.col("total") / F.col("n")).alias("mean"),
                    F.get("_q", F.lit(0)).alias("p50"), F.get("_q", F.lit(1)).alias("p95"))


# ------------------------------------------------------------------------------------------------ resumable scoring
def resumable_scoring(predictions: DataFrame, score: Callable[[DataFrame], DataFrame], scores: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Scores every batch of new predictions into a keyed table. A restart continues after the last finished batch; a batch that is
    run twice changes nothing, and buckets without new scores are not rewritten."""
    return predictions.writeStream.foreachBatch(lambda batch, _: scores.upsert(score(batch)) and None).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


# ------------------------------------------------------------------------------------------------ arrivals and uploads
def page_arrivals(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (doc, page, engine) once, although readings may be delivered again while the watermark has not passed them."""
    return pages.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc", "page", "engine"])


def new_uploads(uploads: DataFrame, known: KeyedTable, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each upload (sha256 and more) whose content was never seen to ``out``, a folder per batch. What was seen is a table keyed by
    content, of which a batch reads only the buckets of its own contents; the stream itself keeps no state, however long it runs.
    A batch that is run twice overwrites its folder with the same contents: those that it made known itself do not count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["sha256"])
        seen = known.read(batch.sparkSession, known.touched(fresh))
        if seen is not None:
            fresh = fresh.join(seen.where(F.col(known.version) != -batch_id - 1).select(F.col("sha256").alias("_seen")), F.col("sha256").eqNullSafe(F.col("_seen")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = batch.sparkSession.read.schema(fresh.schema).parquet(f"{out}/batch={batch_id}")
        # Earlier batches have higher versions, so the first that brought a content keeps it.
        known.upsert(written.select("sha256", F.lit(-batch_id - 1).cast("long").alias(known.version)))

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity per user with their last event."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "last")
