"""Streams run over the tables until everything available is processed."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.keyed import KeyedTable
from ..streaming import streams as M
from . import fixtures as X
from . import sqlparts as Q
from .registry import query


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a pattern that only its own name fits finds both."""
    return M.read_folder(spark, f"{sf}/{name}[.]parquet", X.table(spark, sf, name).schema)


def _events(spark, sf):
    return _stream(spark, sf, "events").select("event_id", F.col("event_type").alias("metric"), F.col("value").alias("value_ms"),
                                               F.col("ts").cast("timestamp").alias("ts"), "user_id")


def _finish(spark, stream, name):
    base = M.work_dir(spark, name)
    M.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _closed(spark, sf, process, name):
    """A marker two hours beyond the last event ends all windows and sessions."""
    last = X.telemetry(spark, sf).agg(F.max("ts") + F.expr("INTERVAL 2 HOURS")).first()[0]
    return M.run_closed(_events(spark, sf), process, "ts", last, M.work_dir(spark, name))


@query("telemetry_stream", """WITH w_ AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type AS metric, count(*) AS n, avg(value) AS m, list(value ORDER BY value) AS v FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, metric, n, round(m, 6) AS mean, v[ceil(0.5e0 * n)::BIGINT] AS p50, v[ceil(0.95e0 * n)::BIGINT] AS p95 FROM w_""")
def telemetry_stream(spark, sf):
    out = _closed(spark, sf, M.telemetry_windows, "telemetry")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "metric", "n", F.round("mean", 6).alias("mean"), "p50", "p95")


@query("resumable_scoring", f"WITH {Q.QA} SELECT idx, {Q.em('vlm_pred', 'gold')} AS em FROM qa")
def resumable_scoring(spark, sf):
    base = M.work_dir(spark, "scoring")
    items = X.predictions_of(_stream(spark, sf, "documents")).select("idx", "vlm_pred", "gold")
    score = lambda df: df.select("idx", S.exact_match(F.col("vlm_pred"), F.col("gold")).alias("em"), F.lit(1).alias("version"))
    scores = KeyedTable(f"{base}/scores", ("idx",), "version", buckets=16)
    for part in ("a", "b"):  # the second stream, with a checkpoint of its own, brings the same items again
        M.resumable_scoring(items, score, scores, f"{base}/checkpoint-{part}").awaitTermination()
    return scores.rows(spark).select("idx", "em")


@query("page_arrivals", f"SELECT source AS doc, doc_id // 20 % 50 AS page, CASE WHEN doc_id % 2 = 0 THEN 'fast' ELSE 'careful' END AS engine FROM documents GROUP BY ALL")
def page_arrivals(spark, sf):
    d = _stream(spark, sf, "documents")
    pages = d.select(F.col("source").alias("doc"), (F.floor(F.col("doc_id") / 20) % 50).alias("page"), F.when(F.col("doc_id") % 2 == 0, "fast").otherwise("careful").alias("engine"),
                     F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("arrived"))
    return _finish(spark, M.page_arrivals(pages), "arrivals").select("doc", "page", "engine")


@query("new_uploads", "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0)")
def new_uploads(spark, sf):
    base = M.work_dir(spark, "uploads")
    ups = _stream(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    known = KeyedTable(f"{base}/known", ("sha256",), "version", buckets=16)
    known.upsert(X.table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.sha2("text", 256).alias("sha256"), F.lit(0).cast("long").alias("version")))
    M.new_uploads(ups, known, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("sha256 string").parquet(f"{base}/out").select("sha256")


@query("user_sessions", """WITH g_ AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s_ AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g_),
x_ AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s_ GROUP BY user_id, sid)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last, n FROM x_""")
def user_sessions(spark, sf):
    out = _closed(spark, sf, M.sessions, "sessions")
    return out.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "last")], "n")
