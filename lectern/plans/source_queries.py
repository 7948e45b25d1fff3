"""Question files, run exports and snapshots: written below the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import items as I
from ..operators import stats as E
from ..operators.staging import work_dir
from ..sources import exports, questions
from . import fixtures as X
from . import sqlparts as Q
from .registry import query

PER_FILE = 5000
_PART = f"idx // {PER_FILE}"


def _question_files(spark, sf):
    """One JSON-lines file per run and stretch of items; every third record has no id, every fourth one answer instead of a list."""
    p = X.predictions(spark, sf)
    record = F.to_json(F.struct(
        F.when(F.col("idx") % 3 != 0, F.col("qid")).alias("qid"), "question", F.when(F.col("idx") % 4 != 0, F.col("gold")).alias("answers"),
        F.when(F.col("idx") % 4 == 0, F.col("gold")[0]).alias("answer"), F.when(F.col("idx") % 5 != 0, F.concat("exp_id", F.lit(".pdf"))).alias("doc"),
        F.when(F.col("idx") % 2 == 0, (F.col("idx") % 7 + 1)).alias("page"), F.when(F.col("idx") % 2 == 0, F.col("types")).alias("types")))
    blank = F.when(F.col("idx") % 11 == 0, F.concat(record, F.lit("\n"))).otherwise(record)
    rows = p.select(F.col("exp_id").alias("run"), F.floor(F.col("idx") / PER_FILE).alias("part"), "idx", blank.alias("value"))
    folder = f"{work_dir(spark, 'questions')}/sets"
    rows.repartition("run", "part").sortWithinPartitions("run", "part", "idx").select("run", "part", "value").write.partitionBy("run", "part").text(folder)
    return folder


def _place():
    return [F.regexp_extract("path", "run=([^/]+)", 1).alias("run"), F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part")]


_LINES = f"""{Q.QA}, ln_ AS (SELECT *, {_PART} AS part, row_number() OVER w - 1 + coalesce(count(*) FILTER (idx % 11 = 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM qa WINDOW w AS (PARTITION BY exp_id, {_PART} ORDER BY idx)),
rq_ AS (SELECT exp_id AS run, part, line, CASE WHEN idx % 3 <> 0 THEN qid ELSE line::VARCHAR END AS qid, question,
  array_to_string(CASE WHEN idx % 4 = 0 THEN gold[1:1] ELSE gold END, '|') AS answers, CASE WHEN idx % 5 <> 0 THEN exp_id || '.pdf' END AS file,
  CASE WHEN idx % 2 = 0 THEN idx % 7 ELSE 0 END AS page, CASE WHEN idx % 2 = 0 THEN array_to_string(types, '|') ELSE '' END AS types FROM ln_)"""


def _flat(df):
    return df.select(*_place(), "line", "qid", "question", F.array_join("answers", "|").alias("answers"), "file", F.col("page").cast("long").alias("page"),
                     F.array_join("types", "|").alias("types"), *[c for c in df.columns if c == "error"])


@query("question_set", f"WITH {_LINES} SELECT * FROM rq_")
def question_set(spark, sf):
    return _flat(questions.read_questions(spark, _question_files(spark, sf)))


@query("question_errors", f"""WITH {_LINES} SELECT *, CASE WHEN file IS NULL THEN 'neither image nor doc' ELSE 'missing file ' || file END AS error
FROM rq_ WHERE file IS NULL OR file IN ('EXP-0001.pdf', 'EXP-0003.pdf')""")
def question_errors(spark, sf):
    there = X.predictions(spark, sf).where("exp_id IN ('EXP-0002', 'EXP-0004')").select(F.concat("exp_id", F.lit(".pdf")).alias("file"))
    return _flat(questions.question_errors(questions.read_questions(spark, _question_files(spark, sf)), there))


@query("dataset_catalog", f"WITH {Q.QA} SELECT exp_id AS run, {_PART} AS part, count(*) AS n FROM qa GROUP BY ALL")
def dataset_catalog(spark, sf):
    return questions.dataset_catalog(spark, _question_files(spark, sf), "part-*").select(*_place(), "n")


@query("run_export", f"""WITH {Q.SCORED}, r_ AS (SELECT exp_id, count(*) AS items, round(avg(vlm_anls), 6) AS vlm_mean, round(avg(ocr_anls), 6) AS ocr_mean FROM scored GROUP BY exp_id)
SELECT exp_id, items, vlm_mean, ocr_mean, CASE WHEN exp_id < 'EXP-0003' THEN 'both' ELSE 'vlm' END AS mode, CASE WHEN exp_id = 'EXP-0001' THEN 3 ELSE 6 END::BIGINT AS page_cap, qid, question,
  array_to_string(gold, '|') AS gold, vlm_pred, ocr_pred, round(vlm_anls, 6) AS vlm_anls, round(ocr_anls, 6) AS ocr_anls, vlm_ms FROM scored JOIN r_ USING (exp_id)""")
def run_export(spark, sf):
    """Every item of the export, read back with its run's config and metrics."""
    items = I.score_items(I.with_coverage(X.predictions(spark, sf)))
    wide = E.side_summary(items, ["exp_id"]).groupBy("exp_id").pivot("side", ["vlm", "ocr"]).agg(F.max("anls"))
    counts = items.groupBy("exp_id").agg(F.count("*").alias("items"))
    config = F.struct(F.when(F.col("exp_id") < "EXP-0003", "both").otherwise("vlm").alias("mode"), F.when(F.col("exp_id") == "EXP-0001", 3).otherwise(6).alias("page_cap"))
    runs = wide.join(counts, "exp_id").select("exp_id", config.alias("config"), F.struct("items", "vlm", "ocr").alias("metrics"))
    folder = f"{work_dir(spark, 'runs')}/json"
    given = items.select("exp_id", "qid", "question", "gold", "vlm_pred", "ocr_pred", F.col("vlm_scores.anls").alias("vlm_anls"), F.col("ocr_scores.anls").alias("ocr_anls"), "vlm_ms")
    exports.export_run_json(given, runs, folder)
    schema = "qid string, question string, gold array<string>, vlm_pred string, ocr_pred string, vlm_anls double, ocr_anls double, vlm_ms double"
    back = exports.read_run_items(spark, folder, schema)
    return back.select("exp_id", "metrics.items", F.round("metrics.vlm", 6).alias("vlm_mean"), F.round("metrics.ocr", 6).alias("ocr_mean"), "config.mode", F.col("config.page_cap").cast("long").alias("page_cap"),
                       "qid", "question", F.array_join("gold", "|").alias("gold"), "vlm_pred", "ocr_pred", F.round("vlm_anls", 6).alias("vlm_anls"), F.round("ocr_anls", 6).alias("ocr_anls"), "vlm_ms")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("snapshot", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(*) AS same FROM {t}" for t in _TABLES))
def snapshot(spark, sf):
    """Rows of the copies of all tables, as read back by the manifest, and how many of them are rows of the tables."""
    tables = {n: X.table(spark, sf, n) for n in _TABLES}
    copies = exports.read_snapshot(spark, exports.snapshot(tables, work_dir(spark, "copies"), "20260101"))
    out = None
    for name, df in tables.items():
        own, copy = (d.groupBy(F.xxhash64(*df.columns).alias(f"h{i}")).agg(F.count("*").alias(f"n{i}")) for i, d in enumerate((df, copies[name])))
        one = copy.join(own, F.col("h0") == F.col("h1"), "left").agg(F.sum("n1").alias("n"), F.sum(F.least("n1", F.coalesce("n0", F.lit(0)))).alias("same"))
        one = one.select(F.lit(name).alias("name"), "n", "same")
        out = one if out is None else out.union(one)
    return out
