import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.functions import text as T
from lectern.operators import tables as A
from lectern.plans import fixtures as X
from lectern.sources import exports, questions
from lectern.sources.keyed import KeyedTable
from lectern.streaming import streams as M


def test_question_files(spark, tmp_path):
    folder = tmp_path / "sets"
    folder.mkdir()
    rows = [{"qid": "s1", "question": "a?", "answers": ["x", "y"], "image": "i/a.png", "types": ["form"]},
            {"question": "b?", "answer": "z", "doc": "d.pdf", "page": 3}, {"qid": "s3", "question": "c?"}]
    (folder / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    (folder / "b.jsonl").write_text(json.dumps(rows[0]) + "\n")
    q = questions.read_questions(spark, str(folder / "a.jsonl"))
    got = {r.question: r for r in q.collect()}
    assert got["a?"].answers == ["x", "y"] and got["a?"].page == 0 and got["a?"].types == ["form"]
    assert got["b?"].answers == ["z"] and got["b?"].page == 2 and got["b?"].file == "d.pdf" and (got["b?"].qid, got["b?"].line) == ("2", 2)
    assert [r.question for r in questions.read_questions(spark, str(folder / "a.jsonl"), 2).orderBy("line").collect()] == ["a?", "b?"]
    (folder / "empty.jsonl").write_text("\n\n")
    errs = questions.question_errors(q, spark.createDataFrame([("i/a.png",)], "file string")).collect()
    assert sorted(e.error for e in errs) == ["missing file d.pdf", "neither image nor doc"]
    cat = {r.path.rsplit("/", 1)[1]: r.n for r in questions.dataset_catalog(spark, str(folder)).collect()}
    assert cat == {"a.jsonl": 3, "b.jsonl": 1, "empty.jsonl": 0}


def test_exports_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("EXP-1", 1, "x"), ("EXP-2", 2, "y")], "exp_id string, idx long, v string")
    runs = spark.createDataFrame([("EXP-1", ("both",), (0.5,)), ("EXP-3", ("vlm",), (0.1,))], "exp_id string, config struct<mode:string>, metrics struct<anls:double>")
    exports.export_run_json(df, runs, str(tmp_path / "runs"))
    assert {(r.exp_id, r["items"], r.config.mode, r.metrics.anls) for r in exports.read_run_json(spark, str(tmp_path / "runs")).collect()} == {("EXP-1", 1, "both", .5), ("EXP-3", 0, "vlm", .1)}
    blocks = spark.createDataFrame([("b", 1, "two"), ("a", -1, "# one"), ("a", 0, "body")], "k string, o int, block string")
    exports.export_markdown(blocks, str(tmp_path / "md"), ["k", "o"], files=1)
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.replace("\n\n", "\n").split() == ["#", "one", "body", "two"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    (tmp_path / "f" / "y.bin").write_bytes(b"abc")
    inv = A.content_inventory(spark, str(tmp_path / "f")).collect()
    assert len(inv) == 2 and len({r.sha256 for r in inv}) == 1 and inv[0].size_bytes == 3


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in sorted(path.rglob("*.parquet"))}


def test_snapshots_are_read_by_their_manifest(spark, tmp_path):
    tables = {"a": spark.range(50).select("id", F.array("id").alias("x")), "none": spark.createDataFrame([], "k string, v int"),
              "maps": spark.range(3).select(F.create_map(F.lit("k"), "id").alias("m"))}
    root = exports.snapshot(tables, str(tmp_path), "20260101")
    back = exports.read_snapshot(spark, root)
    assert set(back) == set(tables) and all(back[t].schema.simpleString() == df.schema.simpleString() and sorted(map(str, back[t].collect())) == sorted(map(str, df.collect())) for t, df in tables.items())
    spark.range(9).write.mode("append").parquet(f"{root}/a")  # a file that the manifest does not know
    assert exports.read_snapshot(spark, root)["a"].count() == 50
    listed = spark.read.parquet(f"{root}/manifest").where("table = 'a'").first()["files"]
    from pathlib import Path
    one = Path(root) / "a" / next(f["file"] for f in listed if f["rows"])
    one.rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="gone"):
        exports.read_snapshot(spark, root)
    spark.range(1).select("id", F.array("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / "other"))
    one.write_bytes(next((tmp_path / "other").glob("part-*")).read_bytes())
    (one.parent / f".{one.name}.crc").unlink(missing_ok=True)  # the local file system's own checksum
    with pytest.raises(ValueError, match="not as listed"):
        exports.read_snapshot(spark, root)
    half = tmp_path / "snapshot-half"
    tables["a"].write.parquet(str(half / "a"))
    with pytest.raises(ValueError, match="not a complete snapshot"):
        exports.read_snapshot(spark, str(half))


def test_upserts_touch_only_buckets_that_change(spark, tmp_path):
    t = KeyedTable(str(tmp_path / "t"), ("k", "g"), "version", buckets=8)
    assert t.rows(spark) is None
    schema = "k long, g string, v int, version int"
    t.upsert(spark.createDataFrame([(k, None if k % 5 == 0 else "a", 0, 1) for k in range(60)], schema))
    before, want = _files(tmp_path / "t"), {(k, None if k % 5 == 0 else "a"): 0 for k in range(60)}
    batch = spark.createDataFrame([(3, "a", 7, 2), (5, None, 8, 2), (5, None, 9, 3), (77, "a", 1, 1), (4, "a", 99, 0)], schema)
    changed = t.upsert(batch)
    want |= {(3, "a"): 7, (5, None): 9, (77, "a"): 1}  # the older version of (4, a) is not taken
    after = _files(tmp_path / "t")
    rows = t.rows(spark).collect()
    assert {(r.k, r.g): r.v for r in rows} == want and len(rows) == len(want)
    assert 1 <= len(changed) <= 3 and {f.split("/")[0] for f, _ in set(after.items()) ^ set(before.items())} == {f"bucket={b}" for b in changed}
    assert t.upsert(batch) == [] and _files(tmp_path / "t") == after


def test_upsert_is_replay_safe(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, version int")
    new = spark.createDataFrame([("b", 9, 2), ("c", 3, 2)], "k string, v int, version int")
    once = A.upsert_latest(old, new, ["k"], "version")
    twice = A.upsert_latest(once, new, ["k"], "version")
    want = {("a", 1, 1), ("b", 9, 2), ("c", 3, 2)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_scoring_resumes_with_what_is_new(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    scores, seen = KeyedTable(str(tmp_path / "out"), ("idx",), "version", buckets=4), []

    def score(batch):
        seen.append(batch.count())
        return batch.select("idx", F.lit(1).alias("version"))

    def run(checkpoint=ck):
        M.resumable_scoring(M.read_folder(spark, src, "idx long"), score, scores, checkpoint).awaitTermination()

    spark.range(5).toDF("idx").write.parquet(src)
    run()
    run()
    spark.range(5, 8).toDF("idx").write.mode("append").parquet(src)
    run()
    assert [n for n in seen if n] == [5, 3] and scores.rows(spark).count() == 8
    before = _files(tmp_path / "out")
    run(str(tmp_path / "lost"))  # everything once more, as after a lost checkpoint
    assert _files(tmp_path / "out") == before


def test_uploads_without_state(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    known = KeyedTable(str(tmp_path / "known"), ("sha256",), "version", buckets=4)
    known.upsert(spark.createDataFrame([("old", 0)], "sha256 string, version long"))
    sizes = []
    for n in range(4):
        rows = [(c, n) for c in ("old", "every", f"only{n}", f"only{n}", f"twice{n // 2}")]
        spark.createDataFrame(rows, "sha256 string, n int").coalesce(1).write.mode("append").parquet(src)
        M.new_uploads(M.read_folder(spark, src, "sha256 string, n int"), known, out, ck).awaitTermination()
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "ck").rglob("*") if "state" in f.parts))
    got = [r.sha256 for r in spark.read.schema("sha256 string, n int").parquet(out).collect()]
    assert sorted(got) == sorted(["every", *(f"only{n}" for n in range(4)), "twice0", "twice1"]) and sizes == [0] * 4
    # The last batch once more, as if its commit had been lost: the same contents, none taken for known.
    import shutil
    again = tmp_path / "again"
    shutil.copytree(tmp_path / "ck", again, ignore=shutil.ignore_patterns("3", ".3.crc") if (tmp_path / "ck" / "commits" / "3").exists() else None)
    (again / "offsets").mkdir(exist_ok=True)
    M.new_uploads(M.read_folder(spark, src, "sha256 string, n int"), known, out, str(again)).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.schema("sha256 string, n int").parquet(out).collect()) == sorted(got)


def test_markers_close_windows_and_sessions(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2026, 1, 1)
    rows = [("m", 1 + i % 2, float(v), t0 + timedelta(minutes=7 * i)) for i, v in enumerate([5, 1, 4, 2, 3, 9, 8, 7, 6, 10, 11, 12])] + [("k", 1, 1.0, t0 + timedelta(minutes=200))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "metric string, user_id int, value_ms double, ts timestamp").coalesce(1).write.parquet(src)
    stream = lambda: M.read_folder(spark, src, "metric string, user_id int, value_ms double, ts timestamp")
    last = t0 + timedelta(hours=6)
    for _ in range(2):  # running it again adds nothing
        w = M.run_closed(stream(), M.telemetry_windows, "ts", last, str(tmp_path / "w"))
        got = {(r.start.hour, r.metric): (r.n, r.p50, r.p95) for r in w.collect()}
        assert len(got) == w.count() and got == {(0, "m"): (9, 5.0, 9.0), (1, "m"): (3, 11.0, 12.0), (3, "k"): (1, 1.0, 1.0)}
    s = M.run_closed(stream(), lambda e: M.sessions(e, gap="20 minutes"), "ts", last, str(tmp_path / "s"))
    assert sorted((r.user_id, r.n) for r in s.collect()) == [(1, 1), (1, 6), (2, 6)]


def _folder_table(spark, tmp_path):
    """Documents as a folder of two files, as large tables are."""
    rows = [(i, t, "en", "s%d" % (i % 2), len(t)) for i, t in enumerate(["a b c", "b c d", "a b c", "c d e", "d e f", "a b c", "x y z"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_uploads_of_a_table_in_several_files(spark, tmp_path):
    import hashlib

    from lectern.plans import stream_queries as Z
    sf, rows = _folder_table(spark, tmp_path)
    known = {t for i, t, *_ in rows if i % 5 == 0}
    want = {hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in rows if t not in known}
    assert sorted(r.sha256 for r in Z.new_uploads(spark, sf).collect()) == sorted(want)


def test_scoring_of_a_table_in_several_files(spark, tmp_path):
    from lectern.plans import stream_queries as Z
    sf, rows = _folder_table(spark, tmp_path)
    assert sorted(r.idx for r in Z.resumable_scoring(spark, sf).collect()) == [i for i, *_ in rows]


def test_arrivals_of_a_table_in_several_files(spark, tmp_path):
    from lectern.plans import stream_queries as Z
    sf, rows = _folder_table(spark, tmp_path)
    want = {(source, i // 20 % 50, "careful" if i % 2 else "fast") for i, _, _, source, _ in rows}
    assert sorted(tuple(r) for r in Z.page_arrivals(spark, sf).collect()) == sorted(want)


def test_functions_in_sql_equal_their_columns(spark):
    odd = [None, "", " \n ", "Not found in  document!", "1. Paid $1,234.50 (5%)\n- on 2019-03-04; the 'big' ship\u2019s o.k.", "\ufb01ne\u00a0\uff11\u00b2 \u00c9T\u00c9 \u2026", "a/b\\c'd"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in odd], "text string"))
    names = sql.register(spark)
    assert len(names) == len(sql.FUNCTIONS) >= 25
    s = F.col("text")
    columns = {"match_keys": T.keys, "vocabulary": T.vocab, "bm25_query_tokens": lambda x: T.bm25_tokens(x, drop_stop=True)}
    from lectern.functions import scoring as S
    head, golds = F.substring(s, 3, 30), F.array(F.substring(s, 1, 30), F.lit(None).cast("string"), F.lit("x"))
    checks = []
    for name, (params, _, _) in sql.FUNCTIONS.items():
        if len(params) == 1:
            own, by_name = columns.get(name, getattr(T, name, None))(s), F.expr(f"lectern_{name}(text)")
        elif name == "answer_in_text":
            own, by_name = S.answer_in_text(golds, s), F.expr("lectern_answer_in_text(array(substring(text, 1, 30), CAST(NULL AS STRING), 'x'), text)")
        else:
            own, by_name = getattr(S, name)(head, golds), F.expr(f"lectern_{name}(substring(text, 3, 30), array(substring(text, 1, 30), CAST(NULL AS STRING), 'x'))")
        checks.append(F.count_if(~own.eqNullSafe(by_name)).alias(name))
    assert {k: v for k, v in docs.agg(*checks).first().asDict().items() if v} == {}


def test_entry_runs(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert {r.side for r in rows} == {"vlm", "ocr"} and all(0 <= r.anls <= 1 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert X.table(spark, "/root/testdata/sf0.001", "documents").count() > 0
