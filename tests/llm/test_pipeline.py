import corpus_pipeline
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_messy_table_goes_through(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    left = sorted((r["doc_id"], r["exact"]) for r in out.collect())
    assert left == [(4, True), (5, True), (7, True), (8, True)]


def test_empty_table(spark, messy):
    docs = messy.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() < n and out.where("not exact").count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
