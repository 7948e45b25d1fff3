"""Inventory and upkeep of tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as A
from ..operators.staging import work_dir
from ..sources import questions
from ..sources.keyed import KeyedTable
from . import fixtures as X
from . import sqlparts as Q
from .registry import query


@query("content_inventory", "SELECT doc_id, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
def content_inventory(spark, sf):
    return A.content_hash(X.table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("deduplicated_documents", "SELECT sha256(text) AS sha256, max(doc_id) AS doc_id, count(*) AS copies, min(doc_id) AS first_uploaded FROM documents GROUP BY text")
def deduplicated_documents(spark, sf):
    d = A.content_hash(X.table(spark, sf, "documents").select("doc_id", "text"), "text")
    d = d.select("doc_id", "sha256", F.col("doc_id").alias("created_at"))
    return A.dedupe_by_content(d).select("sha256", "doc_id", "copies", "first_uploaded")


_TYPED = """t_ AS (SELECT page_id, url, lower(regexp_extract(u, '\\.([A-Za-z0-9]+)$', 1)) AS type FROM (SELECT page_id, url,
  CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '[?#].*$', '') || '.PDF' WHEN 1 THEN url ELSE regexp_replace(url, '[?#].*$', '') || '.docx' END AS u FROM pages))"""


def _typed(spark, sf):
    p = X.table(spark, sf, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return p.withColumn("name", F.when(F.col("page_id") % 4 == 0, F.concat(bare, F.lit(".PDF"))).when(F.col("page_id") % 4 == 1, F.col("url"))
                        .otherwise(F.concat(bare, F.lit(".docx"))))


_OK = "type IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp')"


@query("accepted_files", f"WITH {_TYPED} SELECT page_id, type FROM t_ WHERE {_OK}")
def accepted_files(spark, sf):
    return A.split_by_allowed_type(_typed(spark, sf), "name")[0].select("page_id", "type")


@query("rejected_files", f"WITH {_TYPED} SELECT page_id, CASE WHEN type = '' THEN 'no file type' ELSE 'unsupported file type ' || type END AS reason FROM t_ WHERE NOT {_OK}")
def rejected_files(spark, sf):
    return A.split_by_allowed_type(_typed(spark, sf), "name")[1].select("page_id", "reason")


@query("safe_names", """SELECT page_id, CASE WHEN b = '' THEN 'upload' ELSE regexp_replace(b, '[^A-Za-z0-9._ -]', '_', 'g') END AS name
  FROM (SELECT page_id, string_split(url, '/')[-1] AS b FROM pages)""")
def safe_names(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


# A third of the sources have their reference text on every fourth page only.
_LAYER = "CASE WHEN doc_id % 20 % 3 = 0 AND (doc_id // 20) % 4 <> 0 THEN '' ELSE text END"
_CORPUS = f"""lp_ AS (SELECT source AS doc, doc_id, {_LAYER} AS layer, {Q.DOCS_MISREAD} AS ocr, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents),
us_ AS (SELECT doc, count(*) AS n, count(*) FILTER (length(layer) > 20) AS with_text FROM lp_ GROUP BY doc)"""


def _patchy(spark, sf):
    p = X.doc_pages(spark, sf)
    gap = (F.col("doc_id") % 20 % 3 == 0) & (F.floor(F.col("doc_id") / 20) % 4 != 0)
    return p.withColumn("layer_text", F.when(gap, "").otherwise(F.col("layer_text")))


@query("usable_layers", f"WITH {_CORPUS} SELECT doc, n, with_text FROM us_ WHERE with_text >= 0.5e0 * n")
def usable_layers(spark, sf):
    d = X.table(spark, sf, "documents")
    gap = (F.col("doc_id") % 20 % 3 == 0) & (F.floor(F.col("doc_id") / 20) % 4 != 0)
    return A.usable_layers(d.select(F.col("source").alias("doc"), F.when(gap, "").otherwise(F.col("text")).alias("text")))


@query("retrieval_corpus", f"""WITH {_CORPUS} SELECT doc, page, md5(CASE WHEN with_text >= 0.5e0 * n THEN layer ELSE ocr END) AS text_md5,
  CASE WHEN with_text >= 0.5e0 * n THEN 'textlayer' ELSE 'ocr' END AS corpus FROM lp_ JOIN us_ USING (doc)""")
def retrieval_corpus(spark, sf):
    return A.retrieval_corpus(_patchy(spark, sf)).select("doc", "page", F.md5("text").alias("text_md5"), "corpus")


@query("missing_pages", f"WITH {Q.PAGES} SELECT doc, page FROM pages_ WHERE NOT (doc_id % 3 <> 0 AND doc_id % 2 = 0)")
def missing_pages(spark, sf):
    p = X.page_numbers(spark, sf)
    cache = p.where("doc_id % 3 <> 0").withColumn("engine", F.when(F.col("doc_id") % 2 == 0, "fast").otherwise("careful"))
    return A.missing_pages(p.select("doc", "page"), cache, "fast")


@query("seeded_sample", f"WITH {Q.QA} SELECT idx, qid FROM qa ORDER BY md5('7|' || idx), idx LIMIT 50")
def seeded_sample(spark, sf):
    return questions.seeded_sample(X.predictions(spark, sf).select("idx", "qid"), "idx", 50, 7)


@query("run_index", f"""WITH {Q.QA} SELECT exp_id, count(*) AS total, count(vlm_pred) AS done, '| ' || exp_id || ' | ' || count(vlm_pred) || '/' || count(*) || ' |' AS line FROM qa GROUP BY exp_id""")
def run_index(spark, sf):
    return A.run_index(X.predictions(spark, sf), ["exp_id"], F.col("vlm_pred").isNotNull())


@query("upserted_telemetry", """SELECT user_id, metric, arg_max(value, event_id) AS value_ms, max(event_id) AS event_id FROM (SELECT *, event_type AS metric FROM events) GROUP BY user_id, metric""")
def upserted_telemetry(spark, sf):
    e = X.telemetry(spark, sf).select("user_id", "metric", "value_ms", "event_id")
    stored = KeyedTable(f"{work_dir(spark, 'telemetry')}/latest", ("user_id", "metric"), "event_id", buckets=16)
    for part in (0, 1, 2, 1):  # in three batches, one of which comes twice
        stored.upsert(e.where(F.col("event_id") % 3 == part))
    return stored.rows(spark).select("user_id", "metric", "value_ms", "event_id")


@query("deleted_conversations", f"""WITH {Q.CONVS} SELECT 'conversation' AS kind, conv_id, count(*) AS n FROM convs WHERE conv_id % 6 <> 0 GROUP BY conv_id
  UNION ALL SELECT 'message', conv_id, count(*) FROM msgs WHERE conv_id % 6 <> 0 GROUP BY conv_id""")
def deleted_conversations(spark, sf):
    c, m = X.conversations(spark, sf), X.messages(spark, sf)
    c2, m2 = A.delete_cascade(c, m, c.where("conv_id % 6 = 0"), "conv_id", "conv_id")
    count = lambda df, kind: df.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "conv_id", "n")
    return count(c2, "conversation").unionByName(count(m2, "message"))


@query("detached_conversations", f"WITH {Q.CONVS} SELECT conv_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS doc_id, doc_sha256 FROM convs")
def detached_conversations(spark, sf):
    c = X.conversations(spark, sf).select("conv_id", "doc_id", "doc_sha256")
    return A.detach(c, X.files(spark, sf).where("doc_id % 4 = 0"), "doc_id", "doc_id")


@query("evolved_conversations", f"""WITH {Q.CONVS}, {Q.FILES} SELECT conv_id, c.doc_id, coalesce(doc_sha256, f.sha256) AS doc_sha256, NULL::VARCHAR AS extra
  FROM convs c LEFT JOIN files_ f ON f.doc_id = c.doc_id""")
def evolved_conversations(spark, sf):
    c = X.conversations(spark, sf).select("conv_id", "doc_id", "doc_sha256")
    return A.evolve_schema(c, {"extra": "string", "doc_sha256": "string"}, X.files(spark, sf).select("doc_id", F.col("sha256").alias("doc_sha256")),
                           "doc_id", "doc_sha256")


_FEAT = r"""f_ AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars,
  len(regexp_extract_all(html, '(?i)<img[ >/]')) AS n_images, len(regexp_extract_all(html, '(?i)<table[ >/]')) AS n_tables,
  len(regexp_extract_all(html, '(?i)<svg[ >/]')) AS n_drawings, len(regexp_extract_all(html, '(?i)<h1[ >/]')) AS n_headings,
  len(regexp_extract_all(html, '(?i)<p[ >/]')) AS n_paragraphs, len(regexp_extract_all(html, '(?i)<li[ >/]')) AS n_items FROM pages)"""


@query("page_features", f"WITH {_FEAT} SELECT * FROM f_")
def page_features(spark, sf):
    return A.page_features(X.table(spark, sf, "pages")).drop("url", "html")


@query("page_flags", f"""WITH {_FEAT} SELECT page_id, array_to_string(list_filter([CASE WHEN n_headings / 10.0e0 >= 0.3e0 THEN 'large images' END,
  CASE WHEN n_items * 9 >= 50 THEN 'many drawings' END, CASE WHEN n_paragraphs > 3 THEN 'tables' END, CASE WHEN text_chars // 100 < 5 THEN 'almost no text' END],
  lambda x: x IS NOT NULL), '|') AS flags FROM f_""")
def page_flags(spark, sf):
    """The web pages have no images or tables, so other counts stand in for them here."""
    f = A.page_features(X.table(spark, sf, "pages")).select(
        "page_id", (F.col("n_headings") / 10.0).alias("share"), (F.col("n_items") * 9).alias("drawings"),
        F.greatest(F.col("n_paragraphs") - 3, F.lit(0)).alias("tables"), F.floor(F.col("text_chars") / 100).alias("toks"))
    return A.page_flags(f, "share", "drawings", "tables", "toks").select("page_id", F.array_join("flags", "|").alias("flags"))


@query("next_ids", "SELECT event_id, printf('EXP-%04d', row_number() OVER (ORDER BY ts, event_id)) AS new_id FROM events")
def next_ids(spark, sf):
    return A.next_ids(X.telemetry(spark, sf), "ts", "event_id", "EXP-").select("event_id", "new_id")
