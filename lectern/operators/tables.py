"""Inventory and upkeep of document, page and result tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_few
from .ordering import running

# Fixed value: what can be uploaded.
ALLOWED_TYPES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds size and SHA-256; the same content is the same document."""
    return files.select("*", F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def content_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file below ``path``; files are hashed where they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def dedupe_by_content(docs: DataFrame, sha: str = "sha256", created: str = "created_at", key: str = "doc_id") -> DataFrame:
    """Newest row per content with the number of copies and the first upload. ``max_by`` combines before the shuffle, so a
    content with very many copies is not gathered anywhere."""
    cols = [c for c in docs.columns if c != sha]
    g = docs.groupBy(sha).agg(F.max_by(F.struct(*cols), F.struct(created, key)).alias("d"), F.count("*").alias("copies"),
                              F.min(created).alias("first_uploaded"))
    return g.select(sha, "d.*", "copies", "first_uploaded")


def file_type(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def split_by_allowed_type(files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows say why."""
    t = files.withColumn("type", file_type(F.col(name)))
    ok = F.col("type").isin(*ALLOWED_TYPES)
    reason = F.when(F.col("type") == "", "no file type").otherwise(F.concat(F.lit("unsupported file type "), "type"))
    return t.where(ok), t.where(~ok).withColumn("reason", reason)


def usable_layers(layer_pages: DataFrame, doc: str = "doc", text: str = "text", min_chars: int = 20, share: float = 0.5) -> DataFrame:
    """Documents whose reference text covers at least half of their pages."""
    g = layer_pages.groupBy(doc).agg(F.count("*").alias("n"), F.count_if(F.length(text) > min_chars).alias("with_text"))
    return g.where(F.col("with_text") >= share * F.col("n"))


def retrieval_corpus(pages: DataFrame, doc: str = "doc", page: str = "page", layer: str = "layer_text", ocr: str = "ocr_text") -> DataFrame:
    """Reference text where the document has a usable one, else OCR text, with the origin. Page texts stay where they are read;
    should there be too many documents to send their flags around, pages of one document are dealt over tasks."""
    ok = usable_layers(pages.select(doc, F.col(layer).alias("text")), doc).select(doc, F.lit(True).alias("_ok"))
    j = join_few(pages, ok, [doc], "left", [page])
    use = F.coalesce("_ok", F.lit(False))
    return j.select(doc, page, F.when(use, F.col(layer)).otherwise(F.col(ocr)).alias("text"), F.when(use, "textlayer").otherwise("ocr").alias("corpus"))


def missing_pages(wanted: DataFrame, cache: DataFrame, engine: str, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Wanted pages without a reading by this engine."""
    return wanted.join(cache.where(F.col("engine") == engine).select(*keys), list(keys), "left_anti")


def upsert_latest(table: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace by key: the highest version wins. Aggregates instead of ranking, so replaying a batch changes nothing."""
    both = table.unionByName(batch)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of ``gone`` (a table of keys)."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return (parents.join(ids, parents[key] == ids["_gone"], "left_anti"), children.join(ids, children[foreign] == ids["_gone"], "left_anti"))


def detach(children: DataFrame, gone: DataFrame, key: str, foreign: str) -> DataFrame:
    """Children keep their row (and content hash) but lose the foreign key when the parent is gone."""
    ids = gone.select(F.col(key).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    j = children.join(ids, children[foreign] == ids["_gone"], "left")
    return j.withColumn(foreign, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(foreign))).drop("_gone", "_hit")


def evolve_schema(old: DataFrame, columns: dict[str, str], lookup: DataFrame | None = None, key: str | None = None,
                  backfill: str | None = None) -> DataFrame:
    """Adds missing columns (name -> type); ``backfill`` is filled from ``lookup`` by ``key`` where it is NULL."""
    out = old
    for name, kind in columns.items():
        if name not in old.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    if lookup is None:
        return out
    known = lookup.select(F.col(key).alias("_k"), F.col(backfill).alias("_v"))
    j = out.join(known, out[key] == known["_k"], "left")
    return j.withColumn(backfill, F.coalesce(backfill, "_v")).drop("_k", "_v")


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Structural counts of an HTML page: text size, images, tables, drawings, headings, paragraphs, list items."""
    h = F.col(html)
    bare = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    text = F.btrim(F.regexp_replace(bare, r"\s+", " "))
    tags = {"n_images": "img", "n_tables": "table", "n_drawings": "svg", "n_headings": "h1", "n_paragraphs": "p", "n_items": "li"}
    counted = [F.regexp_count(h, F.lit(f"(?i)<{tag}[ >/]")).cast("long").alias(name) for name, tag in tags.items()]
    return pages.select("*", F.length(text).cast("long").alias("text_chars"), *counted)


def page_flags(features: DataFrame, image_share: str, drawings: str, tables: str, ocr_tokens: str) -> DataFrame:
    """What makes OCR text of a page incomplete."""
    flags = F.array_compact(F.array(
        F.when(F.col(image_share) >= 0.3, "large images"), F.when(F.col(drawings) >= 50, "many drawings"),
        F.when(F.col(tables) > 0, "tables"), F.when(F.col(ocr_tokens) < 5, "almost no text")))
    return features.withColumn("flags", flags)


def next_ids(df: DataFrame, created: str, key: str, prefix: str, start: int = 1) -> DataFrame:
    """Dense ids in order of creation. Rows are numbered inside sampled ranges and offset by the counts of earlier ones, not
    by one global sort."""
    out = running(df, [], [F.col(created), F.col(key)], {"_n": F.lit(1).cast("long")})
    return out.withColumn("new_id", F.format_string(prefix + "%04d", F.col("_n") + (start - 1))).drop("_n")


def run_index(items: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """One summary line per run."""
    g = items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(done).alias("done"))
    return g.withColumn("line", F.format_string("| %s | %d/%d |", F.col(keys[0]), F.col("done"), F.col("total")))
