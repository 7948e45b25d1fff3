"""Questions and answers over time: pairing, reuse, histories per file content."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import neighbour, smallest


def previous_answers(messages: DataFrame) -> DataFrame:
    """(sha256, question, seq, conv_id, answer_seq): every question with the next assistant message at or after it in its
    conversation. A question overtaken by another one still gets the answer that follows."""
    later = neighbour(messages, ["conv_id"], "turn", F.when(F.col("role") == "assistant", F.col("seq")), "answer_seq")
    return later.where("role = 'user' AND answer_seq IS NOT NULL").select(
        "sha256", T.normalize_question(F.col("content")).alias("question"), "seq", "conv_id", "answer_seq")


def turns(messages: DataFrame) -> DataFrame:
    """Questions with the assistant message right after them, system messages aside; an overtaken question stays unanswered."""
    said = F.when(F.col("role").isin("user", "assistant"), F.struct("role", "seq", "vlm_answer", "ocr_answer"))
    nxt = neighbour(messages, ["conv_id"], "turn", said, "_next", strict=True)
    ok = F.col("_next.role") == "assistant"
    return nxt.where("role = 'user'").select(
        "conv_id", "sha256", "turn", "seq", "created_at", F.col("content").alias("question"), F.when(ok, F.col("_next.seq")).alias("answer_seq"),
        F.when(ok, F.col("_next.vlm_answer")).alias("vlm_answer"), F.when(ok, F.col("_next.ocr_answer")).alias("ocr_answer"))


def recent_history(messages: DataFrame, n: int) -> DataFrame:
    """The last n answered questions per conversation and side, newest first (k = 1)."""
    t = turns(messages).where("answer_seq IS NOT NULL")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_answer").alias("answer")) for s in ("vlm", "ocr")])
    long = t.select("conv_id", "seq", "question", F.explode(sides).alias("s")).select("conv_id", "seq", "question", "s.*")
    long = long.where(F.coalesce("answer", F.lit("")) != "")
    best = smallest(long, ["conv_id", "side"], F.struct((-F.col("seq")).alias("o"), "question", "answer", "seq"), n, "seq", salts=16)
    return best.select("conv_id", "side", F.posexplode("_best").alias("k", "b")).select(
        "conv_id", "side", (F.col("k") + 1).alias("k"), "b.question", "b.answer")


def reusable_answers(messages: DataFrame, full: Column, legacy: Column) -> DataFrame:
    """For each opening question the newest earlier answer to the same question about the same content with the same
    settings and no error. ``full`` fingerprints all settings (NULL on answers saved before settings were recorded);
    ``legacy`` covers what those answers did record. One nearest-earlier lookup per key, not a join of all with all."""
    m = messages.withColumn("_full", full).withColumn("_legacy", legacy)
    opening = neighbour(m, ["conv_id"], "turn", F.when(F.col("role") == "assistant", F.col("seq")), "_before", forward=False, strict=True)
    opening = opening.withColumn("_opens", (F.col("role") == "user") & F.col("_before").isNull())
    q = neighbour(opening, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("content")), "_asked", forward=False)
    q = q.withColumn("_q", T.normalize_question(F.col("_asked")))
    usable = (F.col("role") == "assistant") & F.col("error").isNull()
    sought = (F.col("role") == "user") & F.col("_opens")
    rows = q.where(sought | usable).select("sha256", "_q", "_full", "_legacy", "seq", sought.alias("_sought"), usable.alias("_usable"),
                                           F.col("config_recorded").alias("_rec"))
    by_full = neighbour(rows, ["sha256", "_q", "_full"], "seq", F.when(F.col("_usable") & F.col("_rec"), F.col("seq")), "_a", forward=False, strict=True, rows_per_slice=None)
    both = neighbour(by_full, ["sha256", "_q", "_legacy"], "seq", F.when(F.col("_usable") & ~F.col("_rec"), F.col("seq")), "_b", forward=False, strict=True, rows_per_slice=None)
    return both.where("_sought").select("seq", "sha256", F.col("_q").alias("question"), F.greatest("_a", "_b").alias("reused_seq"))


def files_with_conversations(files: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per file content: newest copy, number of copies and conversations, last use."""
    f = files.groupBy("sha256").agg(
        F.max_by("filename", F.struct("created_at", "doc_id")).alias("filename"), F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("latest_doc"),
        F.count("*").alias("copies"), F.min("created_at").alias("first_uploaded"), F.max("created_at").alias("_last_upload"))
    c = conversation_content(files, convs).where("content IS NOT NULL").groupBy(F.col("content").alias("sha256")).agg(
        F.count("*").alias("conversations"), F.max("updated_at").alias("_last_message"))
    j = f.join(c, "sha256", "left").na.fill(0, ["conversations"])
    return j.withColumn("last_used", F.greatest("_last_upload", "_last_message")).drop("_last_upload", "_last_message")


def conversation_content(files: DataFrame, convs: DataFrame) -> DataFrame:
    """Adds ``content``: the recorded hash, else the hash of the document pointed to."""
    ids = files.select("doc_id", F.col("sha256").alias("_sha"))
    return convs.join(ids, "doc_id", "left").select(*convs.columns, F.coalesce("doc_sha256", "_sha").alias("content"))


def orphan_conversations(files: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations about no known file."""
    c = conversation_content(files, convs)
    return c.join(files.select(F.col("sha256").alias("content")).distinct(), "content", "left_anti")


def search_files(grouped: DataFrame, text: str) -> DataFrame:
    return grouped.where(F.contains(F.lower("filename"), F.lit(text.strip().lower())))


def document_history(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Turns of every conversation about a file's content, whichever copy it was held about. One row per turn, ordered by
    (sha256, conv_id, turn); a content discussed in millions of turns stays millions of rows."""
    latest = files.groupBy("sha256").agg(F.max_by(F.struct("doc_id", "filename", "n_pages"), F.struct("created_at", "doc_id")).alias("f"))
    return turns(messages).join(latest.select("sha256", "f.*"), "sha256")


def history_index(files: DataFrame, messages: DataFrame) -> DataFrame:
    """One summary row per content: name, pages, questions, answered."""
    latest = files.groupBy("sha256").agg(F.max_by(F.struct("filename", "n_pages"), F.struct("created_at", "doc_id")).alias("f"))
    t = turns(messages).groupBy("sha256").agg(F.count("*").alias("questions"), F.count("answer_seq").alias("answered"))
    return latest.join(t, "sha256", "left").na.fill(0, ["questions", "answered"]).select(
        "sha256", "f.filename", "f.n_pages", "questions", "answered")


def conversation_markdown(messages: DataFrame, convs: DataFrame) -> DataFrame:
    """A conversation's record as ordered blocks (conv_id, turn, block): the title, then one block per message."""
    block = F.when(F.col("role") == "user", F.concat(F.lit("**You:** "), F.col("content"))).when(F.col("role") == "system", F.concat(F.lit("**System:** "), F.col("content"))).otherwise(F.concat(
        F.lit("**Vision:** "), F.coalesce("vlm_answer", F.lit("None")), F.lit("\n**OCR:** "), F.coalesce("ocr_answer", F.lit("None"))))
    title = convs.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.concat(F.lit("# "), "title").alias("block"))
    return title.unionByName(messages.select("conv_id", "turn", block.alias("block")))


def history_markdown(files: DataFrame, messages: DataFrame) -> DataFrame:
    """A file's record as ordered blocks (sha256, conv_id, turn, block): a heading, then one block per question. Written
    sorted by these keys the blocks are the document; no record is assembled in memory."""
    t = document_history(files, messages)
    answer = F.when(F.col("answer_seq").isNull(), "No answer was saved for this question.").otherwise(F.concat(
        F.lit("**Vision model**: "), F.coalesce(F.btrim("vlm_answer"), F.lit("")), F.lit("\n\n**OCR + text model**: "),
        F.coalesce(F.btrim("ocr_answer"), F.lit(""))))
    body = t.select("sha256", "conv_id", "turn", F.concat(F.lit("### Q: "), "question", F.lit("\n\n"), answer).alias("block"))
    head = history_index(files, messages).select(
        "sha256", F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
        F.format_string("# %s\n\n%d pages, %d questions", "filename", "n_pages", "questions").alias("block"))
    return head.unionByName(body)


def backfill(items: DataFrame, results: DataFrame, keys: list[str], compute) -> DataFrame:
    """Results for every item: the stored ones, and ``compute`` over the items that have none."""
    return results.unionByName(compute(items.join(results.select(*keys), keys, "left_anti")))
