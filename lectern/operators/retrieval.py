"""Page ranking and selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .joins import FEW, join_few
from .ordering import running, smallest
from .staging import staged


def matching_lines(lines: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that contain an answer keyword, with their size in characters and words. The join side is the short answers."""
    kw = answers.select(*keys, T.answer_keywords(F.col("answer")).alias("_kw")).where(F.size("_kw") > 0)
    low = F.lower(F.col("text"))
    hit = lines.join(kw, keys).where(F.exists("_kw", lambda w: F.contains(low, w)))
    words = F.array_remove(F.split(F.btrim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), "")
    return hit.select(*lines.columns, F.length("text").cast("long").alias("chars"), F.size(words).cast("long").alias("words"))


# ------------------------------------------------------------------------------------------ BM25

EVERY = ""  # stands for the page itself among its terms; no token is empty
PAGES_PER_BLOCK = 256
FIRST_BLOCKS = 4
K1, B = 1.5, 0.75


def postings(pages: DataFrame, wanted: DataFrame | None = None, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, dl, term, tf): the terms of every page, and one row per page with the term ``EVERY``, which keeps its length.
    Texts are cut into tokens once. With ``wanted`` (doc, term), other terms are dropped before anything is shuffled."""
    t = pages.select(doc, page, T.bm25_tokens(F.col(text)).alias("_t"))
    rows = t.select(doc, page, F.size("_t").alias("dl"), F.explode(F.concat(F.array(F.lit(EVERY)), "_t")).alias("term"))
    if wanted is not None:
        rows = join_few(rows, wanted, [doc, "term"], "left_semi", [page])
    return staged(rows.groupBy(doc, page, "dl", "term").agg(F.count("*").alias("tf")), "postings")


def bm25_stats(posted: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages and mean length per document."""
    return posted.where(F.col("term") == EVERY).groupBy(doc).agg(F.count("*").alias("n_pages"), F.avg("dl").alias("avgdl"))


def idf(n_pages: Column, df: Column) -> Column:
    return F.log(1 + (n_pages - df + 0.5) / (df + 0.5))


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's count on a page of ``dl`` tokens adds per unit of weight: grows with ``tf``, falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.when(dl > 0, dl).otherwise(1) / F.when(avgdl > 0, avgdl).otherwise(1.0)))


def counted(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, as an array of (term, tf): tokens are sorted, and each ends where the next differs."""
    def runs(t: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i == F.size(t)) | (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return T.bind(ends, lambda e: F.transform(F.slice(e, 2, F.size(t)), lambda end, k: F.struct(
            F.get(t, end - 1).alias("term"), (end - F.get(e, k)).cast("long").alias("tf"))))

    return T.bind(F.sort_array(tokens), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>")))


def page_terms(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, page, dl, term, tf) and (doc, page, dl): the terms of every page, and the pages. Terms are counted inside the row and stay in it
    until they are read; only rows that share page and length are added up, as one page."""
    t = pages.select(doc, page, T.bm25_tokens(F.col(text)).alias("_t")).select(doc, page, F.size("_t").alias("dl"), counted(F.col("_t")).alias("_c"))
    t = staged(t.withColumn("_h", F.xxhash64(doc, page, "dl")), "page_terms")
    again = staged(t.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "again")
    rows = lambda x: x.select(doc, page, "dl", F.inline("_c"))
    if again.isEmpty():
        return rows(t), t.select(doc, page, "dl")
    one, more = join_few(t, again, ["_h"], "left_anti", [page]), join_few(t, again, ["_h"], "left_semi", [page])
    return (rows(one).unionByName(rows(more).groupBy(doc, page, "dl", "term").agg(F.sum("tf").alias("tf"))),
            t.select(doc, page, "dl").distinct())


def bm25_index(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", few: int = FEW) -> DataFrame:
    """(doc, page, term) with tf, dl, df, idf, n_pages, avgdl. The ``few`` terms on most pages of their document, which make up most of
    the rows, are sent to the rows with their df; the rows of the others are shuffled once and counted by term. None of those terms is
    on many pages, so no task is crowded."""
    terms, own = page_terms(pages, doc, page, text)
    stats = own.groupBy(doc).agg(F.count("*").alias("n_pages"), F.avg("dl").alias("avgdl"))
    level = F.floor(4 * F.log2("df"))
    df = staged(terms.groupBy(doc, "term").agg(F.count("*").alias("df")), "df")
    cut, total = None, 0
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > few:
            break
        cut = r.level
    often = df.where(F.lit(False) if cut is None else level >= cut)
    found = terms.join(F.broadcast(often), [doc, "term"])
    if total > few:
        rare = terms.join(F.broadcast(often), [doc, "term"], "left_anti")
        found = found.unionByName(rare.withColumn("df", F.count("*").over(Window.partitionBy(doc, "term"))))
    return join_few(found, stats, [doc], salt=[page, "term"]).select(
        doc, page, "term", "tf", F.col("dl").cast("long").alias("dl"), "df", "n_pages", "avgdl", idf(F.col("n_pages"), F.col("df")).alias("idf"))


def _weighted(pages: DataFrame, queries: DataFrame, doc: str, page: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the documents' question terms, and (qid, doc, term, w, avgdl); repeated terms of a question count again."""
    q = queries.select("qid", doc, F.explode(T.bm25_tokens(F.col("question"), drop_stop=True)).alias("term"))
    q = q.groupBy("qid", doc, "term").agg(F.count("*").alias("qf"))
    asked = queries.select(doc, F.lit(EVERY).alias("term"))
    posted = postings(pages, q.select(doc, "term").union(asked).distinct(), doc, page, text)
    df = posted.where(F.col("term") != EVERY).groupBy(doc, "term").agg(F.count("*").alias("df"))
    # A row per term of a question; the tables beside it have one row per term and per document.
    weights = join_few(join_few(q, df, [doc, "term"], salt=["qid"]), bm25_stats(posted, doc), [doc], salt=["qid", "term"])
    return posted, staged(weights.select("qid", doc, "term", (F.col("qf") * idf(F.col("n_pages"), F.col("df"))).alias("w"), "avgdl"), "weights")


def _summed(parts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Scores, rounded so that copies of a page tie. Terms are added as decimals, since a sum of doubles depends on the order in which a
    shuffle delivers them, and near a rounding edge the copies of a page would fall apart."""
    part = (F.col("w") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))).cast("decimal(28,18)")
    return parts.groupBy(*keys).agg(S.rounded(F.sum(part).cast("double"), 10).alias(name))


def bm25_scores(pages: DataFrame, queries: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(qid, doc, page, score) of the pages that share a term with their document's question."""
    posted, weights = _weighted(pages, queries, doc, page, text)
    return _scores(posted, weights, doc, page)


def _scores(posted: DataFrame, weights: DataFrame, doc: str, page: str) -> DataFrame:
    return _summed(join_few(posted.where(F.col("term") != EVERY), weights, [doc, "term"], salt=[page]), ["qid", doc, page], "score")


def bm25_rank(pages: DataFrame, queries: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """Every page of each question's document with its rank (0 = best; ties and pages without a hit in page order). No
    document is sorted in one task: matched pages are placed by counting better scores, unmatched pages follow in page order,
    both slice by slice."""
    posted, weights = _weighted(pages, queries, doc, page, text)
    every = join_few(posted.where(F.col("term") == EVERY).select(doc, page), queries.select("qid", doc), [doc], salt=[page])
    full = every.join(_scores(posted, weights, doc, page), ["qid", doc, page], "left").na.fill(0.0, ["score"])
    return sliced_rank(full, ["qid", doc], page)


def sliced_rank(full: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Rank by (score desc, page) without a task per group. Distinct scores are counted first (copies of a page collapse
    there) and add up from the best one down over sampled ranges; within one score, pages are numbered in slices of page numbers."""
    levels = full.groupBy(*keys, "score").agg(F.count("*").alias("_c"))
    above = running(levels, keys, [F.desc("score")], {"_upto": F.col("_c")})
    above = above.select(*[F.col(k).alias(f"_x_{k}") for k in keys], F.col("score").alias("_x_score"), (F.col("_upto") - F.col("_c")).alias("_above"))
    tied = running(full, [*keys, "score"], [F.col(page)], {"_at": F.lit(1).cast("long")}, F.floor(F.col(page) / 65536))
    on = (tied["score"] == above["_x_score"])
    for k in keys:
        on = on & (tied[k] == above[f"_x_{k}"])
    return tied.join(above, on).select(*keys, page, "score", (F.col("_above") + F.col("_at") - 1).alias("rank"))


def select_pages(ranked: DataFrame, cap: int) -> DataFrame:
    """The best ``cap`` pages (at least one)."""
    return ranked.where(F.col("rank") < max(cap, 1))


def top_pages(pages: DataFrame, queries: DataFrame, cap: int, doc: str = "doc", page: str = "page", text: str = "text",
              pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """The best ``cap`` pages per question, the same as those of the full ranking, without scoring all pages.

    Pages are taken in blocks. A block's largest count and shortest page bound what a term can add in it, so the terms of a question
    bound what it can score there. The blocks of the highest bounds are scored first; blocks that cannot reach the ``cap``-th score
    found in them are never joined with the postings. Partial top lists are merged in two steps, salted by page. Unmatched pages only
    fill up what is left, in page order, and of those the first ``cap`` of a document are enough."""
    cap = max(cap, 1)
    posted, weights = _weighted(pages, queries, doc, page, text)
    hits = posted.where(F.col("term") != EVERY).withColumn("_block", F.floor(F.col(page) / pages_per_block))
    peaks = hits.groupBy(doc, "term", "_block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    bounds = staged(_summed(join_few(peaks, weights, [doc, "term"], salt=["_block"]), ["qid", doc, "_block"], "bound"), "bounds")
    tops = smallest(bounds, ["qid", doc], F.struct((-F.col("bound")).alias("o"), "_block"), FIRST_BLOCKS, "_block")
    first = staged(tops.select("qid", doc, F.explode("_best").alias("_b")).select("qid", doc, F.col("_b._block").alias("_block")), "first")

    def scored(blocks: DataFrame) -> DataFrame:
        terms = blocks.join(weights, ["qid", doc])  # a question's terms for each of its blocks
        return _summed(hits.join(terms, [doc, "term", "_block"]), ["qid", doc, page], "score")

    begun = staged(scored(first), "scores")
    least = smallest(begun, ["qid", doc], F.struct((-F.col("score")).alias("o")), cap, page).select(
        "qid", doc, (-F.get("_best", F.lit(cap - 1))["o"]).alias("_least"))
    rest = bounds.join(least, ["qid", doc]).where(F.col("bound") >= F.coalesce("_least", F.lit(0.0)) - 1e-9).select("qid", doc, "_block").join(
        first, ["qid", doc, "_block"], "left_anti")
    scores = staged(begun.unionByName(scored(rest)), "scores")
    own = posted.where(F.col("term") == EVERY).select(doc, page)
    leading = smallest(own, [doc], F.struct(F.col(page)), cap, page).select(doc, F.explode("_best").alias("_b")).select(doc, F.col(f"_b.{page}").alias(page))
    filler = join_few(leading, queries.select("qid", doc), [doc], salt=[page]).join(scores.select("qid", doc, page), ["qid", doc, page], "left_anti")
    cand = scores.unionByName(filler.withColumn("score", F.lit(0.0)))
    best = smallest(cand, ["qid", doc], F.struct((-F.col("score")).alias("_neg"), F.col(page)), cap, page)
    out = best.select("qid", doc, F.posexplode("_best").alias("rank", "_b"))
    return out.select("qid", doc, F.col(f"_b.{page}").alias(page), (-F.col("_b._neg") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


def page_policy(pages: DataFrame, queries: DataFrame, read_all: bool, cap: int, match_pages: bool, doc: str = "doc", page: str = "page",
                text: str = "text") -> DataFrame:
    """(qid, doc, page, vlm, ocr): which pages each reader gets, for every page of a question's document. Documents of at most
    ``cap`` pages are read whole, of others the best ``cap`` pages; the second reader follows the first one's pages only when
    asked to."""
    n = pages.groupBy(doc).agg(F.count("*").alias("_n"))
    asked = queries.select("qid", doc)
    every = join_few(pages.select(doc, page), join_few(asked, n, [doc], salt=["qid"]), [doc], salt=[page])
    if read_all:
        vlm = F.lit(True)
    else:
        best = top_pages(pages, queries, cap, doc, page, text).select("qid", doc, page, F.lit(True).alias("_best"))
        every = every.join(best, ["qid", doc, page], "left")
        vlm = (F.col("_n") <= cap) | F.coalesce("_best", F.lit(False))
    return every.select("qid", doc, page, vlm.alias("vlm"), (vlm if match_pages else F.lit(True)).alias("ocr"))


# ------------------------------------------------------------------------------------------ stand-in reader
def lexical_answer(pages: DataFrame, queries: DataFrame, keys: list[str], text: str = "text", split: str = r"\n+",
                   max_len: int | None = None) -> DataFrame:
    """The line that shares most distinct words with the question (share / sqrt of question words, first one wins), or
    the not-found sentence; cut only if ``max_len`` is given. Lines come in the order of the other columns of ``pages``, then by
    place. Each line is cut into tokens once, however many questions its document has; only the words asked for leave it, and
    only the chosen lines are read again."""
    order = [c for c in pages.columns if c not in (text, *keys)]
    q = staged(queries.select("qid", *keys, F.array_distinct(T.bm25_tokens(F.col("question"), drop_stop=True)).alias("_q")), "questions")
    terms = q.select("qid", *keys, F.size("_q").alias("_nq"), F.explode("_q").alias("term"))
    lines = pages.select(*keys, *order, F.posexplode(F.split(F.col(text), split)).alias("_pos", "_line"))
    words = lines.select(*keys, *order, "_pos", F.explode(F.array_distinct(T.bm25_tokens(F.col("_line")))).alias("term"))
    hits = join_few(words, terms, [*keys, "term"], salt=[*order, "_pos"]).groupBy("qid", *keys, *order, "_pos", "_nq").agg(F.count("*").alias("_h"))
    best = hits.groupBy("qid", *keys).agg(F.max_by(F.struct(*order, "_pos", "_h", "_nq"), F.struct(
        F.col("_h"), *[(-F.col(c)).alias(c) for c in order], -F.col("_pos"))).alias("m")).select("qid", *keys, "m.*")
    found = join_few(pages, best, [*keys, *order], salt=order).select(
        "qid", F.btrim(F.get(F.split(F.col(text), split), F.col("_pos"))).alias("_line"), "_h", "_nq")
    out = q.select("qid").join(found, "qid", "left")
    hit = F.col("_h").isNotNull()
    return out.select("qid", F.when(hit, F.col("_line") if max_len is None else F.substring("_line", 1, max_len)).otherwise(T.NOT_FOUND).alias("answer"),
                      F.when(hit, F.col("_h") / F.sqrt("_nq")).otherwise(0.0).alias("score"))
