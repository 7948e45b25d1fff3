"""Preparing page text for inference: contexts, batches, chunks, merged parts, prompts."""
from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .ordering import positions, running
from .staging import staged

PAGES_PER_BLOCK = 4096
HEADER_MIN = len("--- Page 1 ---\n\n")  # no page block is shorter than its header


def page_block(page: Column, text: Column) -> Column:
    return F.concat(F.lit("--- Page "), (page + 1).cast("string"), F.lit(" ---\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def pages_label(first: Column, last: Column) -> Column:
    """0-based pages to a 1-based label."""
    a, b = (first + 1).cast("string"), (last + 1).cast("string")
    return F.when(first == last, F.concat(F.lit("page "), a)).otherwise(F.concat(F.lit("pages "), a, F.lit("-"), b))


def pages_within(budget: int) -> int:
    """So many of the best pages are enough for a context: no block is shorter than its header."""
    return budget // HEADER_MIN + 1


def build_context(pages: DataFrame, ranked: DataFrame, budget: int, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """One context per question: best pages first until one would exceed the budget, printed in page order. Of ``ranked`` the
    first ``pages_within(budget)`` pages are used, which bounds the running sum of a question however many pages its document
    has; more need not be ranked."""
    n = pages.groupBy(doc).agg(F.count("*").alias("_n"))
    reach = ranked.where(F.col("rank") < pages_within(budget)).select("qid", doc, page, "rank")
    blocks = reach.join(pages.select(doc, page, page_block(F.col(page), F.col(text)).alias("_b")), [doc, page])
    w = Window.partitionBy("qid", doc).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_cum", F.sum(F.length("_b")).over(w))
    first = F.col("rank") == 0
    kept = blocks.where((F.col("_cum") <= budget) | first).withColumn("_b", F.when(first, F.substring("_b", 1, budget)).otherwise(F.col("_b")))
    g = kept.groupBy("qid", doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_b").alias("b")))).alias("_s"))
    g = g.join(n, doc).join(blocks.where(first).select("qid", (F.col("_cum") > budget).alias("_cut")), "qid")
    return g.select("qid", doc, F.array_join(F.transform("_s", lambda x: x["b"]), "\n").alias("context"),
                    F.transform("_s", lambda x: x["p"]).alias("pages"), (F.col("_cut") | (F.size("_s") < F.col("_n"))).alias("truncated"))


def page_batches(pages: DataFrame, size: int, keys: list[str], page: str = "page") -> DataFrame:
    """Consecutive pages in groups of ``size``: (keys, batch, first, last, n, label)."""
    pos = positions(pages.select(*keys, page), keys, page, "_pos")
    g = pos.groupBy(*keys, F.floor(F.col("_pos") / max(size, 1)).alias("batch")).agg(
        F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n"))
    return g.withColumn("label", pages_label(F.col("first"), F.col("last")))


# ------------------------------------------------------------------------------------------------ chunks
# Packing pages greedily is sequential: where a chunk starts depends on all pages before it. What a block of pages does to
# the chunk that is open when it begins depends only on the page at which that chunk first breaks, so each block is reduced
# to a table: an open chunk of c characters breaks at the first i with c + breaks[i] > budget and leaves after[i] open at the
# block's end; without a break it grows by total; where none is open, the block leaves ``empty``. Two tables in a row make one
# table of the same form, no longer than the budget has page headers, so tables are composed in groups, level by level, until a
# document has one. The open sizes then come back down the same groups, and the blocks are packed independently.
def _walk(sizes, rests, longs, budget, cur, start=0):
    """Packs pages from ``start`` with an open chunk of ``cur`` characters (0: none). Returns which pages begin a chunk and
    the open chunk at the end."""
    begins = []
    for i in range(start, len(sizes)):
        fresh = longs[i] or cur == 0 or cur + 1 + sizes[i] > budget
        begins.append(bool(fresh))
        cur = rests[i] if fresh else cur + 1 + sizes[i]
    return begins, cur


def _left_open(table, budget: int, cur: int) -> int:
    """The chunk that a table (breaks, after, total, empty) leaves open."""
    breaks, after, total, empty = table
    if cur == 0:
        return int(empty)
    hit = bisect.bisect_right(breaks, budget - cur)  # breaks grow
    return int(after[hit]) if hit < len(breaks) else cur + int(total)


def _composed(a, b, budget: int):
    """What table ``b`` after table ``a`` does."""
    breaks, after = list(a[0]), [_left_open(b, budget, int(x)) for x in a[1]]
    if not breaks or breaks[-1] < budget:  # some open chunk still goes through ``a`` without a break
        breaks += [int(a[2]) + int(x) for x in b[0]]
        after += map(int, b[1])
    kept = [i for i in range(len(breaks)) if i == 0 or breaks[i - 1] < budget]
    return [breaks[i] for i in kept], [after[i] for i in kept], int(a[2]) + int(b[2]), _left_open(b, budget, int(a[3]))


def _summary(budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        sizes, rests, longs = (pdf[c].tolist() for c in ("size", "rest", "long"))
        n = len(sizes)
        nxt, out = [n] * n, [0] * n  # page at which a chunk begun at i breaks; the open chunk at the end of the block
        prefix = [0]
        for s in sizes:
            prefix.append(prefix[-1] + s + 1)
        next_long = n
        for i in range(n - 1, -1, -1):
            # the furthest page that still fits after i: binary search over the prefix sums, not beyond the next long page
            lo, hi = i + 1, next_long
            while lo < hi:
                mid = (lo + hi) // 2
                if rests[i] + prefix[mid + 1] - prefix[i + 1] > budget:
                    hi = mid
                else:
                    lo = mid + 1
            nxt[i] = lo
            out[i] = out[lo] if lo < n else rests[i] + prefix[n] - prefix[i + 1]
            if longs[i]:
                next_long = i
        breaks, after = [], []
        for i in range(n):  # an open chunk of c characters breaks first at the smallest i with c + breaks[i] > budget
            breaks.append(budget + 1 if longs[i] else prefix[i + 1])
            after.append(out[i])
            if longs[i] or prefix[i + 1] > budget:
                break
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "block": [pdf["block"].iloc[0]], "breaks": [breaks], "after": [after],
                             "total": [prefix[n]], "empty": [out[0]]})
    return run


TABLE = "doc string, block long, breaks array<long>, after array<long>, total long, empty long"
TABLES_PER_GROUP = 256


def _members(pdf: pd.DataFrame) -> list:
    return list(zip(pdf["breaks"], pdf["after"], pdf["total"], pdf["empty"]))


def _compose(budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        table, *others = _members(pdf)
        for t in others:
            table = _composed(table, t, budget)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "block": [pdf["group"].iloc[0]], "breaks": [list(table[0])], "after": [list(table[1])],
                             "total": [table[2]], "empty": [table[3]]})
    return run


def _pass_down(budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        cur, opens = int(pdf["open"].iloc[0]), []
        for t in _members(pdf):
            opens.append(cur)
            cur = _left_open(t, budget, cur)
        return pd.DataFrame({"doc": pdf["doc"], "block": pdf["block"], "open": opens})
    return run


def _opens(tables: DataFrame, budget: int, per_group: int) -> DataFrame:
    """(doc, block, open): the characters of the chunk that is open where each block begins."""
    levels, last = [], tables.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    while last > 0:
        grouped = tables.withColumn("group", F.floor(F.col("block") / per_group).cast("long"))
        levels.append(grouped)
        tables = staged(grouped.groupBy("doc", "group").applyInPandas(_compose(budget), TABLE), "tables")
        last //= per_group
    opens = tables.select("doc", "block", F.lit(0).cast("long").alias("open"))
    for grouped in reversed(levels):
        begun = grouped.join(opens.select("doc", F.col("block").alias("group"), "open"), ["doc", "group"])
        opens = begun.groupBy("doc", "group").applyInPandas(_pass_down(budget), "doc string, block long, open long")
    return opens


def _assign(budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        begins, _ = _walk(pdf["size"].tolist(), pdf["rest"].tolist(), pdf["long"].tolist(), budget, int(pdf["open"].iloc[0]))
        return pd.DataFrame({"doc": pdf["doc"], "page": pdf["page"], "pieces": pdf["pieces"], "begins": begins})
    return run


def chunk_starts(pages: DataFrame, budget: int, doc: str = "doc", page: str = "page", text: str = "text",
                 pages_per_block: int = PAGES_PER_BLOCK, tables_per_group: int = TABLES_PER_GROUP) -> DataFrame:
    """(doc, page, pieces, chunk): the chunk that holds the end of each page, and how many full pieces a page longer than
    the budget is cut into before that. Only lengths are shuffled, and no task sees more than a block of pages or a group of
    tables, however many pages a document has."""
    budget = max(budget, 200)
    head = F.length(F.concat(F.lit("--- Page "), (F.col(page) + 1).cast("string"), F.lit(" (continued) ---\n")))
    size = F.length(page_block(F.col(page), F.col(text)))
    p = pages.select(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), size.cast("long").alias("size"), head.cast("long").alias("_h"))
    p = p.withColumn("long", F.col("size") > budget)
    more = F.ceil((F.col("size") - budget) / (budget - F.col("_h")))
    p = p.withColumn("pieces", F.when(F.col("long"), more).otherwise(0).cast("long"))
    p = p.withColumn("rest", F.when(F.col("long"), F.col("_h") + F.col("size") - budget - (F.col("pieces") - 1) * (budget - F.col("_h")))
                     .otherwise(F.col("size")).cast("long"))
    p = p.withColumn("block", F.floor(F.col("page") / pages_per_block)).drop("_h")
    opens = _opens(staged(p.groupBy("doc", "block").applyInPandas(_summary(budget), TABLE), "tables"), budget, tables_per_group)
    m = p.join(opens, ["doc", "block"]).groupBy("doc", "block").applyInPandas(
        _assign(budget), "doc string, page long, pieces long, begins boolean")
    new = F.col("pieces") + F.col("begins").cast("long")
    out = running(m, ["doc"], [F.col("page")], {"_c": new}, F.floor(F.col("page") / 65536))
    return out.select(F.col("doc").alias(doc), F.col("page").alias(page), "pieces", (F.col("_c") - 1).alias("chunk"))


def text_chunks(pages: DataFrame, budget: int, doc: str = "doc", page: str = "page", text: str = "text",
                pages_per_block: int = PAGES_PER_BLOCK, tables_per_group: int = TABLES_PER_GROUP) -> DataFrame:
    """All text of a document in page order, cut into chunks of at most ``budget`` characters: (doc, chunk, text, pages).
    Nothing is dropped; a page longer than the budget continues under a header of its own."""
    starts = chunk_starts(pages, budget, doc, page, text, pages_per_block, tables_per_group)
    budget = max(budget, 200)
    j = pages.select(doc, page, page_block(F.col(page), F.col(text)).alias("_b")).join(starts, [doc, page])
    again = F.concat(F.lit("--- Page "), (F.col(page) + 1).cast("string"), F.lit(" (continued) ---\n"))
    j = j.withColumn("_again", again).withColumn("_room", budget - F.length("_again"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("pieces").cast("int")), lambda i: F.when(i == 0, F.substring("_b", 1, budget)).otherwise(
        F.concat("_again", F.substring(F.col("_b"), (budget + 1 + (i - 1) * F.col("_room")).cast("int"), F.col("_room").cast("int")))))
    whole = F.when(F.col("pieces") == 0, F.array(F.col("_b"))).otherwise(pieces)
    e = j.select(doc, page, "chunk", "pieces", F.posexplode(whole).alias("_i", "_t"))
    e = e.withColumn("chunk", F.col("chunk") - F.col("pieces") + F.col("_i"))
    g = e.groupBy(doc, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_i").alias("i"), F.col("_t").alias("t")))).alias("_s"))
    return g.select(doc, "chunk", F.array_join(F.transform("_s", lambda x: x["t"]), "\n").alias("text"),
                    F.array_distinct(F.transform("_s", lambda x: x["p"])).alias("pages"))


# ------------------------------------------------------------------------------------------------ parts and prompts
def merge_parts(partials: DataFrame, keys: list[str], part: str = "part", answer: str = "answer") -> DataFrame:
    """Answer per question from its parts: none found, the one found, or (two or more) the first one, marked as needing
    to be combined."""
    hit = ~T.is_not_found(F.col(answer)) & F.col(answer).isNotNull()
    g = partials.select(*keys, part, answer, hit.alias("_hit")).groupBy(*keys).agg(
        F.count_if("_hit").alias("found"), F.min_by(answer, F.when(F.col("_hit"), F.col(part))).alias("_first"),
        F.max("_hit").alias("_any"))
    return g.select(*keys, F.when(F.col("_any"), F.col("_first")).otherwise(T.NOT_FOUND).alias("answer"),
                    (F.col("found") > 1).alias("combined"), "found")


def prompt_table(parts: DataFrame, history: DataFrame | None, keys: list[str]) -> DataFrame:
    """One ready text per (question, part): document text, a note when it is only a part, earlier turns, the question.
    ``parts`` has keys, part, context, question, label (NULL for the whole document); ``history`` has keys, k (1 = newest),
    question, answer."""
    base = parts
    if history is not None:
        turn = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
        h = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), turn.alias("t")))).alias("_h"))
        base = base.join(h.select(*keys, F.concat(F.lit("Earlier turns:\n"), F.array_join(F.transform("_h", lambda x: x["t"]), "\n"),
                                                  F.lit("\n\n")).alias("_history")), keys, "left")
    else:
        base = base.withColumn("_history", F.lit(None).cast("string"))
    note = F.concat(F.lit("This is only "), F.col("label"), F.lit(" of the document. If it does not help, reply: "), F.lit(T.NOT_FOUND), F.lit("\n\n"))
    return base.select(*keys, "part", F.concat(
        F.lit("Document text:\n"), F.col("context"), F.lit("\n\n"), F.coalesce(note, F.lit("")), F.coalesce("_history", F.lit("")),
        F.lit("Question: "), F.col("question")).alias("prompt"))


def answer_with(prompts: DataFrame, fn: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Fills ``answer`` with the user's own batch function over prompt texts (Arrow batches, no rows through the driver)."""
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType())])

    def batches(it):
        for pdf in it:
            yield pdf.assign(answer=fn(pdf["prompt"]).astype("string"))

    return prompts.mapInPandas(batches, schema)


def usage(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pages used, characters of context, truncation and times per question. ``parts`` has keys, pages, chars, truncated,
    ocr_ms, model_ms. Page sets are deduplicated before they are shuffled."""
    sums = parts.groupBy(*keys).agg(
        F.count("*").alias("parts"), F.sum("chars").alias("context_chars"), F.max("truncated").alias("truncated"),
        F.sum("ocr_ms").alias("ocr_ms"), F.sum("model_ms").alias("model_ms"))
    used = parts.select(*keys, F.explode("pages").alias("_p")).groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("pages"))
    return sums.join(used, keys, "left").withColumn("total_ms", F.col("ocr_ms") + F.col("model_ms"))
