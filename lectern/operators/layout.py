"""OCR lines on pages: reading order, layout, where an answer stands, evidence and trust.

``lines`` has the page keys, line_no, text, score, x0, y0, x1, y1 in pixels.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .joins import join_few
from .ordering import smallest
from .staging import staged
from .support import NEAREST, cover, near_words, survives  # noqa: F401

LOW_CONFIDENCE = 0.9


def _height() -> Column:
    return F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))


# ------------------------------------------------------------------------------------------------ reading order
def lines_to_text(lines: DataFrame, keys: list[str], col_gap: float = 2.5) -> DataFrame:
    """Page text in reading order. Boxes go top to bottom; a box starts a new line when its centre is more than 0.6 median
    heights from the running mean of the open line; wide gaps inside a line become " | ".

    The running mean makes this a fold over one page's boxes, done on the page's own sorted array; a page is the unit that
    is printed and scanned, not a key that collects rows.
    """
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "line_no", "x1", "text", _height().alias("h"))
    p = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"))
    hs = F.array_sort(F.transform("b", lambda x: x["h"]))
    n = F.size("b")
    mid = (F.get("h", ((n - 1) / 2).cast("int")) + F.get("h", (n / 2).cast("int"))) / 2
    p = p.withColumn("h", hs).withColumn("med", mid)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("ids"))

    def place(acc, x):
        fresh = (acc["n"] == 0) | (F.abs(x["cy"] - acc["sum"] / acc["n"]) > 0.6 * F.col("med"))
        line = acc["line"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            F.when(fresh, x["cy"]).otherwise(acc["sum"] + x["cy"]).alias("sum"), F.when(fresh, 1).otherwise(acc["n"] + 1).alias("n"),
            line.alias("line"), F.concat(acc["ids"], F.array(line)).alias("ids"))

    p = p.withColumn("ids", F.aggregate("b", start, place, lambda acc: acc["ids"]))
    boxes = F.zip_with("ids", "b", lambda i, x: F.struct(i.alias("line"), x["x0"].alias("x0"), x["cy"].alias("cy"), x["line_no"].alias("no"),
                                                         x["x1"].alias("x1"), x["text"].alias("t")))
    p = p.select(*keys, "med", F.array_sort(boxes).alias("b"))
    first = F.struct(F.lit("").alias("s"), F.lit(-1).alias("line"), F.lit(0.0).alias("x1"))

    def write(acc, x):
        gap = F.when(x["x0"] - acc["x1"] > col_gap * F.col("med"), " | ").otherwise(" ")
        sep = F.when(acc["line"] < 0, "").when(acc["line"] != x["line"], "\n").otherwise(gap)
        return F.struct(F.concat(acc["s"], sep, x["t"]).alias("s"), x["line"].alias("line"), x["x1"].alias("x1"))

    return p.select(*keys, F.aggregate("b", first, write, lambda acc: acc["s"]).alias("text"))


def mean_confidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.avg("score").alias("mean_conf"), F.count("*").alias("n_lines"))


# ------------------------------------------------------------------------------------------------ layout
def _four_places(x: Column) -> Column:
    """Four places, halves to even, all in doubles as the SQL has it: a half is what the multiplication makes one, whatever the shortest
    decimal form of ``x`` says."""
    return F.rint(x * 10000.0) / 10000.0


def with_layout(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds med_h, width, height, layout, small and the normalised box. Centres are measured in median heights, so
    neighbours on the same and on nearby lines are range frames along the page, not a join of the page with itself."""
    page = Window.partitionBy(*keys)
    out = lines.withColumn("med_h", F.median(_height()).over(page))
    out = out.withColumn("width", F.greatest(F.max("x1").over(page), F.lit(1.0))).withColumn("height", F.greatest(F.max("y1").over(page), F.lit(1.0)))
    out = out.withColumn("_u", F.round((F.col("y0") + F.col("y1")) / 2 / F.col("med_h") * 1000000).cast("long"))
    along = page.orderBy("_u")
    out = out.withColumn("_band", F.count("*").over(along.rangeBetween(-599999, 599999)))
    out = out.withColumn("_near", F.count("*").over(along.rangeBetween(-2999999, 2999999)))
    layout = F.when((F.col("_band") >= 3) & (F.col("_near") - F.col("_band") >= 3), "table").when(F.col("_band") >= 2, "form").otherwise("text")
    frac = [_four_places(F.col(c) / F.col(s)) for c, s in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))]
    return out.select(*lines.columns, "med_h", "width", "height", layout.alias("layout"),
                      (F.col("y1") - F.col("y0") < 0.75 * F.col("med_h")).alias("small"), F.array(*frac).alias("box"))


def region_of(boxes: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, kind): the last rectangle of the page (by ``ord``) that holds the box's centre; ``layout`` when none
    does. ``rects`` has keys, ord, kind, rect."""
    cx, cy = (F.get("box", F.lit(0)) + F.get("box", F.lit(2))) / 2, (F.get("box", F.lit(1)) + F.get("box", F.lit(3))) / 2
    r = lambda i: F.get("rect", F.lit(i))
    inside = cx.between(r(0), r(2)) & cy.between(r(1), r(3))
    hit = boxes.join(rects, keys).where(inside).groupBy(*keys, "line_no").agg(F.max_by("kind", "ord").alias("_kind"))
    return boxes.join(hit, [*keys, "line_no"], "left").select(*keys, "line_no", F.coalesce("_kind", "layout").alias("kind"))


# ------------------------------------------------------------------------------------------------ where an answer stands
def line_tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.select(*keys, "line_no", F.explode(T.vocab(F.col("text"))).alias("token"))


def search_keys(answer: Column) -> Column:
    """Content keys, or all tokens of answers that have none ("no", "yes")."""
    return T.bind_all(lambda k, t: F.when(F.size(k) > 0, k).otherwise(t), T.keys(answer), T.unprefixed(T.tokens(answer)))


def key_hits(asks: DataFrame, lines: DataFrame, ask: list[str], keys: list[str], terms: str = "terms") -> DataFrame:
    """(ask, keys, line_no, ord, term, exact, read_as): lines that hold a term of the ask as written, or a likely
    misreading of it. A line meets the words asked of its page before it is cut into tokens; only hits are shuffled after that."""
    q = asks.select(*ask, *keys, F.posexplode(terms).alias("ord", "term"))
    wanted = q.groupBy(*keys).agg(F.collect_set("term").alias("_terms")).hint("shuffle_hash")
    words = lines.select(*keys, "line_no", "text").join(wanted, keys).select(*keys, "line_no", "_terms", T.vocab(F.col("text")).alias("_words"))
    read = near_words(words, [*keys, "line_no"], "_terms", "_words", same=True).groupBy(*keys, "line_no", "a").agg(F.min(F.expr(NEAREST)).alias("m"))
    read = read.select(*keys, "line_no", F.col("a").alias("term"), (F.col("m.k") == -2).alias("exact"), F.when(F.col("m.k") > -2, F.col("m.b")).alias("read_as"))
    return q.join(read, [*keys, "term"]).select(*ask, *keys, "line_no", "ord", "term", "exact", "read_as")


def locate_answer(asks: DataFrame, lines: DataFrame, ask: list[str], keys: list[str], answer: str = "answer") -> DataFrame:
    """The line of the page that holds most of an answer: words as written count 1, likely misreadings 0.75. When no line
    holds half of them, the first line that contains the answer with its spaces lost. One row per located answer:
    (ask, keys, line_no, text, conf, layout, small, misreads, merged, box)."""
    q = staged(asks.select(*ask, *keys, F.col(answer).alias("_a"), search_keys(F.col(answer)).alias("terms")), "searched")
    # A line that has all words as written cannot be beaten, and to find it no line without them has to be cut into tokens. Misreadings
    # are looked for only where there is none.
    asked = q.where(F.size("terms") > 0).select(*ask, *keys, "terms")
    there = lines.select(*keys, "line_no", "text", "score").join(asked.hint("shuffle_hash"), keys).where(T.may_hold(F.col("text"), F.col("terms")))
    there = there.where(F.size(F.array_except("terms", T.vocab(F.col("text")))) == 0)
    reads = F.array().cast("array<struct<ord:int,r:string>>")
    whole = staged(there.groupBy(*ask, *keys).agg(F.max_by(
        F.struct("line_no", F.size("terms").cast("double").alias("hits"), reads.alias("_m")), F.struct("score", (-F.col("line_no")).alias("o"))).alias("m")), "whole")
    hits = key_hits(asked.join(whole.select(*ask, *keys), [*ask, *keys], "left_anti"), lines, ask, keys)
    per_line = hits.groupBy(*ask, *keys, "line_no").agg(
        F.sum(F.when(F.col("exact"), 1.0).otherwise(0.75)).alias("hits"),
        F.array_sort(F.collect_list(F.when(~F.col("exact"), F.struct("ord", F.concat_ws(">", "term", "read_as").alias("r"))))).alias("_m"))
    laid = with_layout(lines, keys)
    cand = per_line.join(lines.select(*keys, "line_no", "score"), [*keys, "line_no"])
    best = cand.groupBy(*ask, *keys).agg(F.max_by(
        F.struct("line_no", "hits", "_m"), F.struct("hits", "score", (-F.col("line_no")).alias("o"))).alias("m")).unionByName(whole)
    located = staged(q.join(best, [*ask, *keys], "left"), "located")
    good = F.coalesce(F.col("m.hits") / F.size("terms") >= 0.5, F.lit(False))
    located = located.withColumn("_ok", good)
    lost = located.where(~F.col("_ok") & (F.size("terms") > 0)).select(*ask, *keys, T.alnum(F.col("_a")).alias("_flat")).where(F.length("_flat") >= 4)
    glued = lines.select(*keys, "line_no", "text").join(lost.hint("shuffle_hash"), keys).where(
        F.contains(T.alnum(F.col("text")), F.col("_flat"))).groupBy(*ask, *keys).agg(F.min("line_no").alias("_glued"))
    none = F.array().cast("array<string>")
    picked = located.join(glued, [*ask, *keys], "left").select(
        *ask, *keys, F.when(F.col("_ok"), F.col("m.line_no")).otherwise(F.col("_glued")).alias("line_no"),
        F.when(F.col("_ok"), F.transform("m._m", lambda x: x["r"])).otherwise(none).alias("misreads"), (~F.col("_ok")).alias("merged"))
    return picked.where("line_no IS NOT NULL").join(
        laid.select(*keys, "line_no", "text", F.bround("score", 3).alias("conf"), "layout", "small", "box"), [*keys, "line_no"])


def ocr_evidence(asks: DataFrame, lines: DataFrame, ask: list[str], doc: str, page: str, answer: str = "answer", limit: int = 3) -> DataFrame:
    """Lines with most of an answer's key words, all on the page of the best one: (ask, page, rank, line_no, hits)."""
    q = asks.select(*ask, doc, F.explode(F.array_distinct(T.keys(F.col(answer)))).alias("token"))
    hit = q.join(line_tokens(lines, [doc, page]), [doc, "token"]).groupBy(*ask, doc, page, "line_no").agg(F.count("*").alias("hits"))
    hit = hit.join(lines.select(doc, page, "line_no", "score"), [doc, page, "line_no"])
    order = F.struct((-F.col("hits")).alias("h"), (-F.col("score")).alias("s"), page, "line_no")
    top = hit.groupBy(*ask).agg(F.min(order).alias("_t")).select(*ask, F.col(f"_t.{page}").alias(page))
    best = smallest(hit.join(top, [*ask, page]), ask, order, limit, "line_no", salts=16)
    return best.select(*ask, F.posexplode("_best").alias("rank", "b")).select(
        *ask, F.col(f"b.{page}").alias(page), "rank", "b.line_no", (-F.col("b.h")).alias("hits"), F.bround(-F.col("b.s"), 3).alias("score"))


KEYS_AT_ONCE = 64  # a document's lines are searched for so many keys one by one; of more, only those that a word's letters can begin


def _grams(word: Column) -> Column:
    n = F.length(word)

    def runs(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, F.lit(k)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(2), runs(3)))


def printed_keys(keys: DataFrame, words: DataFrame, doc: str, page: str, most: int = KEYS_AT_ONCE) -> DataFrame:
    """(doc, page, line_no, key) of the lines in which a key of their document (``keys``: doc, key) is printed. Keys go to the lines, so
    texts and their words are not shuffled while the keys can be broadcast. A document of more than ``most`` keys has each word looked up
    by its letters, so that its keys are not all compared with every line."""
    keys = staged(keys.where(F.length("key") >= 2).distinct(), "keys")
    many = staged(keys.groupBy(doc).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(doc), "many")
    at = [doc, page, "line_no"]
    low = words.select(*at, F.lower("text").alias("_t"))
    listed = join_few(keys, many, [doc], "left_anti", ["key"]).groupBy(doc).agg(F.collect_list("key").alias("_ks"))
    found = join_few(low, listed, [doc], salt=[page, "line_no"]).select(*at, F.explode(F.filter("_ks", lambda key: F.contains("_t", key))).alias("key"))
    if many.isEmpty():
        return found
    begun = join_few(keys, many, [doc], "left_semi", ["key"]).withColumn("_g", F.substring("key", 1, 3))
    word = join_few(low, many, [doc], "left_semi", [page, "line_no"]).select(*at, F.explode(F.array_distinct(F.split("_t", r"(?U)\s+"))).alias("word"))
    grams = word.where("word <> ''").select(*at, "word", F.explode(_grams(F.col("word"))).alias("_g"))
    looked_up = join_few(grams, begun, [doc, "_g"], salt=[page, "line_no"]).where(F.contains("word", F.col("key")))
    return found.unionByName(looked_up.select(*at, "key"))


def reference_evidence(asks: DataFrame, words: DataFrame, ask: list[str], doc: str, page: str, answer: str = "answer", limit: int = 4) -> DataFrame:
    """Where the reference prints an answer's words (anywhere inside a word, any case): the page with most distinct ones,
    first on ties, how many are printed there, and its first hits with their boxes as fractions of the page: (ask, page, keys_printed, rank, line_no, key,
    box). Of a key on a page only the first ``limit`` lines can be among the first hits, so no others leave the task that reads them."""
    k = staged(asks.select(*ask, doc, F.posexplode(T.keys(F.col(answer))).alias("ord", "key")).where(F.length("key") >= 2), "asked")
    first = Window.partitionBy(doc, page, "key").orderBy("line_no")
    at = printed_keys(k.select(doc, "key"), words, doc, page).withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= limit).drop("_n").distinct()
    hit = staged(k.join(at, [doc, "key"]).drop(doc), "hits")
    best = hit.groupBy(*ask, page).agg(F.count_distinct("key").alias("n")).groupBy(*ask).agg(
        F.min(F.struct((-F.col("n")).alias("n"), page)).alias("_t")).select(*ask, F.col(f"_t.{page}").alias(page))
    there = hit.join(best, [*ask, page])
    printed = there.groupBy(*ask).agg(F.count_distinct("key").alias("keys_printed"))
    top = smallest(there, ask, F.struct("ord", "line_no", "key", page), limit, "line_no", salts=16).join(printed, ask)
    hits = top.select(*ask, "keys_printed", F.posexplode("_best").alias("rank", "b")).select(
        *ask, F.col(f"b.{page}").alias(page), "keys_printed", "rank", "b.line_no", "b.key").join(asks.select(*ask, doc), ask)
    size = words.groupBy(doc, page).agg(F.greatest(F.max("x1"), F.lit(1.0)).alias("_w"), F.greatest(F.max("y1"), F.lit(1.0)).alias("_h"))
    part = [_four_places(F.col(c) / F.col(s)) for c, s in (("x0", "_w"), ("y0", "_h"), ("x1", "_w"), ("y1", "_h"))]
    return hits.join(words.select(doc, page, "line_no", "x0", "y0", "x1", "y1"), [doc, page, "line_no"]).join(size, [doc, page]).select(
        *ask, page, "keys_printed", "rank", "line_no", "key", F.array(*part).alias("box"))


def texts_without_evidence(evidence: DataFrame, asks: DataFrame, lines: DataFrame, pages: DataFrame, ask: list[str], doc: str, page: str, text: str = "text") -> DataFrame:
    """(ask, page, text): the page that an answer's evidence (of ``ocr_evidence``) stands on, without the lines of the evidence."""
    at = evidence.select(*ask, page, "rank", "line_no").join(asks.select(*ask, doc), ask)
    said = at.join(lines.select(doc, page, "line_no", F.col("text").alias("_line")), [doc, page, "line_no"])
    gone = said.groupBy(*ask, doc, page).agg(F.array_sort(F.collect_list(F.struct("rank", "_line"))).alias("_e"))
    return gone.join(pages.select(doc, page, F.col(text).alias("_text")), [doc, page]).select(
        *ask, page, remove_evidence(F.col("_text"), F.transform("_e", lambda x: x["_line"])).alias("text"))


def same_place(asks: DataFrame, ask: list[str], a_page: str, a_box: str, others: DataFrame, b_page: str, b_box: str) -> DataFrame:
    """(ask, place): same place, same page or different pages; NULL when either side has nothing."""
    j = asks.select(*ask, a_page, a_box).join(others.select(*ask, b_page, b_box), ask, "left")
    both = F.col(a_page).isNotNull() & F.col(b_page).isNotNull()
    on_page = both & (F.col(a_page) == F.col(b_page))
    level = F.when(on_page & G.overlaps(F.col(a_box), F.col(b_box)), 3).when(on_page, 2).when(both, 1)
    g = j.groupBy(*ask).agg(F.max(level).alias("_l"))
    return g.select(*ask, F.when(F.col("_l") == 3, "same place").when(F.col("_l") == 2, "same page").when(F.col("_l") == 1, "different pages").alias("place"))


def arbitrate(a: Column, b: Column, text: Column) -> Column:
    """Struct(supports, vlm_not_seen, ocr_not_seen, vlm_confirmed, ocr_confirmed): only words of one answer alone are looked
    for in a closer reading; a side loses when exactly it has unseen ones."""
    def judge(kv, ko, seen):
        dv, do = F.array_except(kv, ko), F.array_except(ko, kv)
        return F.struct(F.array_sort(F.array_except(dv, seen)).alias("mv"), F.array_sort(F.array_except(do, seen)).alias("mo"),
                        F.array_sort(F.array_intersect(dv, seen)).alias("cv"), F.array_sort(F.array_intersect(do, seen)).alias("co"))

    return T.bind(T.bind_all(judge, T.keys(a), T.keys(b), T.vocab(text)), lambda x: F.struct(
        F.when((F.size(x["mo"]) > 0) & (F.size(x["mv"]) == 0), "vlm").when((F.size(x["mv"]) > 0) & (F.size(x["mo"]) == 0), "ocr").alias("supports"),
        x["mv"].alias("vlm_not_seen"), x["mo"].alias("ocr_not_seen"), x["cv"].alias("vlm_confirmed"), x["co"].alias("ocr_confirmed")))


def remove_evidence(text: Column, evidence: Column) -> Column:
    """The text without the given lines."""
    return F.aggregate(evidence, text, lambda acc, line: F.replace(acc, line, F.lit("")))


# ------------------------------------------------------------------------------------------------ trust
def trust(asks: DataFrame) -> DataFrame:
    """Adds recommended, trust, trust_level, reasons from verdict, winner, has_reference, vlm_support, ocr_support, place,
    closer (side a closer look supports), vlm_survived, ocr_survived."""
    w, closer = F.col("winner"), F.col("closer")
    rec = F.when(w.isin("vlm", "ocr"), w).when(closer.isNotNull(), closer).when(F.col("verdict") == "consistent", "vlm")
    out = asks.withColumn("recommended", rec)
    support = F.when(F.col("recommended") == "vlm", F.col("vlm_support")).otherwise(F.col("ocr_support"))
    survived = F.when(F.col("recommended") == "vlm", F.col("vlm_survived")).otherwise(F.col("ocr_survived"))
    v = F.col("verdict")
    signals = [
        ("verdict", F.when(v == "consistent", 0.35).when(v == "partial", 0.1).when(v.isNotNull(), -0.25)),
        ("support", F.when(F.col("has_reference") & support.isNotNull(), F.bround(0.25 * support - 0.1, 3))),
        ("place", F.when(F.col("place") == "same place", 0.15).when(F.col("place") == "different pages", -0.1)),
        ("closer look", F.when(closer.isNotNull(), F.when(closer == F.col("recommended"), 0.15).otherwise(-0.25))),
        ("ablation", F.when(survived.isNotNull(), F.when(~survived, 0.1).otherwise(-0.05)))]
    total = reduce(lambda x, s: x + F.coalesce(s[1], F.lit(0.0)), signals, F.lit(0.35))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)
    out = out.withColumn("trust", F.when(F.col("recommended").isNotNull(), score))
    reasons = F.array_compact(F.array(*[F.when(d.isNotNull(), F.concat(F.when(d >= 0, "+").otherwise("-"), F.lit(name))) for name, d in signals]))
    t = F.col("trust")
    level = F.when(t.isNull(), "unknown").when(t >= 0.75, "high").when(t >= 0.5, "medium").otherwise("low")
    return out.withColumn("trust_level", level).withColumn("reasons", F.when(t.isNotNull(), reasons).otherwise(F.array(F.lit("unsettled"))))


def not_rated(vlm: Column, ocr: Column) -> Column:
    """Neither answer is short: long answers are not tied to one place and get no trust score."""
    return ~(T.is_short(vlm) | T.is_short(ocr))
