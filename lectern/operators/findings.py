"""The facts behind a written explanation: rows and labels, no sentences."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .causes import WRONG


def recognition_sets(asks: DataFrame, keys: list[str]) -> DataFrame:
    """Words the vision answer has and the full OCR text lacks (and the reference prints), words the text model repaired,
    and words it invented."""
    def said(a: Column) -> Column:
        return F.when(a.isNotNull() & ~T.is_not_found(a), T.content_tokens(a)).otherwise(F.array().cast("array<string>"))

    d = asks.select(*keys, said(F.col("vlm_answer")).alias("v"), said(F.col("ocr_answer")).alias("o"), T.vocab(F.col("ocr_text")).alias("ocr"),
                    F.when(F.coalesce("reference", F.lit("")) != "", T.vocab(F.col("reference"))).alias("ref"))
    unread = lambda c: F.filter(c, lambda t: ~F.array_contains("ocr", F.ltrim(t, F.lit("$"))))
    d = d.select(*keys, unread("v").alias("v"), unread("o").alias("o"), "ref")
    printed = lambda c: F.filter(c, lambda t: F.array_contains("ref", F.ltrim(t, F.lit("$"))))
    none = F.array().cast("array<string>")
    judged = F.col("ref").isNotNull()
    return d.select(*keys, F.when(judged, printed("v")).otherwise(F.col("v")).alias("vision_saw"), F.when(judged, printed("o")).otherwise(none).alias("repaired"),
                    F.when(judged, F.filter("o", lambda t: ~F.array_contains("ref", F.ltrim(t, F.lit("$"))))).otherwise(none).alias("invented"))


def read_grade(similarity: Column) -> Column:
    return F.when(similarity >= 0.98, "excellent").when(similarity >= 0.9, "good").when(similarity >= 0.75, "fair").when(similarity.isNotNull(), "poor")


def speed_finding(asks: DataFrame, keys: list[str]) -> DataFrame:
    """Faster side and difference ("same" below 300 ms or 15 %), whether OCR was reused, whether OCR ranked the pages.
    Needs vlm_ms, ocr_total_ms, ocr_ms, ocr_wall_ms, retrieval_ms, corpus."""
    v, o = F.col("vlm_ms"), F.col("ocr_total_ms")
    diff = F.abs(v - o)
    clear = diff >= F.greatest(F.lit(300.0), 0.15 * F.greatest(v, o))
    reused = (F.col("ocr_ms") > 0) & (F.col("ocr_wall_ms") < 0.5 * F.col("ocr_ms"))
    ranked = (F.col("corpus") == "ocr") & (F.coalesce("retrieval_ms", F.lit(0.0)) >= 0.5 * F.coalesce("ocr_ms", F.lit(0.0)))
    known = asks.where((v > 0) & (o > 0))
    return known.select(*keys, F.when(~clear, "same").when(v < o, "vlm").otherwise("ocr").alias("faster"), diff.alias("difference_ms"),
                        F.coalesce(reused, F.lit(False)).alias("reused"), F.coalesce(reused & ranked, F.lit(False)).alias("ranked_by_ocr"))


def page_coverage(asks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages each side saw of all, in how many parts, who combined. Needs n_pages, vlm_pages, ocr_pages, vlm_parts, ocr_parts,
    vlm_combined, ocr_combined."""
    several = asks.where("n_pages > 1")
    part = lambda s: (F.col(f"{s}_parts") > 1)
    return several.select(
        *keys, "n_pages", "vlm_pages", "ocr_pages", (F.col("vlm_pages") < F.col("n_pages")).alias("vision_saw_part"),
        F.concat_ws("+", F.when(part("vlm"), "vlm"), F.when(part("ocr"), "ocr")).alias("in_parts"),
        F.concat_ws("+", F.when(F.col("vlm_combined"), "vlm"), F.when(F.col("ocr_combined"), "ocr")).alias("combined"))


def verdict_class(card: DataFrame) -> DataFrame:
    """Adds ``situation``: which of the ten verdict situations a scorecard is in. Needs winner, verdict, vlm_support,
    ocr_support, *_answered, *_failed, n_only_vlm, n_only_ocr."""
    w, v = F.col("winner"), F.col("verdict")
    sv, so = F.col("vlm_support"), F.col("ocr_support")
    tie = w == "tie"
    uneven = ((F.col("n_only_vlm") > 0) | (F.col("n_only_ocr") > 0))
    s = (F.when(w.isin("vlm", "ocr"), F.concat(w, F.lit(" better supported")))
         .when(tie & sv.isNull() & so.isNull() & ~F.col("vlm_answered") & ~F.col("ocr_answered") & ~F.col("vlm_failed") & ~F.col("ocr_failed"), "both not found")
         .when(tie & sv.isNull() & so.isNull(), "neither checkable").when(tie & (sv.isNull() | so.isNull()), "one answered, barely supported")
         .when(tie & uneven, F.when(F.col("n_only_ocr") > 0, "ocr more complete").otherwise("vlm more complete"))
         .when(tie & (sv == 1.0) & (so == 1.0) & (v == "consistent"), "both agree and backed").when(tie, "neither clearly better")
         .when((w == "unknown") & (v == "consistent"), "agree, not checkable").when(w == "unknown", "disagree, not checkable")
         .otherwise("only one ran"))
    return card.withColumn("situation", s)


def run_findings(outcomes: DataFrame, lost: DataFrame, groups: DataFrame, causes: DataFrame, keys: list[str], min_n: int = 5) -> DataFrame:
    """(keys, kind, name, value): head to head, the top reasons, the largest gaps per question type, repairs and reads
    beyond OCR."""
    count = lambda b: F.coalesce(F.max(F.when(F.col("better") == b, F.col("n"))), F.lit(0)).cast("double")
    h = outcomes.groupBy(*keys).agg(*[count(b).alias(b) for b in ("both", "vlm", "ocr", "neither")])
    head = F.array(*[F.struct(F.lit(b).alias("name"), F.col(b).alias("value")) for b in ("both", "vlm", "ocr", "neither")])
    h1 = h.select(*keys, F.lit("head_to_head").alias("kind"), F.explode(head).alias("x")).select(*keys, "kind", "x.name", "x.value")
    h2 = h.select(*keys, F.lit("ahead").alias("kind"), F.when(F.col("vlm") > F.col("ocr"), "vlm").when(F.col("ocr") > F.col("vlm"), "ocr").otherwise("none").alias("name"),
                  F.abs(F.col("vlm") - F.col("ocr")).alias("value"))
    l = lost.select(*keys, F.lit("reason").alias("kind"), F.concat_ws(": ", "winner", "cause").alias("name"), F.col("share").alias("value"))
    gap = F.col("vlm_right") - F.col("ocr_right")
    g = groups.where((F.col("kind") == "type") & (F.col("n") >= min_n) & (F.abs(gap) >= 0.05)).select(
        *keys, F.lit("type_gap").alias("kind"), F.col("grp").alias("name"), gap.alias("value"))
    c = causes.where(((F.col("side") == "ocr") & (F.col("cause") == "repaired")) | ((F.col("side") == "vlm") & (F.col("cause") == "beyond_ocr"))).select(
        *keys, F.lit("beyond_text").alias("kind"), F.col("cause").alias("name"), F.col("n").cast("double").alias("value"))
    f = causes.where(F.col("cause").isin(*WRONG)).groupBy(*keys, "side").agg(F.sum("n").alias("n")).select(
        *keys, F.lit("wrong_answers").alias("kind"), F.col("side").alias("name"), F.col("n").cast("double").alias("value"))
    return h1.unionByName(h2).unionByName(l).unionByName(g).unionByName(c).unionByName(f)
