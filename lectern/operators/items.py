"""Projections over two-sided predictions: scores, filters, usable rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

SIDES = ("vlm", "ocr")
FILTERS = ("all", "disagree", "vlm_only", "ocr_only", "ocr_missing")


def score_items(items: DataFrame) -> DataFrame:
    """Adds ``vlm_scores`` and ``ocr_scores``."""
    return items.select("*", *[S.score_item(F.col(f"{s}_pred"), F.col("gold")).alias(f"{s}_scores") for s in SIDES])


def with_coverage(items: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Adds ``answer_in_ocr``: is a gold answer anywhere in the text the second reader had?"""
    return items.withColumn("answer_in_ocr", S.answer_in_text(F.col("gold"), F.col(text)))


def usable_items(scored: DataFrame) -> DataFrame:
    """Items both sides ran on (a side that did not run has no scores, which is not the same as zero scores)."""
    return scored.where(F.col("vlm_scores").isNotNull() & F.col("ocr_scores").isNotNull())


def _modes(scored: DataFrame) -> dict:
    v, o = S.is_right(F.col("vlm_scores")), S.is_right(F.col("ocr_scores"))
    known = set(scored.columns)
    return {"all": F.lit(True), "disagree": ~F.col("agree") if "agree" in known else F.lit(False),
            "vlm_only": v & ~o, "ocr_only": o & ~v,
            "ocr_missing": ~F.col("answer_in_ocr") if "answer_in_ocr" in known else F.lit(False)}


def filter_items(scored: DataFrame, mode: str = "all", cause: str | None = None) -> DataFrame:
    """The analyst's filters; ``cause`` keeps items where either side failed that way (needs vlm_cause, ocr_cause)."""
    out = scored.where(_modes(scored)[mode])
    return out if cause is None else out.where((F.col("vlm_cause") == cause) | (F.col("ocr_cause") == cause))


def filter_memberships(scored: DataFrame) -> DataFrame:
    """Every filter an item passes, one row each, in one pass over the items."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(m)) for m, cond in _modes(scored).items()]))
    return scored.withColumn("mode", F.explode(names))
