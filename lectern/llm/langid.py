"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, everything but letters becomes a blank, and n-grams of the given orders (blanks alone excepted)
are hashed into a fixed number of bins. Training counts come from a bounded sample of labelled rows (``per_language``
documents of each language in expectation, drawn by a hash of the row); the log-probability matrix, languages x bins
float32, is broadcast and texts are scored in numpy a few hundred thousand characters at a time.

``und`` with score 0 is given for null texts, texts without a letter, and where nothing could be learned. Ties go to the
language first in order. Repeated rows are each predicted; the order of rows does not matter.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import in_batches

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BINS = 1 << 15
PER_LANGUAGE = 20_000
CHARS_AT_ONCE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed(text: str, seen: int = 0) -> np.ndarray:
    """Bins of all n-grams of one piece of lower-cased text that do not lie within its first ``seen`` characters; empty if it holds
    no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h, any_letter = np.full(size, n, np.uint64), np.zeros(size, bool)
        for i in range(n):
            h = (h ^ codes[i:i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            any_letter |= letter[i:i + size]
        new = max(0, seen + 1 - n)
        out.append((h & np.uint64(BINS - 1)).astype(np.int64)[new:][any_letter[new:]])
    return np.concatenate(out)


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """Parts of a lower-cased text, so that memory stays bounded, and how many characters of each the part before had too: enough for
    the n-grams over the cut, so all n-grams of the text are in exactly one part."""
    text, overlap = text.lower(), max(ORDERS) - 1
    for start in range(0, len(text), CHARS_AT_ONCE):
        before = min(start, overlap)
        yield text[start - before:start + CHARS_AT_ONCE], before


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages, float32: log P(bin | language)
    prior: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        total, seen = np.zeros(len(self.languages)), False
        for piece, before in pieces(text or ""):
            bins = hashed(piece, before)
            if len(bins) and self.languages:
                seen = True
                total += self.weights.take(bins, axis=0).sum(axis=0, dtype=np.float64)
        if not seen:
            return UNKNOWN, 0.0
        total += self.prior
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bin counts per language of this task's rows: at most languages x bins of them leave it."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BINS, np.int64))
            for piece, before in pieces(text):
                own += np.bincount(hashed(piece, before), minlength=BINS)
    for lang, own in counts.items():
        bins = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(own[bins])],
                                         names=["lang", "bin", "n"])


def fit(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``text`` and ``lang`` of the rows where ``may_learn`` holds and neither is null."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("draw"))
    sizes = dict(rows.groupBy("lang").count().collect())
    languages = sorted(sizes)
    keep = F.lit(False)
    for lang in languages:
        keep = keep | ((F.col("lang") == lang) & (F.col("draw") < int(min(1.0, per_language / sizes[lang]) * (1 << 40))))
    counts = rows.where(keep).select("lang", "text").mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(
        F.sum("n").alias("n")).toPandas()
    table = np.zeros((BINS, len(languages)))
    table[counts["bin"].to_numpy(int), counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = counts["n"]
    smooth = table + 0.5
    weights = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    prior = np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values())))
    return Model(languages, np.ascontiguousarray(weights), prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``lang_score`` (the posterior of the prediction); columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            names=[*keep, "lang_pred", "lang_score"])

    return docs.mapInArrow(in_batches(run), schema)
