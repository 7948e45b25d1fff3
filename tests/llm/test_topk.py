import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import topk


def brute(rows, k):
    """Every row by itself, whatever its id."""
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(ints):
        if q % 20 == 0:
            found = sorted((-max(-1 << 63, min((1 << 63) - 1, sum(a * b for a, b in zip(own, w)))), i) for other, (i, w) in enumerate(ints) if other != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k=20):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cb string, score int")
    out = topk.search(vectors, F.col("vec_id") % 20 == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("blocks", [None, (50, 7, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        for name, size in zip(("CANDIDATES", "QUERIES", "MERGE"), blocks):
            monkeypatch.setattr(topk, name, size)
    rng = random.Random(4)
    half = lambda: [rng.randrange(-3, 4) / 64 for _ in range(6)]  # noqa: E731  small integers: many ties, many zeros
    rows = [(i, half()) for i in range(400)] + [(20, half()), (20, half()), (40, None), (60, [0.1, None]), (80, [0.1, math.inf]), (100, [math.nan]), (None, half()), (401, []), (420, [0.5] * 9)]
    assert run(spark, rows) == brute(rows, 20)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, -0.26]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, [(3, None)]) == []


def test_large_numbers(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e9, -1.0]), (2, [3e38, 3e38]), (20, [-3e38, 1.0]), (3, [1e6, 7.5])]
    assert run(spark, rows) == brute(rows, 20)
