"""Operator 7: exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (dimension, weight). Queries and candidates are dealt into blocks of bounded expected size
by a hash of their number; each pair of a query block and a candidate block is one group of rows. In a group, the candidates'
postings are built per dimension, every query's weights scatter weighted postings into dense score arrays, and the best k of
each query are selected by partition; the lists of all candidate blocks are then merged: per query within salted parts first,
so that no group holds more than ``MERGE`` lists. Every query meets every candidate once and nothing is broadcast.

Vectors that are null or hold null or non-finite components, and rows without id, take no part. Rows that share an id are rows of
their own: each is a query if its id is one, and a candidate of all others, those with its id included. Missing dimensions count as 0. Sums outside 64 bits are cut to its range. Empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

CANDIDATES = 1 << 14
QUERIES = 1 << 11
AT_ONCE = 64  # queries whose dense scores are held at a time
MERGE = 256
LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(row, vec_id, v): a number of its own for every row, and floor(scale * x) of every component, as double. Written once, so that
    a row keeps its number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))
    return written(rows, "vectors")[0]


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """The rows one below the other, missing dimensions 0."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """Score arrays (queries x candidates), ``AT_ONCE`` queries at a time."""
    dims = min(queries.shape[1], candidates.shape[1])
    bound = dims * np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0)
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
    whole = (lambda m: m.astype(kind)) if kind is not object else (lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object))
    q, c = whole(queries), whole(candidates)
    postings = []
    for d in range(dims):
        at = np.flatnonzero(c[:, d])
        postings.append((at, c[at, d], len(at) == len(c)))
    for start in range(0, len(q), AT_ONCE):
        part = q[start:start + AT_ONCE]
        scores = np.zeros((len(part), len(c)), kind)
        for i, row in enumerate(part):
            own = scores[i]
            for d in np.flatnonzero(row[:dims]):
                at, weight, all_of_them = postings[d]
                if all_of_them:
                    own += row[d] * weight
                else:
                    own[at] += row[d] * weight
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id: partition selection, then a sort of what is left."""
    if len(scores) > k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= low)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row where ``is_query`` (of vec_id) holds, its k best other rows."""
    rows = quantised(vectors, vec_id, embedding, scale)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    c_blocks, q_blocks = max(1, -(-n["n"] // CANDIDATES)), max(1, -(-n["q"] // QUERIES))
    queries = rows.where(is_query).select(
        "row", "vec_id", "v", F.lit(True).alias("query"), F.pmod(F.xxhash64("row"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"))
    candidates = rows.select(
        "row", "vec_id", "v", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
        F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("cb"))

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks, others = rows[rows["query"]], rows[~rows["query"]]
        q_ids, ids = asks["vec_id"].to_numpy(np.int64), others["vec_id"].to_numpy(np.int64)
        q_rows, own_rows = asks["row"].to_numpy(np.int64), others["row"].to_numpy(np.int64)
        out, at = [], 0
        for scores in accumulate(matrix(list(asks["v"])), matrix(list(others["v"]))):
            for own in scores:
                top = best(own, ids, k + 1)  # its own row may be among them
                top = top[own_rows[top] != q_rows[at]][:k]
                values = [max(-LIMIT - 1, min(LIMIT, int(x))) for x in own[top]]
                out.append(pd.DataFrame({"query": q_rows[at], "query_id": q_ids[at], "vec_id": ids[top], "score": np.array(values, np.int64), "cb": key[1]}))
                at += 1
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": [], "cb": []}).astype(np.int64)

    found = queries.union(candidates).groupBy("qb", "cb").applyInPandas(group, "query long, query_id long, vec_id long, score long, cb long")
    order = [F.desc("score"), "vec_id"]
    while c_blocks > MERGE:
        c_blocks = -(-c_blocks // MERGE)
        found = found.withColumn("cb", F.pmod("cb", F.lit(c_blocks)))
        own = Window.partitionBy("query", "cb").orderBy(*order)
        found = found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r")
    own = Window.partitionBy("query").orderBy(*order)
    return found.select("query_id", F.row_number().over(own).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
