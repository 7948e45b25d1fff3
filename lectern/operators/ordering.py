"""Row positions and running totals that do not put a whole group into one task.

A plain ``row_number() over (partition by key order by x)`` sends every row of a key to one task; one document, run or
source can hold a third of the data. Here a group is cut into slices along its order: the window runs inside a slice,
and the totals of earlier slices (one row per slice) are added by a join on the same keys, so the sorted side is not
shuffled again. Where slices of equal width would hold very unequal numbers of rows (scores, times, any real value), the
cut is sampled from the rows (``ranges``).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

ROWS_PER_SLICE = 1 << 16


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` plus ``_slice``: ranges of (keys, order) that hold about as many rows each, whatever the values are like. Their ends
    are sampled from the rows by the range partitioner; there are as many as shuffle partitions. The cut is written once, since
    rows and totals must see the same one. Only rows that are equal in keys and order can crowd a range."""
    return staged(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], slice_by: Column | None = None) -> DataFrame:
    """Adds inclusive running sums. Slices are sampled ranges, or given by ``slice_by``, which must grow with ``order`` (rows of an
    earlier slice all come first) and hold few enough rows each. With no keys, the totals are one row per slice in one task."""
    cut = df.select(*df.columns, *[value.alias(f"_v_{name}") for name, value in sums.items()])
    cut = ranges(cut, keys, order) if slice_by is None else cut.withColumn("_slice", slice_by)
    part = [*keys, "_slice"]
    totals = cut.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(p).alias(f"_k_{p}") for p in part],
                            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        cut = cut.withColumn(f"_v_{n}", F.sum(f"_v_{n}").over(inside))
    on = reduce(lambda x, y: x & y, [cut[p].eqNullSafe(offsets[f"_k_{p}"]) for p in part])
    out = cut.join(offsets, on, "inner")
    return out.select(*df.columns, *[(F.col(f"_v_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, keys: list[str], order: str, name: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """0-based position of every row in its group along an integer column that is unique in the group."""
    sliced = F.floor(F.col(order) / rows_per_slice)
    out = running(df, keys, [F.col(order)], {name: F.lit(1).cast("long")}, sliced)
    return out.withColumn(name, F.col(name) - 1)


def neighbour(df: DataFrame, keys: list[str], order: str, value: Column, name: str, forward: bool = True, strict: bool = False,
              rows_per_slice: int | None = ROWS_PER_SLICE) -> DataFrame:
    """Adds the nearest non-NULL ``value`` along ``order`` (an as-of join of a table with itself): at or after each row, at
    or before it with ``forward=False``, leaving out the row itself with ``strict``. Slices are stretches of ``rows_per_slice``
    of an integer that has few gaps, or sampled ranges (None)."""
    cut = df.withColumn("_v", value)
    cut = ranges(cut, keys, [F.col(order)]) if rows_per_slice is None else cut.withColumn("_slice", F.floor(F.col(order) / rows_per_slice))
    part = [*keys, "_slice"]
    here = F.when(F.col("_v").isNotNull(), F.col(order))
    ends = cut.groupBy(*part).agg((F.min_by("_v", here) if forward else F.max_by("_v", here)).alias("_f"))
    pick = F.first if forward else F.last
    beyond = Window.partitionBy(*keys).orderBy("_slice")
    beyond = beyond.rowsBetween(1, Window.unboundedFollowing) if forward else beyond.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(p).alias(f"_k_{p}") for p in part], pick("_f", ignorenulls=True).over(beyond).alias("_c"))
    inside = Window.partitionBy(*part).orderBy(order)
    edge = 1 if strict else 0
    inside = inside.rowsBetween(edge, Window.unboundedFollowing) if forward else inside.rowsBetween(Window.unboundedPreceding, -edge)
    cut = cut.withColumn("_in", pick("_v", ignorenulls=True).over(inside))
    on = reduce(lambda x, y: x & y, [cut[p].eqNullSafe(carry[f"_k_{p}"]) for p in part])
    return cut.join(carry, on, "inner").select(*df.columns, F.coalesce("_in", "_c").alias(name))


def smallest(df: DataFrame, keys: list[str], order: Column, n: int, salt: str, salts: int = 256) -> DataFrame:
    """The n smallest ``order`` values per group as a sorted array ``_best``: first within salted parts of the group, then
    over their at most salts * n survivors, so a group of any size stays spread out. ``salt`` names a column of ``df``."""
    part = df.select(*keys, order.alias("_o"), F.pmod(F.xxhash64(salt), F.lit(salts)).alias("_salt"))
    w = Window.partitionBy(*keys, "_salt").orderBy("_o")
    kept = part.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return kept.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("_o")), 1, n).alias("_best"))
