"""Joins of a large table with one that is small as a rule."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

FEW = 500_000  # rows that may be sent to every executor
SALTS = 32


def join_few(big: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salt: list[str] | None = None, most: int = FEW) -> DataFrame:
    """``big`` joined (inner, left, left_semi, left_anti) with ``few``, which is counted first. Up to ``most`` rows are broadcast, so
    ``big`` stays where it is, whatever its keys. More are joined by a shuffle in which every key of ``big`` is dealt over ``SALTS``
    tasks by its ``salt`` columns and ``few`` is repeated for each, so a hot key of ``big`` stays spread out."""
    few = staged(few, "few")
    if few.count() <= most:
        return big.join(F.broadcast(few), on, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*(salt or big.columns)), F.lit(SALTS)).cast("int"))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, [*on, "_salt"], how).drop("_salt")
