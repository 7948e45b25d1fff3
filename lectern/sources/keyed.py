"""Tables stored by key, in buckets, so that an upsert rewrites only the buckets in which something changes."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import staged

BUCKET = "bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Parquet below ``path``, one row per ``keys``, in ``buckets`` folders by a hash of the keys; ``version`` orders the rows of a key.

    The number of buckets is fixed for a table and bounds what the driver learns of a batch. A bucket is written as ``files`` files.
    Buckets are swapped one by one when all are written: a run that fails between two swaps leaves some buckets of the batch in and
    some out, and running the batch again brings in the rest. Rows whose key is null are kept like any other."""

    path: str
    keys: tuple[str, ...]
    version: str
    buckets: int = 64
    files: int = 1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _renamed(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *more)

    def _same_key(self) -> Column:
        return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)])

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets, with their bucket; None where nothing was ever written."""
        try:
            df = spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return df if only is None else df.where(F.col(BUCKET).isin(only))

    def rows(self, spark: SparkSession) -> DataFrame | None:
        df = self.read(spark)
        return None if df is None else df.drop(BUCKET)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets that rows of ``batch`` belong to."""
        return sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, batch: DataFrame) -> list[int]:
        """Inserts new keys and replaces rows of a lower version; of rows of one version the stored one stays, so a batch that is run
        again changes nothing. Returns the buckets written: of all others not a file is touched."""
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in self.keys]
        new = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col(self.version)).alias("r")).select(*self.keys, "r.*")
        new = staged(new.withColumn(BUCKET, self._bucket()), "upsert")
        old = self.read(spark, [r[0] for r in new.select(BUCKET).distinct().collect()])
        if old is not None:
            stored = self._renamed(old, F.col(self.version).alias("_version"))
            new = staged(new.join(stored, self._same_key(), "left").where(F.col("_version").isNull() | (F.col(self.version) > F.col("_version"))).select(*new.columns), "upsert")
        changed = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if not changed:
            return []
        if old is not None:
            kept = self.read(spark, changed).join(self._renamed(new), self._same_key(), "left_anti")
            new = new.unionByName(kept, allowMissingColumns=True)
        spread = new.repartition(F.col(BUCKET), F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.files)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return changed
