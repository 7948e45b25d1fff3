"""What the operators of this subpackage share: reading tables, shared folders, batches of Arrow rows, linked components."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share; only a local session without one (tests) chooses and sets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows, written once to the shared folder and read back, and where they are: lineage ends there, so a lost
    executor costs a re-read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def in_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch], max_bytes: int = 8 << 20):
    """For mapInArrow: ``fn`` sees pieces of at most ``max_bytes`` (one row at least), so memory does not follow the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = batch.nbytes
            rows = max(1, n * max_bytes // max(sizes, 1))
            for start in range(0, n, rows):
                yield fn(batch.slice(start, rows))
    return run


def same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    """Null-safe equality of the named columns of two tables."""
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in names.items()])


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b: long); root is the smallest node reachable.

    Alternates large-star and small-star steps: each replaces a node's links by links to its smallest neighbour. The minimum
    is an aggregate combined before the shuffle and joined back, so a hub of any degree stays spread out; every round is
    written to the shared folder and only a count and a checksum reach the driver. Empty edges give an empty table.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, old = mark(now), path
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, p1 = written(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        moved = large.join(low, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now, path = written(small, name)
        after = mark(now)
        remove(spark, p1)
        remove(spark, old)
        old = path
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
