"""Operator 11: URL filters by a sort-merge range join of canonical keys.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Its canonical key is the host
with its labels in reverse order, ``#``, and the path, so the keys a rule fits are exactly those that start with its own: an
interval that opens at the key and closes at the key followed by byte FF, which UTF-8 never holds. Intervals of two rules nest
or lie apart. A url has one key for each number of labels that rules have (its own last labels); a ``#`` cannot stand in
a url's host or path.

All events (openings, closings, urls' keys) are sorted once, in sampled ranges. A sweep over a range keeps the stack of open
rules as columns: the running sum of openings and closings is the stack's height, and the rule on top is the last one opened at
that height. Rules that are open where a range begins are opened there again. No range is larger than another for a
frequent host, and nothing is broadcast. Built-in functions only.

Of the rules that fit a url the longest wins: most code points of host and path together, of these the longest host. Of equal
rules, block goes before allow. Where none fits, ``rule`` is null and the verdict is ``default``. Null urls and urls without
``://`` have an empty host and path, which only a rule with an empty host and path fits; rules with a null host, path or verdict
are left out. Repeated rows are each judged. Empty tables of urls or rules are fine. Other columns stay as they are; columns of
the names ``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, written

ALLOW, BLOCK = "allow", "block"
BOUND = "#"
OPENS, ASKS, CLOSES = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def key(own: Column, path: Column) -> Column:
    """Canonical key of host labels and a path. Binary: compared byte by byte."""
    return F.concat(F.array_join(F.reverse(own), "."), F.lit(BOUND), path).cast("binary")


def _events(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(at, kind, rid, key, rule): openings and closings of every rule; a key of every url for each number of labels of a rule."""
    depths = sorted(rules.agg(F.collect_set(F.size(labels(F.col("host"))))).first()[0])  # as many as a host has labels, at most
    mine = key(labels(F.col("host")), F.col("path"))
    said = F.struct(F.char_length(F.concat("host", "path")).alias("length"), F.char_length("host").alias("host_length"),
                    F.concat("host", "path").alias("rule"), "verdict")
    none = F.lit(None).cast(rules.select(said.alias("x")).schema["x"].dataType)
    opened = rules.select(mine.alias("at"), F.lit(OPENS).alias("kind"), F.lit(None).cast("long").alias("rid"), mine.alias("key"), said.alias("said"))
    closed = rules.select(F.concat(mine, F.unhex(F.lit("FF"))).alias("at"), F.lit(CLOSES).alias("kind"), F.lit(None).cast("long").alias("rid"),
                          mine.alias("key"), none.alias("said"))
    own = labels(F.col("host"))
    tails = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size(own))
    asked = urls.select("rid", F.explode(F.transform(tails, lambda d: key(F.slice(own, -d, d), F.col("path")))).alias("at"))
    return opened.unionByName(closed).unionByName(asked.select("at", F.lit(ASKS).alias("kind"), "rid", F.lit(None).cast("binary").alias("key"), none.alias("said")))


def _swept(events: DataFrame) -> DataFrame:
    """(rid, said): for every url's key inside an interval, the rule on top of the stack."""
    cut, _ = written(events.repartitionByRange("at", "kind", "rid").withColumn("range", F.spark_partition_id()), "events")
    opens, closes = (cut.where(F.col("kind") == k) for k in (OPENS, CLOSES))
    ends = closes.select(F.col("key").alias("k"), F.col("range").alias("last"))
    still = opens.join(ends, F.col("key") == F.col("k")).where("last > range")
    again = still.select("at", "kind", "rid", "key", "said", F.explode(F.sequence(F.col("range") + 1, "last")).alias("range"))
    inside = Window.partitionBy("range").orderBy("at", "kind", "rid")
    change = F.when(F.col("kind") == OPENS, 1).when(F.col("kind") == CLOSES, -1).otherwise(0)
    rows = cut.unionByName(again).withColumn("height", F.sum(change).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("range", "height").orderBy("at", "kind", "rid").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last("said", ignorenulls=True).over(level)
    left = rows.where((F.col("kind") == OPENS) | ((F.col("kind") == ASKS) & (F.col("height") > 0)))
    return left.withColumn("top", top).where(F.col("kind") == ASKS).select("rid", F.col("top").alias("said"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``urls`` plus ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null) and ``verdict``. ``rules`` has
    the columns host, path and verdict; a rule's host is lower-cased like a url's."""
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows, _ = written(urls.select(F.monotonically_increasing_id().alias("rid"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                                  F.struct(*keep).alias("row")), "urls")
    given = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    given, _ = written(given.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    found = _swept(_events(rows.select("rid", "host", "path"), given))
    best = found.groupBy(F.col("rid").alias("r")).agg(F.max("said").alias("said"))
    out = rows.join(best, F.col("rid") == F.col("r"), "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "host", "path", F.col("said.rule").alias("rule"),
                      F.coalesce("said.verdict", F.lit(default)).alias("verdict"))
