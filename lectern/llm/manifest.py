"""Operator 13: a Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and the value. The leaves of a
group, in order, are the lowest level of a tree: every ``ARITY`` consecutive digests (the last run: fewer, even one) become the
digest of their concatenation, until one remains, the group's subroot. Subroots in order of their groups form a tree likewise,
whose top is the root.

A group of any size is cut into aligned blocks of ``ARITY ** LEVELS`` digests. A block keeps a level as one string of fixed-width
hex digests: parents are hashes of its substrings, and a node's siblings are the substrings left and right of it in its run. The
roots of the blocks are the digests of the next round, so rounds grow with the logarithm of the largest group. On the way back each
block learns its path from there up, so that a leaf's path is its own segments and its block's. Positions come from running totals
over sampled ranges; no task sees more than a block, and texts are never shuffled.

Rows of a group are ordered by the order column (nulls first), ties by leaf, so repeated rows stand side by side; the null group
comes first, the others in the order of their UTF-8 bytes. Empty texts have a count of 0, unlike null ones. An empty table gives no
rows. Other columns, whatever their names, are carried in ``row``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import same, written
from lectern.operators.ordering import running

ARITY = 3
LEVELS = 5  # of a block: 243 digests, 15.6 kB a level
HEX = 64
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of a row's fields."""
    def part(x: Column) -> Column:
        value = x.cast("string")
        return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return digest(F.concat(*map(part, fields)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``: at each level its run's digests, the own one in the middle."""
    return F.aggregate(path, leaf, lambda own, x: digest(F.concat(x["left"], own, x["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _parents(level: Column) -> Column:
    """The next level of a level string."""
    runs = F.ceil(F.char_length(level) / (ARITY * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(F.substring(level, i * (ARITY * HEX) + 1, F.lit(ARITY * HEX)))), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, pos, members, levels, root) of each block of (tree, size, at, digest, row): its nodes in order, its level strings from
    the lowest up, and the digest above them. A tree of one block ends where one digest remains, so it may have no level."""
    block = F.floor(F.col("at") / ARITY ** LEVELS)
    g = nodes.groupBy("tree", block.alias("pos")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "digest", "row"))).alias("members"))
    heights = reduce(lambda x, n: x + F.when(F.col("size") > n, 1).otherwise(0), [ARITY ** i for i in range(LEVELS)], F.lit(0))
    lowest = F.array_join(F.transform("members", lambda m: m["digest"]), "")
    rising = F.aggregate(F.sequence(F.lit(0), F.col("height")), F.array(F.col("lowest")).cast("array<string>"),
                         lambda acc, i: F.when(i == 0, acc).otherwise(F.concat(acc, F.array(_parents(F.element_at(acc, -1))))))
    g = g.select("tree", "pos", "size", "members", heights.alias("height"), lowest.alias("lowest")).withColumn("rising", rising)
    return g.select("tree", "pos", "size", "members", F.slice("rising", F.lit(1), F.col("height")).alias("levels"), F.element_at("rising", -1).alias("root"))


def _own_path(levels: Column, index: Column) -> Column:
    """The flanks of node ``index`` of a block, level by level."""
    def flanks(level: Column, i: Column) -> Column:
        at = F.floor(index / F.pow(F.lit(ARITY), i)).cast("int")
        first = at - at % ARITY
        return F.struct(F.substring(level, first * HEX + 1, (at - first) * HEX).alias("left"),
                        F.substring(level, (at + 1) * HEX + 1, (first + ARITY - 1 - at) * HEX).alias("right"))
    return F.transform(levels, flanks)


def _climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Blocks of every round, the lowest first; the last round has one block per tree. ``nodes``: tree, size, at, digest, row."""
    rounds = []
    while True:
        blocks, _ = written(_blocks(nodes), "blocks")
        rounds.append(blocks)
        if largest <= ARITY ** LEVELS:
            return rounds
        largest = -(-largest // ARITY ** LEVELS)
        above = F.ceil(F.col("size") / ARITY ** LEVELS).cast("long")
        nodes = blocks.select("tree", above.alias("size"), F.col("pos").alias("at"), F.col("root").alias("digest"), F.struct("pos").alias("row"))


def _descend(rounds: list[DataFrame], top: DataFrame | None) -> DataFrame:
    """(tree, row, digest, path, subroot, more): every node of the lowest round with its path to the top of its tree and on. ``top``
    has for each tree (k) its path from there (``on``) and whatever goes with it (``more``)."""
    known = rounds[-1].select(F.col("tree").alias("k"), F.col("pos").alias("p"), F.col("root").alias("subroot"), F.array().cast(PATH).alias("up"))
    if top is not None:
        t = top.withColumnRenamed("k", "t")
        known = known.join(t, same(known, t, {"k": "t"})).select("k", "p", "subroot", F.col("on").alias("up"), "more")
    else:
        known = known.withColumn("more", F.lit(None).cast("string"))
    for blocks in reversed(rounds):
        met = blocks.join(known, same(blocks, known, {"tree": "k", "pos": "p"}))
        each = F.transform("members", lambda m, i: F.struct(m["row"].alias("row"), m["digest"].alias("digest"),
                                                            F.concat(_own_path(F.col("levels"), i), F.col("up")).alias("path")))
        out = met.select("tree", "subroot", "more", F.explode(each).alias("x")).select("tree", "x.row", "x.digest", "x.path", "subroot", "more")
        known = out if blocks is rounds[0] else out.select(F.col("tree").alias("k"), F.col("row.pos").alias("p"), "subroot", F.col("path").alias("up"), "more")
    return known


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column) -> DataFrame:
    """(row, leaf, path, subroot, root) of every row: ``row`` holds all its columns; ``path`` the digests left and right of its own,
    level by level, by which ``folded`` leads from the leaf over the subroot to the root."""
    given = rows.select(group.cast("string").alias("tree"), order.alias("order"), leaf.alias("digest"), F.monotonically_increasing_id().alias("tie"),
                        F.struct(*rows.columns).alias("row"))
    placed, _ = written(running(given, ["tree"], [F.col("order"), F.col("digest"), F.col("tie")], {"n": F.lit(1).cast("long")}), "leaves")
    sizes, _ = written(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "sizes")
    largest, trees = sizes.agg(F.coalesce(F.max("size"), F.lit(0)), F.count(F.lit(1))).first()
    own = sizes.withColumnRenamed("tree", "k")
    # A group holds any share of the rows: the few sizes go to where the rows are if there are few groups, else rows meet them.
    nodes = placed.join(F.broadcast(own) if trees <= 100_000 else own, same(placed, own, {"tree": "k"})).select(
        "tree", "size", (F.col("n") - 1).alias("at"), "digest", "row")
    lower = _climb(nodes, largest)
    subroots = lower[-1].select(F.lit(0).alias("all"), "tree", "root")
    ranked = running(subroots, [], [F.col("tree")], {"n": F.lit(1).cast("long")})
    upper = _climb(ranked.select(F.col("all").alias("tree"), F.lit(trees).cast("long").alias("size"), (F.col("n") - 1).alias("at"),
                                 F.col("root").alias("digest"), F.struct(F.col("tree").alias("tree")).alias("row")), trees)
    top = _descend(upper, None).select(F.col("row.tree").alias("k"), F.col("path").alias("on"), F.col("subroot").alias("more"))
    return _descend(lower, top).select("row", F.col("digest").alias("leaf"), "path", "subroot", F.col("more").alias("root"))
