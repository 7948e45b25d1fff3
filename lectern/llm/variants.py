"""Operator 12: grouping spelling variants with a pair dictionary of trie nodes.

Distinct words are sorted; a trie over them is numbered in one pass over each range of the order (a word's new nodes are those
beyond what it shares with the word before), and so is a trie of the reversed words. Where ranges meet, the nodes that a range's
first word shares with the range before get that one's numbers. A word without its code point at i is the pair of integers (node
before i, node after i); a word split at i is such a pair too. Two words of one length that meet at a pair differ in exactly the
position left out; a word that meets another's split lacks exactly the code point inserted there. A position counts for an insertion
only where a run of equal code points begins, so each pair of near words meets once. The pairs are exact: nothing is verified and
nothing is missed, whatever the length.

At a pair meet at most as many words as the alphabet has letters, and one split. Each of them takes the number of its near words and
the best of them from there as one row; pairs of words are never listed.

Null words and counts are left out, repeated words are added up, words below ``shortest`` or ``least`` are no words. Empty tables give
empty tables. Only the columns named are read, so others may have any name.
"""
from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

SHORTEST, LEAST, FACTOR = 7, 2, 10
RANGE_BITS = 40  # numbers of one range; ranges take the bits above
BATCH = 4096
SPLIT, LEFT_OUT, LEFT_OUT_FIRST = 0, 1, 2


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, wid, nodes, range, first, last) of a sorted range of words: ``nodes`` numbers the prefixes of one code point and more;
    the first row of a range is marked, and so is the last."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId()
    high, before, nodes, fresh, row = base << RANGE_BITS, "", [], 1, 0
    held: dict[str, list] = {c: [] for c in ("word", "n", "wid", "nodes", "first")}

    def out(last: bool) -> pa.RecordBatch:
        n = len(held["word"])
        made = pa.RecordBatch.from_arrays(
            [pa.array(held["word"], pa.string()), pa.array(held["n"], pa.int64()), pa.array(held["wid"], pa.int64()), pa.array(held["nodes"], pa.list_(pa.int64())), pa.array([base] * n, pa.int32()),
             pa.array(held["first"], pa.bool_()), pa.array([last and i == n - 1 for i in range(n)], pa.bool_())],
            names=["word", "n", "wid", "nodes", "range", "first", "last"])
        for x in held.values():
            x.clear()
        return made

    for batch in batches:
        for word, n, given in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "wid")), strict=True):
            if len(held["word"]) >= BATCH:
                yield out(False)
            kept = len(commonprefix([before, word]))
            nodes = nodes[:kept] + [high + fresh + i for i in range(len(word) - kept)]
            fresh += len(word) - kept
            for name, x in (("word", word), ("n", n), ("wid", high + row if given is None else given), ("nodes", nodes), ("first", row == 0)):
                held[name].append(x)
            before, row = word, row + 1
    if held["word"]:
        yield out(True)


def _trie(words: DataFrame, name: str) -> DataFrame:
    """(word, n, wid, nodes) of (word, n, wid or null): every word's trie nodes, one for each prefix. A null wid becomes the word's place in
    the order. One word of each range goes to the driver, to tell which nodes two ranges share."""
    ranged = words.repartitionByRange("word").sortWithinPartitions("word")
    rows, _ = written(ranged.mapInArrow(_number, "word string, n long, wid long, nodes array<bigint>, range int, first boolean, last boolean"), name)
    ends = sorted(rows.where("first or last").select("range", "first", "last", "word", "nodes").collect())
    shared, before, nodes = [], "", []
    for own in {e["range"]: [x for x in ends if x["range"] == e["range"]] for e in ends}.values():
        first, last = next(e for e in own if e["first"]), next(e for e in own if e["last"])
        same = nodes[:len(commonprefix([before, first["word"]]))]
        shared.append((first["range"], same))
        again = len(commonprefix([first["word"], last["word"], first["word"][:len(same)]]))
        before, nodes = last["word"], same[:again] + last["nodes"][again:]
    of = rows.sparkSession.createDataFrame(shared, "r int, shared array<bigint>")
    both = rows.join(F.broadcast(of), F.col("range") == F.col("r"))  # a row for each range
    low = F.shiftleft(F.col("range").cast("long"), RANGE_BITS)
    # The first word of a range has its numbers 1, 2, ...: those of nodes that were there before are replaced.
    mended = F.transform("nodes", lambda x: F.when(x - low <= F.size("shared"), F.get("shared", (x - low - 1).cast("int"))).otherwise(x))
    return both.select("word", "n", "wid", F.when(F.size("shared") > 0, mended).otherwise(F.col("nodes")).alias("nodes"))


def _pairs(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, word, n) and (before, after, wid, n, kind): every word without each of its code points, and split at each place."""
    words = _trie(counts.select("word", "n", F.lit(None).cast("long").alias("wid")), "trie")
    back = _trie(words.select(F.reverse("word").alias("word"), "n", "wid"), "back").select(F.col("wid").alias("b"), F.col("nodes").alias("back"))
    zero = F.array(F.lit(0).cast("long"))
    each = words.join(back, F.col("wid") == F.col("b")).select("wid", "n", F.split("word", "").alias("letters"), F.concat(zero, "nodes").alias("ahead"),
                                                            F.concat(zero, "back").alias("back"), F.char_length("word").alias("size"))

    def left_out(i):
        run = (i > 0) & (F.get("letters", i) == F.get("letters", i - 1))
        return F.struct(F.get("ahead", i).alias("before"), F.get("back", F.col("size") - 1 - i).alias("after"), F.when(run, LEFT_OUT).otherwise(LEFT_OUT_FIRST).alias("kind"))

    def split(i):
        return F.struct(F.get("ahead", i).alias("before"), F.get("back", F.col("size") - i).alias("after"), F.lit(SPLIT).alias("kind"))

    made = F.concat(F.transform(F.sequence(F.lit(0), F.col("size") - 1), left_out), F.transform(F.sequence(F.lit(0), F.col("size")), split))
    return words.select("wid", "word", "n"), each.select("wid", "n", F.inline(made))


def _met(pairs: DataFrame) -> DataFrame:
    """(wid, near, best): for every word of a pair of nodes where words meet, how many are near it there and the best of them: the
    largest n, then the first in the order of words."""
    at = F.struct("n", (-F.col("wid")).alias("o"), "kind")
    g = pairs.groupBy("before", "after").agg(F.collect_list(at).alias("all")).where(F.size("all") > 1)
    g = g.select(F.array_sort("all").alias("all"))  # the best last

    def near(x, y):
        own = x["o"] == y["o"]
        both = (x["kind"] > SPLIT) & (y["kind"] > SPLIT)
        one = ((x["kind"] == SPLIT) & (y["kind"] == LEFT_OUT_FIRST)) | ((x["kind"] == LEFT_OUT_FIRST) & (y["kind"] == SPLIT))
        return ~own & (both | one)

    def seen(x):
        others = F.filter("all", lambda y: near(x, y))
        last = F.element_at(others, -1)
        return F.struct((-x["o"]).alias("wid"), F.size(others).cast("long").alias("near"), F.when(F.size(others) > 0, F.struct(last["n"].alias("n"), last["o"].alias("o"))).alias("best"))

    return g.select(F.inline(F.transform("all", seen))).where("near > 0")


def variants(counts: DataFrame, word: str = "word", n: str = "n", shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``counts`` with ``shortest`` code points and ``least`` occurrences or more:
    the number of words one inserted, deleted or replaced code point away; of these the one of largest n (ties: first in code-point
    order) if it has ``factor`` times the word's n or more, else null; and where forms lead from word to word."""
    given = counts.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).where(F.col("word").isNotNull() & (F.char_length("word") >= shortest))
    given, _ = written(given.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "counts")
    words, pairs = _pairs(given)
    seen = _met(pairs).groupBy(F.col("wid").alias("s")).agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    held = words.join(seen, F.col("wid") == F.col("s"), "left")
    enough = F.col("best.n") >= factor * F.col("n")
    held, _ = written(held.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(enough, -F.col("best.o")).alias("to"), F.when(enough, F.col("best.n")).alias("form_n")), "seen")
    # Forms grow by the factor at each step, so there are no cycles and few steps; each turn doubles how far a word looks.
    links, _ = written(held.where("to is not null").select("wid", "to"), "forms")
    while True:
        beyond = links.select(F.col("wid").alias("m"), F.col("to").alias("end"))
        links, _ = written(links.join(beyond, F.col("to") == F.col("m"), "left").select("wid", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("went")), "forms")
        if links.where("went").isEmpty():
            break
    forms = words.select(F.col("wid").alias("f"), F.col("word").alias("form"))
    roots = words.select(F.col("wid").alias("r"), F.col("word").alias("root"))
    ends = links.select(F.col("wid").alias("e"), F.col("to").alias("end")).join(roots, F.col("end") == F.col("r")).select("e", "root")
    told = held.where("to is not null").join(forms, F.col("to") == F.col("f")).join(ends, F.col("wid") == F.col("e")).select(F.col("wid").alias("t"), "form", "root")
    out = held.join(told, F.col("wid") == F.col("t"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
