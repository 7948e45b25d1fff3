"""Operator 4: benchmark decontamination by word windows.

Item texts are cut into windows of ten consecutive words (a shorter item is one window). Their hashes go into a bitmap of
fixed size that is part of the plan; a document's windows are tested against it inside the row, so only those that may match
leave the row, as text, and are verified against the exact set of windows. That set is broadcast while its checked number
stays below ``BROADCAST_WINDOWS``, joined by a shuffle beyond; more windows than the bitmap suits cost rows, not results.

Null texts have no words. Items without words have no windows; null item_ids are not listed but their windows count.
Repeated rows are each returned. Empty tables give empty or clean results. Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, same

WINDOW = 10
LEAST_BITS, MOST_BITS, BITS_PER_WINDOW = 1 << 18, 1 << 23, 16  # of the bitmap of window hashes
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; null gives none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _with_words(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` and ``w``. Going through a generator keeps the optimizer from cutting the text anew for every window."""
    return df.select(*keep, F.explode(F.array(words(F.col(text)))).alias("w"))


def windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(len, win, items): each distinct window with the ids, as strings, of the items it is in."""
    cut = _with_words(items, text, F.col(item_id).cast("string").alias("item")).where("size(w) > 0")
    cut = cut.withColumn("len", F.least(F.size("w"), F.lit(size)))
    rows = cut.select("item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> array_join(slice(w, i, len), ' '))")).alias("win"))
    return rows.groupBy("len", "win").agg(F.collect_set("item").alias("items"))


def _bit(index: str) -> str:
    return f"shiftleft(1L, cast({index} & 63 as int))"


HASH = "xxhash64(slice(w, {i}, {n}))"


def bitmap_bits(windows: int) -> int:
    """At least sixteen bits for each window, so that few others pass; a power of two between fixed ends."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_WINDOW * windows):
        bits *= 2
    return bits


def _bitmap(wins: DataFrame, size: int) -> Column:
    """Two bits per window; a literal of ``size`` bits."""
    hashed = wins.select(F.explode(F.array(F.struct(F.xxhash64(F.split("win", " ")).alias("h")))).alias("x"))
    first, second = f"(x.h & {size - 1})", f"(shiftrightunsigned(x.h, 32) & {size - 1})"
    bits = hashed.select(F.explode(F.array(F.expr(first), F.expr(second))).alias("b"))
    found = bits.groupBy(F.shiftright("b", 6).alias("slot")).agg(F.bit_or(F.expr(_bit("b"))).alias("v")).collect()
    slots = [0] * (size // 64)
    for r in found:
        slots[r["slot"]] = r["v"]
    return F.split(F.lit(",".join(map(str, slots))), ",").cast("array<bigint>")


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` plus n_words, hit_words (array of word positions from 1 that any occurrence covers) and
    hit_items (array of item ids, sorted as strings). One row per row. Columns of these names are replaced, others may have any."""
    wins = windows(items, size)
    lengths = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = [c for c in docs.columns if c not in (text, "n_words", "hit_words", "hit_items")]
    row = F.struct(F.lit(1).alias("one"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    cut = _with_words(docs, text, F.monotonically_increasing_id().alias("rid"), row)
    seen = [F.expr(f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), "
                   f"i -> struct(i as at, {n} as n, {HASH.format(i='i', n=n)} as h)), array())") for n in sorted(lengths)]
    if not seen:
        return cut.select(*own, F.size("w").cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("hit_words"),
                          F.expr("cast(array() as array<string>)").alias("hit_items"))
    size_of = bitmap_bits(sum(lengths.values()))
    bitmap = _bitmap(wins, size_of)

    def may_hit(x: Column) -> Column:
        def bit(index: Column) -> Column:
            slot = F.get(bitmap, F.shiftright(index, 6).cast("int"))
            return slot.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), index.bitwiseAND(F.lit(63)).cast("int"))) != 0
        h = x["h"]
        last = F.lit(size_of - 1)
        return bit(h.bitwiseAND(last)) & bit(F.shiftrightunsigned(h, 32).bitwiseAND(last))

    maybe = F.concat(*[F.filter(s, may_hit) for s in seen])
    text_of = F.transform(maybe, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("w", x["at"], x["n"]), " ").alias("win")))
    rows = cut.select("rid", "row", F.size("w").alias("n_words"), F.explode_outer(text_of).alias("x"))
    rows = rows.select("rid", "row", "n_words", F.col("x.at").alias("at"), F.col("x.n").alias("n"), F.col("x.win").alias("dwin"))
    known = F.broadcast(wins) if sum(lengths.values()) <= BROADCAST_WINDOWS else wins
    met = rows.join(known, (rows.n == known.len) & (rows.dwin == known.win), "left")
    per = met.groupBy("rid").agg(
        F.first("row").alias("row"), F.first("n_words").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    return per.select(*own, F.col("n_words").cast("long").alias("n_words"), covered.alias("hit_words"), "hit_items")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs. Rows are told apart by doc_id and text."""
    keys = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.octet_length("text").alias("k3"), "text")
    bad = hits(keys, items, size).where(F.size("hit_words") > 0).select("k1", "k2", "k3").distinct()
    given = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    text, doc_id = F.col(given["text"]), F.col(given["doc_id"])
    marked = docs.toDF(*given.values()).withColumns({"id": doc_id, "h": F.xxhash64(text), "n": F.octet_length(text)})
    left = marked.join(bad, same(marked, bad, {"id": "k1", "h": "k2", "n": "k3"}), "left_anti")
    return left.select(*[F.col(g).alias(c) for c, g in given.items()])
