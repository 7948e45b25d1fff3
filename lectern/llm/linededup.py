"""Operator 1: line dedup by a log-template tree of fixed depth.

A line's tokens are parsed by their number, then by the ``DEPTH`` leading ones; tokens that hold a digit are variable fields.
Below a leaf a line's template is taken three ways: with all its remaining tokens, with the first half of them, and with the
second half (the other half generalised). Lines that differ in one more field than those with digits agree on a half, so they
share a template that keeps at least half their tokens; no pair of lines is compared. A template is one only if it keeps enough
tokens that are no fields (``CONSTANT`` of a whole line, ``HALF_CONSTANT`` of a half with its leading tokens).

A template recurs once it stands in ``MIN_DOCS`` different texts (exact copies of a text count once); a whole line of ``PASSAGE``
constant tokens or more, which is no accident, recurs from two texts on. What recurs is dropped: a line whose whole template recurs
goes from every document but the smallest doc_id that has it, where it stays whole. Of other lines a half that recurs goes with the
leading tokens, and the other half stays, tokens joined by blanks; both halves may go, each for a template that stays in the smallest
doc_id that has it.

Only hashes of templates are shuffled, counts are combined first, and the join back splits common templates. Blank lines are
kept. Null texts stay null, empty ones empty. Repeated rows are treated alike; null doc_ids are a document of their own and
never the smallest. Other columns may have any name. Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import same, written

DEPTH = 3
SHORTEST = 2 * DEPTH  # tokens of a line that may be generalised by halves
CONSTANT, HALF_CONSTANT = 2, 4
MIN_DOCS = 10
PASSAGE = 20
FIELD = "<*>"
WHOLE, FIRST, SECOND = 0, 1, 2


def words(line: Column) -> Column:
    """Tokens between ASCII blanks."""
    return F.array_remove(F.split(line, r"[\x09-\x0D\x20]+"), "")


def tokens(line: Column) -> Column:
    """The same, those with a digit replaced by a field."""
    parts = words(line)
    return F.when(F.rlike(line, F.lit("[0-9]")), F.transform(parts, lambda x: F.when(F.rlike(x, F.lit("[0-9]")), FIELD).otherwise(x))).otherwise(parts)


def half(n: Column) -> Column:
    """Tokens of the first half behind the leading ones."""
    return F.ceil((n - DEPTH) / 2).cast("int")


def templates(tok: Column, passage: int = PASSAGE) -> Column:
    """A line's templates: (kind, hash, whether two texts are enough)."""
    n, lead = F.size(tok), F.slice(tok, 1, DEPTH)
    first, second = F.slice(tok, DEPTH + 1, half(n)), F.slice(tok, F.lit(DEPTH + 1) + half(n), n)
    constant = lambda *parts: sum((F.size(F.array_remove(p, FIELD)) for p in parts), F.lit(0))

    def template(kind: int, ok: Column, long: Column, *kept: Column) -> Column:
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), n, *kept).alias("t"), long.alias("long")))

    halves = n >= SHORTEST
    return F.array_compact(F.array(
        template(WHOLE, constant(tok) >= CONSTANT, constant(tok) >= passage, tok),
        template(FIRST, halves & (constant(lead, first) >= HALF_CONSTANT), F.lit(False), lead, first),
        template(SECOND, halves & (constant(lead, second) >= HALF_CONSTANT), F.lit(False), lead, second)))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, passage: int = PASSAGE) -> DataFrame:
    """(k1, k2, cuts): for each document (doc_id, hash of its text) with recurring lines, what goes of them: (line from 0, first half,
    second half). ``docs`` has the columns doc_id and text."""
    lines = docs.where("text is not null").select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("k1", "k2", "pos", F.explode(F.array(tokens(F.col("line")))).alias("tok"))
    parsed, _ = written(lines.select("k1", "k2", "pos", templates(F.col("tok"), passage).alias("ts")).where(F.size("ts") > 0), "lines")
    each = parsed.select("k1", "k2", "pos", F.inline("ts"))
    in_texts = each.groupBy("t", "k2").agg(F.min("k1").alias("first"), F.max("long").alias("long"))
    counted = in_texts.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("long").alias("long"))
    common = counted.where(F.col("n") >= F.when(F.col("long"), min(2, min_docs)).otherwise(min_docs)).select(F.col("t").alias("c"), "first")
    met = each.join(common, each.t == common.c).select("k1", "k2", "pos", "kind", F.col("k1").eqNullSafe(F.col("first")).alias("stays"))
    has = lambda kind, stays: F.max((F.col("kind") == kind) & (F.col("stays") == stays))
    per = met.groupBy("k1", "k2", "pos").agg(has(WHOLE, False).alias("gone"), has(WHOLE, True).alias("kept"), has(FIRST, False).alias("one"), has(SECOND, False).alias("two"))
    cut = per.where(~F.col("kept") & (F.col("gone") | F.col("one") | F.col("two")))
    return cut.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", (F.col("gone") | F.col("one")).alias("one"), (F.col("gone") | F.col("two")).alias("two"))).alias("cuts"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, passage: int = PASSAGE) -> DataFrame:
    """``docs`` without its recurring lines and halves of lines in ``text``, plus __lines, __dropped and __cut (numbers of lines: all,
    taken out, halved)."""
    given = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*given.values()).withColumns({"id": F.col(given["doc_id"]), "body": F.col(given["text"]), "h": F.xxhash64(given["text"])})
    found = recurring_lines(rows.select(F.col("id").alias("doc_id"), F.col("body").alias("text")), min_docs, passage)
    both = rows.join(found, same(rows, found, {"id": "k1", "h": "k2"}), "left")
    by_line = F.map_from_entries(F.transform("cuts", lambda x: F.struct(x["pos"].alias("k"), F.struct(x["one"].alias("one"), x["two"].alias("two")).alias("v"))))
    # Lines of documents with findings only, split once.
    both = both.withColumn("lines", F.explode(F.array(F.when(F.col("cuts").isNotNull(), F.split("body", "\n"))))).withColumn("by_line", by_line)

    def left(line: Column, i: Column) -> Column:
        c = F.try_element_at("by_line", i)
        w = words(line)
        behind = half(F.size(w))
        rest = F.when(c["one"], F.slice(w, F.lit(DEPTH + 1) + behind, F.size(w))).otherwise(F.slice(w, DEPTH + 1, behind))
        return F.when(c.isNull(), line).when(~(c["one"] & c["two"]), F.array_join(rest, " "))

    text = F.when(F.col("cuts").isNull(), F.col("body")).otherwise(F.array_join(F.array_compact(F.transform("lines", left)), "\n"))
    n = F.when(F.col("body").isNull(), 0).otherwise(F.size(F.split("body", "\n")))
    number = lambda both_halves: F.coalesce(F.size(F.filter("cuts", lambda x: (x["one"] & x["two"]) == both_halves)), F.lit(0))
    dropped, cut = (F.when(F.col("cuts").isNull(), 0).otherwise(number(x)).cast("long") for x in (True, False))
    return both.select(*[text.alias(c) if c == "text" else F.col(g).alias(c) for c, g in given.items()],
                       n.cast("long").alias("__lines"), dropped.alias("__dropped"), cut.alias("__cut"))
