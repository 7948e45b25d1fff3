"""Operator 3: SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bits are the majority of its shingles' hashes. Two fingerprints that differ in at most two bits have a
common neighbour at one bit or less from both, so every distinct fingerprint is sent to all 65 values within one bit
(half the radius), values are shuffled, and fingerprints meeting at a value are linked to the smallest there, verified by
their distance. A value has at most 65 visitors however large the corpus, and copies with one fingerprint travel once.

Null and empty texts have fingerprint zero, linked like any other. Null doc_ids take part; they are never the smallest
unless a component has no other. Repeated rows are each returned.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lectern.llm.common import components, in_batches, written

SEED = 42
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle: ``words`` lower-cased words joined by a space; of a shorter text, the whole sequence."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    cuts = map(line.__getitem__, map(slice, starts[:n].tolist(), ends[words - 1:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half the hashes have it; zero for none. Signed, as Spark's long."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[start:start + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text plus ``name``: the signed 64-bit fingerprint of ``text``."""
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [majority(shingle_hashes(t, words)) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.int64())], names=[*keep, name])

    return docs.mapInArrow(in_batches(run), schema)


def ball_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints at most two bits apart; not all pairs, but every such pair is connected.

    Those at a value are linked to the smallest there. Each is within one bit of the value, so they are within two of each
    other and the star loses no connection; the distance is checked all the same.
    """
    own = fps.select(F.col(fp).alias("b")).distinct()
    flips = F.expr("concat(array(b), transform(sequence(0, 63), i -> b ^ shiftleft(1L, i)))")
    sent = own.select("b", F.explode(flips).alias("at"))
    met = sent.withColumn("a", F.min("b").over(Window.partitionBy("at")))
    return met.where("a <> b and bit_count(a ^ b) <= 2").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component_id``, the smallest id reachable over links of two bits."""
    prints, _ = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, "text"), "prints")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(ball_links(prints))
    of = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(lowest, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, prints.fp == named.f, "left").select("doc_id", "fp", "component_id")


# --- near copies by shingle overlap --------------------------------------------------------------------------------------
#
# A 64-bit majority fingerprint at two bits finds near-exact copies only: copies with four fifths of their five-word shingles
# in common lie 7 to 12 bits apart, and a ball of that radius has too many values to send. The links of the ball are therefore
# completed by links between texts that agree on a sample of shingles, and every link is verified on the whole shingle sets.

SAMPLES, SAMPLE_SIZE = 16, 4  # a pair at 0.8 is missed by all samples with probability (1 - 0.8 ** 4) ** 16 = 0.0002
BROADCAST_IDS = 1_000_000
TURNS = 3  # of drawn comparisons before the full one
SLACK = 1e-9  # bounds err on the side of comparing
_RNG = np.random.default_rng(SEED)
MULTIPLY = _RNG.integers(0, 1 << 63, SAMPLES * SAMPLE_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, SAMPLES * SAMPLE_SIZE, dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def samples(hashes: np.ndarray) -> list[int]:
    """One key per sample: the shingles smallest under SAMPLE_SIZE fixed orders. No shingles, no keys."""
    if not len(hashes):
        return []
    least = np.full(len(MULTIPLY), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1 << 12):
        mixed = hashes[start:start + (1 << 12), None] * MULTIPLY + ADD
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    parts = least.reshape(SAMPLES, SAMPLE_SIZE)
    return [signed(xxhash.xxh64_intdigest(p.tobytes(), i)) for i, p in enumerate(parts)]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _sketch(rows: DataFrame, words: int) -> DataFrame:
    """rid, row, and of the row's text: class (hash of its shingle set), fp, keys."""
    kind = rows.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, fps, keys = [], [], []
        for text in batch.column("text").to_pylist():
            own = shingle_set(text, words)
            classes.append(signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)))
            fps.append(majority(own))
            keys.append(samples(own))
        return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), pa.array(classes, pa.int64()), pa.array(fps, pa.int64()),
                                           pa.array(keys, pa.list_(pa.int64()))], names=["rid", "row", "class", "fp", "keys"])

    return rows.mapInArrow(in_batches(run), f"rid long, row {kind}, class long, fp long, keys array<bigint>")


def _stars(groups: DataFrame, turn: int) -> DataFrame:
    """(a, b) from (class, at, part): in each group, the classes of other parts with one class, drawn anew each turn (at first the
    smallest). The draw is an aggregate joined back, so a group of any size stays spread out and no group is paired off."""
    drawn = F.xxhash64("class", "at", F.lit(turn)) if turn else F.col("class")
    middle = groups.groupBy(F.col("at").alias("k")).agg(F.min(F.struct(drawn.alias("o"), "class", "part")).alias("middle"))
    met = groups.join(middle, F.col("at") == F.col("k")).where(F.col("part") != F.col("middle.part"))
    return met.select(F.least("class", "middle.class").alias("a"), F.greatest("class", "middle.class").alias("b")).distinct()


def _between_prints(one: DataFrame) -> DataFrame:
    """(a, b) of classes from the ball's links of fingerprints."""
    of_print = one.groupBy("fp").agg(F.min("class").alias("class"))
    ends = [of_print.select(F.col("fp").alias(f"p{x}"), F.col("class").alias(f"c{x}")) for x in "ab"]
    met = ball_links(of_print).join(ends[0], F.col("a") == F.col("pa")).join(ends[1], F.col("b") == F.col("pb"))
    return met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(class, size, at, rest): each class's rarest shingles, as many as it takes that two classes of ``similarity`` or more have one
    in common; ``rest`` is the number of its shingles from this one on in the order (number of classes, shingle). Shingles of
    one class alone lead the order and join nothing, so a class with more of these than a copy may have sends nothing."""
    each = sets.select("class", F.size("hashes").alias("size"), F.explode("hashes").alias("at"))
    shared = each.groupBy(F.col("at").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = each.join(shared, F.col("at") == F.col("k")).groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at"))).alias("all"))
    room = (F.size("all") - F.ceil(similarity * F.col("size") - SLACK) + 1).cast("int")
    own = own.withColumn("room", room).where("room > 0")
    lead = own.select("class", "size", F.size("all").alias("n"), F.posexplode(F.slice("all", 1, F.col("room"))).alias("i", "x"))
    return lead.select("class", "size", F.col("x.at").alias("at"), (F.col("n") - F.col("i")).alias("rest"))


def _apart(prefixes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of classes in different parts that can have ``similarity``. At the first shingle two classes have in common
    no more can follow than either has left, which must be enough. In each group those outside its largest part are joined with
    all, so a part is never paired off with itself."""
    parted, _ = written(prefixes.join(roots, F.col("class") == F.col("node"), "left").select("class", "size", "at", "rest", F.coalesce("root", "class").alias("part")), "prefixes")
    sizes = parted.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(F.col("at").alias("k")).agg(F.max(F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed, _ = written(parted.join(main, F.col("at") == F.col("k")).select("class", "size", "at", "rest", "part", (F.col("part") == F.col("main.part")).alias("most")), "mixed")
    left, right = (mixed.select(*[F.col(c).alias(f"{c}_{x}") for c in mixed.columns]) for x in "ab")
    enough = F.least("rest_a", "rest_b") >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - SLACK
    once = F.col("most_b") | (F.col("class_a") < F.col("class_b"))
    met = left.where(~F.col("most_a")).join(right, (F.col("at_a") == F.col("at_b")) & (F.col("part_a") != F.col("part_b")) & once & enough)
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def copy_classes(sketched: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the classes linked, over any chain, by a Jaccard similarity of ``similarity`` or more of their shingle sets.

    Classes that agree on a fingerprint or a sample are compared with one of their group and those found alike are united; so are,
    for up to ``TURNS`` turns, those still apart from another drawn from their group. This only makes large families one part
    cheaply. Then every pair of these classes that is still in two parts and can reach ``similarity`` is compared (``_apart``).
    """
    one, _ = written(sketched.groupBy("class").agg(F.min("rid").alias("rid"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    at = one.select("class", F.explode(F.concat(F.array("fp"), F.col("keys"))).alias("at"))
    crowded = at.groupBy(F.col("at").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    groups, _ = written(at.join(crowded, F.col("at") == F.col("k"), "left_semi"), "groups")
    ball, _ = written(_between_prints(one), "ball")

    ends = groups.select(F.col("class").alias("c")).union(ball.select(F.explode(F.array("a", "b")))).distinct()
    wanted = one.join(ends, F.col("class") == F.col("c"), "left_semi").select(F.col("rid").alias("wanted"))
    few = wanted.count() <= BROADCAST_IDS
    rows = sketched.join(F.broadcast(wanted) if few else wanted, F.col("rid") == F.col("wanted"), "left_semi").select("class", F.col("row.text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.list_(pa.int64()))], names=["class", "hashes"])

    sets, _ = written(rows.mapInArrow(in_batches(run), "class long, hashes array<bigint>"), "sets")
    left, right = (sets.select(F.col("class").alias(f"c{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")

    def verified(links: DataFrame) -> DataFrame:
        met = links.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
        both = F.size(F.array_intersect("ha", "hb"))
        return written(met.where(both >= similarity * (F.size("ha") + F.size("hb") - both)).select("a", "b"), "verified")[0]

    tested, _ = written(_stars(groups.withColumn("part", F.col("class")), 0).union(ball).distinct(), "compared")
    found = verified(tested)
    for turn in range(1, TURNS + 1):
        roots = components(found, "copies")
        parted = groups.join(roots, F.col("class") == F.col("node"), "left").select("class", "at", F.coalesce("root", "class").alias("part"))
        links, _ = written(_stars(parted, turn).join(tested, ["a", "b"], "left_anti"), "compared")
        new = verified(links)
        if new.isEmpty():
            break
        found, tested = found.union(new), tested.union(links)
    roots, _ = written(components(found, "copies"), "roots")
    links, _ = written(_apart(_prefixes(sets, similarity), roots, similarity).join(tested, ["a", "b"], "left_anti"), "compared")
    return components(found.union(verified(links)), "copies")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each group of near copies: that of the smallest doc_id (nulls last). Texts are near copies if
    the Jaccard similarity of their sets of word shingles is ``similarity`` or more, or over a chain of such; texts without words
    are copies of each other."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row"), "text")
    sketched, _ = written(_sketch(rows, words), "sketches")
    roots = copy_classes(sketched, words, similarity)
    of = sketched.select("class", "rid", F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("doc_id"), "rid").alias("at"))
    first = of.groupBy("class").agg(F.min("at").alias("at"))
    lowest = first.join(roots, F.col("class") == F.col("node"), "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("at").alias("at"))
    stay = lowest.select(F.col("at.rid").alias("stays"))
    return sketched.join(stay, F.col("rid") == F.col("stays"), "left_semi").select("row.*")
