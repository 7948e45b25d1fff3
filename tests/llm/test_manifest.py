import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest
from lectern.llm.queries import QUERIES


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """Root and, for every node, its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, i in enumerate(at):
            first = i - i % 3
            paths[leaf_no].append((nodes[first:i], nodes[i + 1:first + 3]))
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: (group, order, leaf); sorted list of (leaf, siblings, subroot, root)."""
    groups = {}
    for g, o, x in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append(x)
    made = {g: tree(xs) for g, xs in groups.items()}
    root, tops = tree([made[g][0] for g in groups])
    out = []
    for (g, xs), top in zip(groups.items(), tops):
        for x, path in zip(xs, made[g][1]):
            out.append((x, "".join("".join(a + b) for a, b in path + top), made[g][0], root))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "y", "z", 1) for r in rows], "g string, o long, leaf string, tree string, row string, at int")
    out = manifest.manifest(df, F.col("leaf"), F.col("g"), F.col("o"))
    got = out.select("leaf", manifest.siblings(F.col("path")).alias("s"), "subroot", "root", manifest.folded(F.col("leaf"), F.col("path")).alias("f"), "row").collect()
    assert all(r["f"] == r["root"] and r["row"]["tree"] == "y" for r in got)
    return sorted((r["leaf"], r["s"], r["subroot"], r["root"]) for r in got)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1, 4], [10, 28, 81, 82], [243, 244, 1, 730], [1] * 30])
def test_against_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(None if g == 1 else f"s{g}é"[:1 + g % 3] + str(g), i, H(str(g), str(i))) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)  # blocks of nine: four rounds
    rows = [("hot" if i % 3 else f"g{i % 50}", i, H(str(i))) for i in range(2000)]
    assert run(spark, rows) == brute(rows)


def test_ties_repeats_and_nulls(spark):
    rows = [("a", 1, H("x"))] * 5 + [("a", None, H("y"))] * 2 + [("a", 1, H("w")), ("", 3, H("v")), (None, None, H("u"))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    of = {d["doc_id"]: leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in docs}
    want = {x: rest for x, *rest in brute([(d["source"], d["doc_id"], of[d["doc_id"]]) for d in docs])}
    got = QUERIES["op13_manifest"](spark, sf).collect()
    assert len(got) == len(docs)
    by_id = {d["doc_id"]: d for d in docs}
    for r in got:
        d = by_id[r["doc_id"]]
        siblings, subroot, root = want[of[d["doc_id"]]]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (of[d["doc_id"]], subroot, root, H(siblings))
        changed = zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and "\n" in d["text"]
        assert r["verified"] == (not changed) == (r["folded_root"] == root)
    assert {r["verified"] for r in got} == {True, False}


def test_messy_rows(spark, messy):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    made = manifest.manifest(messy.drop("text").withColumn("leaf", manifest.leaf_of(F.lit(1))), F.col("leaf"), F.col("lang"), F.col("doc_id"))
    assert made.count() == messy.count() and made.select("row.*").columns == [c for c in [*messy.columns, "leaf"] if c != "text"]
    got = sorted(r[0] for r in messy.select(manifest.leaf_of(*[F.col(c) for c in fields])).collect())
    assert got == sorted(leaf(*[r[c] for c in fields]) for r in messy.collect())
