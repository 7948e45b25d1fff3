import random
import re
import zlib

import pytest

from lectern.llm import variants
from lectern.llm.queries import QUERIES, slipped_words


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts, shortest=7, least=2, factor=10):
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def run(spark, counts, **kw):
    df = spark.createDataFrame([(w, n, "x", 1, 2) for w, n in counts], "word string, n long, wid string, nodes long, kind long")
    rows = variants.variants(df, **kw).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("letters,sizes", [("ab", (3, 9)), ("aéz😀", (3, 6)), ("abcdefgh", (4, 5))])
def test_against_brute_force(spark, letters, sizes):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.choice([1, 2, 3, 20, 25, 300, 5000]) for _ in range(700)}
    assert run(spark, counts.items(), shortest=4) == brute(counts, shortest=4)


def test_over_many_ranges(spark):
    """Ranges of a few words each, so that nodes are shared across several of them."""
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        counts = {"common" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7))): rng.choice([2, 3, 40, 900]) for _ in range(260)}
        assert run(spark, counts.items()) == brute(counts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_chains_lead_to_their_end(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    got = run(spark, [(w, 2 * 10 ** i) for i, w in enumerate(words)])
    assert [got[w][2] for w in words] == [*words[1:], None] and {got[w][4] for w in words} == {words[-1]}


def test_nulls_repeats_long_words_and_empty_tables(spark):
    long = "ab" * 15_000
    got = run(spark, [(None, 5), ("abcdefg", None), ("abcdefg", 1), ("abcdefg", 1), ("short", 9), ("rarelyx", 1), (long, 2), (long + "c", 40), ("", 7), ("abcdefh", 2)])
    assert got == brute({"abcdefg": 2, long: 2, long + "c": 40, "abcdefh": 2})
    assert run(spark, [], shortest=1) == {}
    assert run(spark, [("abcdefg", 1)]) == {}


def words_of(rows):
    counts = {}
    for doc_id, text in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            counts[w] = counts.get(w, 0) + 1
    return counts


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    counts = words_of(docs.collect())
    assert {r["word"]: r["n"] for r in slipped_words(docs).collect()} == {w: n for w, n in counts.items() if len(w) >= 7}
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert len(words) > 100
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.variants(slipped_words(docs)).collect()}
    assert got == brute(counts)
    assert QUERIES["op12_spelling_variants"](spark, sf).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_messy_texts(spark, messy):
    got = {r["word"]: r["n"] for r in slipped_words(messy).collect()}
    want = words_of([(r["doc_id"], r["text"]) for r in messy.collect()])
    assert got == {w: n for w, n in want.items() if len(w) >= 7}
    assert slipped_words(messy.limit(0)).count() == 0
