import re

from pyspark.sql import functions as F

from lectern.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, met = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(own) - k + 1):
                if own[i:i + k] == w[j:j + k]:
                    hit.update(range(i + 1, i + k + 1))
                    met.add(str(item))
    return len(own), sorted(hit), sorted(met)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "Short ITEM!"), (3, None), (4, "..."), (5, "Élan vital"),
         (6, "one two three four five six seven eight nine ten")]
TEXTS = ["x one two three four five six seven eight nine ten eleven y", "ONE,two;three four five six seven eight nine ten eleven twelve" * 2, "a short-item and short item", "short", "", None,
         "élan vital", "ÉLAN vital", "Élan Vital", "one two three four five six seven eight nine", "short item short item"]


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, TEXTS[0])]
    out = decontaminate.hits(docs_of(rows), table(spark, ITEMS)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sorted(r["hit_words"]), r["hit_items"]) for r in out)
    assert got == sorted((str(d), *brute(t, ITEMS)) for d, t in rows)


def test_shuffle_join_gives_the_same(spark, docs_of, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    want = sorted(map(str, decontaminate.hits(docs_of(rows), table(spark, ITEMS)).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontaminate.hits(docs_of(rows), table(spark, ITEMS)).collect())) == want


def test_clean_keeps_the_rest(spark, docs_of, messy):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, "fine")]
    docs = docs_of(rows)
    left = decontaminate.clean(docs, table(spark, ITEMS))
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.where("text is not null").collect()) == sorted(
        (str(d), t) for d, t in rows if t is not None and not brute(t, ITEMS)[1])
    assert left.where("text is null").count() == 1
    nothing = table(spark, ITEMS).limit(0)
    assert decontaminate.clean(messy, nothing).count() == messy.count()
    assert decontaminate.clean(messy.limit(0), table(spark, ITEMS)).count() == 0
    assert decontaminate.hits(messy, table(spark, ITEMS)).count() == messy.count()


def test_clashing_columns_and_bitmap_sizes(spark, docs_of):
    docs = docs_of([(1, "one two three four five six seven eight nine ten eleven")])
    for c in ("one", "n_words", "hit_words", "row", "c0", "w", "len", "win", "items", "k1", "__h"):
        docs = docs.withColumn(c, F.lit("x"))
    items = spark.createDataFrame([(5, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    r = decontaminate.hits(docs, items).first()
    assert (r["n_words"], len(r["hit_words"]), r["hit_items"], r["one"], r["c0"], r["row"]) == (11, 10, ["5"], "x", "x", "x")
    assert decontaminate.hits(docs, items.limit(0)).first()["one"] == "x"
    kept = decontaminate.clean(docs, items.limit(0))
    assert kept.columns == docs.columns and kept.count() == 1 and decontaminate.clean(docs, items).count() == 0
    assert [decontaminate.bitmap_bits(n) for n in (0, 1 << 14, (1 << 14) + 1, 500_000, 1 << 40)] == [1 << 18, 1 << 18, 1 << 19, 1 << 23, 1 << 23]
