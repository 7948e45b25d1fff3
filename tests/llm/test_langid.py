from pyspark.sql import functions as F

from lectern.llm import langid
from lectern.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = QUERIES["op5_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
    held = out.join(docs, out.doc_id == docs.d).where("held_out")
    n = held.count()
    assert n > 200 and held.where("lang_pred = lang").count() / n > 0.97
    assert out.where("score < 0 or score > 1").count() == 0 and out.count() == docs.count()


def test_messy_table(spark, messy):
    model = langid.fit(messy, remainder(4) != 2)
    out = langid.predict(messy, model).collect()
    assert len(out) == messy.count()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    nothing = langid.fit(messy.limit(0), F.lit(True))
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.predict(messy, nothing).collect()} == {"und"}


def test_language_columns_are_no_inputs(messy):
    model = langid.fit(messy, F.lit(True))
    a = [r["lang_pred"] for r in langid.predict(messy, model).collect()]
    b = [r["lang_pred"] for r in langid.predict(messy.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(0)), model).collect()]
    assert a == b


def grams(text):
    """All n-grams of a text by the rule, as strings."""
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    return [clean[i:i + n] for n in langid.ORDERS for i in range(len(clean) - n + 1) if clean[i:i + n].strip()]


def test_pieces_hold_every_ngram_once(monkeypatch):
    text = "Ünder 12 the GREEN trees; \u0130stanbul \u03a3\u03a3 12 -- fin\u03a3 " * 3
    want = sorted(langid.hashed(text.lower()).tolist())
    assert len(want) == len(grams(text))
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", size)
        assert sorted(b for piece, before in langid.pieces(text) for b in langid.hashed(piece, before).tolist()) == want


def test_against_brute_force(spark, docs_of):
    """Scores computed from n-gram strings counted one by one, each in its bin."""
    import math
    import random
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 12))), lang)
            for i in range(60) for lang, letters in [("aa", "abcde"), ("bb", "cdefgh"), ("cc", "éfghij")][i % 3:i % 3 + 1]]
    docs = docs_of(rows)
    model = langid.fit(docs, F.lit(True))
    bin_of = lambda g: int(langid.hashed(g)[0]) if len(g) == 1 else None
    counts, sizes = {}, {}
    for _, text, lang in rows:
        sizes[lang] = sizes.get(lang, 0) + 1
        for b in langid.hashed(text.lower()).tolist():
            counts.setdefault(lang, {}).setdefault(b, 0)
            counts[lang][b] += 1
    assert bin_of("a") in counts["aa"]
    total = {x: sum(c.values()) + 0.5 * langid.BINS for x, c in counts.items()}
    for r in langid.predict(docs, model).collect():
        bins = langid.hashed((r["text"] or "").lower()).tolist()
        if not bins:
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
            continue
        logs = {x: math.log(sizes[x] / len(rows)) + sum(math.log((counts[x].get(b, 0) + 0.5) / total[x]) for b in bins) for x in counts}
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert r["lang_pred"] == best and abs(r["lang_score"] - share) < 1e-3
