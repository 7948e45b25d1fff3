from pyspark.sql import functions as F

from lectern.llm import linededup


def prose(rng, n):
    return " ".join(f"v{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))


def test_recurring_templates_stay_once(docs_of):
    import random
    rng = random.Random(2)
    rows = []
    for i in range(30):
        lines = [prose(rng, 12), "All rights reserved.", f"Copyright {1990 + i} by the authors of this site", prose(rng, 9),
                 f"Read the full story of {['Ann', 'Bob', 'Cid'][i % 3]} in today's edition"]
        rows.append((100 + i, "\n".join(lines)))
    out = {r["doc_id"]: r for r in linededup.drop_recurring(docs_of(rows), min_docs=10).collect()}
    assert out[100]["text"] == rows[0][1] and out[100]["__dropped"] == 0
    for i, text in rows[1:]:
        lines = text.split("\n")
        first_of_its_name = i < 103  # the whole line recurs, so one document keeps it whole
        assert out[i]["text"] == "\n".join([lines[0], lines[3], *lines[4:][:first_of_its_name]])
        assert out[i]["__dropped"] == 3 - first_of_its_name and out[i]["__lines"] == 5


def test_only_the_half_that_recurs_goes(docs_of):
    rows = [(i, f"the user who left {chr(97 + i)}{chr(98 + i)} has come back home again\nline {'abcdefghijklmnop'[i]} alone") for i in range(12)]
    out = {r["doc_id"]: (r["text"], r["__dropped"], r["__cut"]) for r in linededup.drop_recurring(docs_of(rows), min_docs=10).collect()}
    assert out[0] == (rows[0][1], 0, 0)
    for i in range(1, 12):
        assert out[i] == (f"left {chr(97 + i)}{chr(98 + i)} has come\nline {'abcdefghijklmnop'[i]} alone", 0, 1)


def test_lines_of_fields_are_no_template(docs_of):
    rows = [(i, f"{i} {i * 7} 12/{i}\nTotal: {i}\n1{i} x{i}") for i in range(30)]
    assert {r["doc_id"]: r["text"] for r in linededup.drop_recurring(docs_of(rows), min_docs=2).collect()} == dict(rows)


def test_no_line_leaves_the_corpus(docs_of):
    """Whatever the lines, those whose whole template recurs stay whole in the smallest doc_id that has them, and no long line is left in two texts."""
    import random
    rng = random.Random(12)
    pool = [prose(rng, rng.choice([2, 5, 8, 12, 30, 60])) for _ in range(14)]
    pool += [f"the same beginning of lines {prose(rng, 3)} and the same end here" for _ in range(12)]
    rows = [(100 - i, "\n".join([*rng.sample(pool, 6), prose(rng, 6)])) for i in range(40)]
    rows = list({t: (d, t) for d, t in rows}.values())
    out = {r["doc_id"]: r["text"].split("\n") for r in linededup.drop_recurring(docs_of(rows), min_docs=5).collect()}
    for line in pool:
        holders = [d for d, t in rows if line in t.split("\n")]
        n = len(line.split())
        if len(holders) >= (2 if n >= 20 else 5):
            assert [d for d in holders if line in out[d]] == [min(holders)], line


def test_exact_copies_count_once(docs_of):
    rows = [(i, "a text of its own\nwith two lines here") for i in range(40)]
    out = linededup.drop_recurring(docs_of(rows), min_docs=10).collect()
    assert {r["text"] for r in out} == {rows[0][1]}


def test_pipeline_takes_long_passages_from_two_texts_on(spark, docs_of):
    import random

    import corpus_pipeline
    rng = random.Random(7)
    rows, found = [], {}
    for times in (2, 3, 9):
        passage = prose(rng, 60)
        for i in range(times):
            found[len(rows)] = i > 0
            rows.append((len(rows), "\n".join([prose(rng, 30), passage, f"short line {passage[:4]}", prose(rng, 40)])))
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs_of(rows), "").collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert out[i].split("\n") == [x for x in lines if x != lines[1] or not found[i]]


def test_messy_table(messy, docs_of):
    out = linededup.drop_recurring(messy, min_docs=1).drop("__lines", "__dropped", "__cut")
    assert out.columns == messy.columns and out.count() == messy.count()
    same = linededup.drop_recurring(messy).drop("__lines", "__dropped", "__cut")
    assert sorted(map(str, same.collect())) == sorted(map(str, messy.collect()))
    assert linededup.drop_recurring(messy.limit(0)).count() == 0
    names = docs_of([(i, f"All rights reserved by us.\n{'abc'[i]}") for i in range(3)])
    for c in ("drop", "k1", "k2", "h", "id", "pos", "cuts", "lines", "body", "given_0", "__h"):
        names = names.withColumn(c, F.lit("x"))
    out = linededup.drop_recurring(names, min_docs=2)
    assert out.columns[:-3] == names.columns and sorted(r["text"] for r in out.collect()) == ["All rights reserved by us.\na", "b", "c"]
    null_first = docs_of([(None, "x y z"), (None, "x y z\nmore"), (5, "x y z\nother")])
    left = sorted(str(r["text"]) for r in linededup.drop_recurring(null_first, min_docs=3).collect())
    assert left == ["", "more", "x y z\nother"]
