import random

import numpy as np
import xxhash

from lectern.llm import simhash
from lectern.llm.common import components


def brute_print(text, words=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def united(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(3)
    texts = []
    for b in range(12):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 40, 120, 300])))
        texts += [base, base, *(varied(rng, base, e) for e in (0, 1, 1, 2, 3, 5, 9, 20))]
    rng.shuffle(texts)
    return texts


def test_components_of_fingerprints(docs_of):
    texts = corpus()
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "A B"), (903, "a b"), (903, "a b"), (None, "a b")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    roots = united(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    lowest = {}
    for (d, _), r in zip(rows, roots):
        lowest[r] = min((x for x in (lowest.get(r), d) if x is not None), default=None)
    want = sorted((str(d), p, lowest[r]) for (d, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_ball_links_connect_every_close_pair(spark):
    rng = random.Random(5)
    start = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({f ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.7) * (1 << rng.randrange(64)) for f in start for _ in range(8)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components(links).collect()}
    at = united(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    for i in range(len(fps)):
        for j in range(i):
            assert (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])) == (at[i] == at[j])


def brute_copies(rows, similarity=0.8):
    sets = [set(map(int, simhash.shingle_set(t, 5))) for _, t in rows]
    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both >= similarity * len(sets[i] | sets[j])
    return united(len(rows), linked)


def test_one_of_each_group_stays(docs_of):
    texts = corpus()
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, "alone here"), (903, "alone here"), (None, "alone here")]
    docs = docs_of(rows)
    got = sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(docs).collect())
    groups = {}
    for (d, _), r in zip(rows, brute_copies(rows)):
        groups.setdefault(r, []).append(d)
    want = sorted(str(min(x for x in g if x is not None)) for g in groups.values())
    assert got == want
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_copies_inside_a_boilerplate_family(docs_of):
    """Pairs of copies that meet only at keys they share with a large family, of which they are no copies."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(120))
    family = [passage + " " + varied(rng, " ".join(f"q{i}" for i in range(24)), 1) for _ in range(60)]
    crowd = {k for t in family for k in simhash.samples(simhash.shingle_set(t, 5))}
    rows = list(enumerate(family))
    for i in range(1500):
        tail = " ".join(f"t{i}x{j}" for j in range(24))
        two = [passage + " " + varied(rng, tail, e) for e in (1, 2)]
        x, y = (simhash.shingle_set(t, 5) for t in two)
        if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) and set(simhash.samples(x)) & set(simhash.samples(y)) <= crowd:
            rows += [(1000 + len(rows) + k, t) for k, t in enumerate(two)]
    assert len(rows) > len(family) + 6
    got = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs_of(rows)).collect())
    groups = {}
    for (d, _), r in zip(rows, brute_copies(rows)):
        groups.setdefault(r, []).append(d)
    assert got == sorted(min(g) for g in groups.values())


def test_nothing_to_do(messy):
    assert simhash.near_duplicates(messy.limit(0)).count() == 0 and simhash.drop_near_copies(messy.limit(0)).count() == 0
    assert simhash.near_duplicates(messy).count() == messy.count()


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    root = {r["node"]: r["root"] for r in components(links).collect()}
    assert {root[i] for i in range(n)} == {0} and root[1001] == 1000 and 5000 not in root
