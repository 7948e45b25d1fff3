import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import hmm
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tiny():
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))


def by_paths(m, seq):
    total = 0.0
    for path in itertools.product(range(3), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
    return math.log10(total)


def test_forward_sums_all_paths():
    m, rng = tiny(), np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 3, 7, 1, 4)]
    assert np.allclose(hmm.likelihoods(m, seqs), [by_paths(m, s) for s in seqs])


def test_expected_counts_are_those_of_all_paths():
    m, rng = tiny(), np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (5, 2, 1)]
    got = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    hmm.expected(m, seqs, *got)
    want = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for s in seqs:
        whole = 10 ** by_paths(m, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            want[2][path[0]] += p / whole
            for t, k in enumerate(path):
                want[0][s[t], k] += p / whole
                if t:
                    want[1][path[t - 1], k] += p / whole
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for d, t in docs.items():
        if not held(d):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = QUERIES["op2_hmm_scores"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        tokens = [*(docs[r["doc_id"]] or "").encode().lower().split(), None]
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])


def test_models_are_distributions(docs_of):
    rng = np.random.default_rng(3)
    counts = np.array([50.0, 30, 1, 0, 0, 9])
    lex = hmm.Lexicon({b"a": 0, b"b": 1, b"c": 2}, 90, 4, counts, (counts > 0) * 1.0)
    m = hmm.renewed(lex, rng.random((6, 3)) * (counts > 0)[:, None] * 20, rng.random((3, 3)), rng.random(3))
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and np.isclose(m.start.sum(), 1) and (m.emit > 0).all()
    assert np.allclose(m.emit[3], 0.5 / 93)


def test_rounds_raise_the_likelihood(docs_of):
    rng = np.random.default_rng(4)
    seqs = [np.concatenate([rng.integers(0, 3, 30), [5]]) if i % 2 else np.concatenate([rng.integers(2, 5, 30), [5]]) for i in range(60)]
    counts = np.bincount(np.concatenate(seqs), minlength=6).astype(float)
    lex = hmm.Lexicon({}, int(counts.sum()), 6, counts, np.ones(6))
    first, later = hmm.first_model(lex, []), hmm.first_model(lex, seqs)
    assert hmm.likelihoods(later, seqs).sum() > hmm.likelihoods(first, seqs).sum() + 10


def test_messy_table(messy):
    out = hmm.score(messy.drop("score"), F.col("doc_id") != 4)
    rows = out.collect()
    assert len(rows) == messy.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    none = hmm.score(messy.drop("score"), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}
    assert hmm.score(messy.drop("score").limit(0), F.lit(True)).count() == 0
