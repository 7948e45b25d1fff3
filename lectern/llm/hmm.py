"""Operator 2: a hidden Markov language model trained by Baum-Welch over the whole training corpus.

Tokens are words (A-Z lower-cased, cut at ASCII blanks) and one end per text. Word counts of all training texts are a table in
the shared folder. The ``TOP`` most frequent words and the end are classes of their own, all others share ``HASHED`` classes by
hash, so the model's size is fixed; a word of a shared class has probability P(class | state) * (c + 0.5) / (class count + 0.5 *
(class words + 1)), which leaves room for unknown words. Texts become class sequences once. Each round of Baum-Welch runs
scaled forward-backward in numpy within partitions, sums expected counts over partitions in Spark and renews the model from
states x classes numbers on the driver; a bounded sample (``SAMPLE`` texts) only starts it. The scaled forward recursion then
gives the exact likelihood of every text. The counts of words outside the broadcast classes are joined by word; no word there
is frequent, and each text sends a word once.

Null texts are empty: one end token. Rows with null id are given by the caller as training rows or not. Repeated rows are
scored each. With no training rows every state is uniform and nothing is known. Very long texts are scored whole; for training
they are cut into sequences of ``LONGEST`` tokens, all of which count.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, written

STATES = 8
TOP = 30_000
HASHED = 2_000
ROUNDS = 3
SAMPLE, SAMPLE_ROUNDS, SAMPLE_TOKENS = 1_500, 12, 2_000
LONGEST = 1 << 15
CELLS = 1 << 18  # tokens of a batch of sequences: long ones are few, so a step over them is shared by more
WORDS_HELD = 300_000
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _bucket(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return (h - (1 << 64) if h >> 63 else h) % HASHED


@dataclass
class Lexicon:
    """Classes of words and their logarithms; bounded by TOP and HASHED."""
    top: dict[bytes, int]
    tokens: int  # N
    kinds: int  # V
    counts: np.ndarray  # training tokens by class; the last class is the end
    kinds_in: np.ndarray  # distinct words by class

    @property
    def end(self) -> int:
        return len(self.counts) - 1

    def classes(self, parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Class of every token, the end included, and the words outside the broadcast ones."""
        get, rest, out = self.top.get, [], []
        for w in parts:
            c = get(w)
            if c is None:
                rest.append(w)
                c = len(self.top) + _bucket(w)
            out.append(c)
        out.append(self.end)
        return np.array(out, np.uint16), rest

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states: P(class | state)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all rows of ``text``; each task sends a word once per WORDS_HELD distinct ones it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words(text))
                if len(seen) >= WORDS_HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    # Words are graded by an eighth of a power of two of their count. Grades that cannot hold one of the TOP most frequent words are left out
    # first, so no task sends the driver more than its share of these words.
    graded = counts.withColumn("grade", F.floor(F.log2(F.col("c").cast("double")) * 8))
    least, seen = 0, 0
    for r in sorted(graded.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):
        least, seen = r["grade"], seen + r["count"]
        if seen >= TOP:
            break
    top = graded.where(F.col("grade") >= least).orderBy(F.desc("c"), "word").limit(TOP).collect()
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    n = len(known) + HASHED + 1
    sizes, kinds = np.zeros(n), np.zeros(n)
    sizes[:len(top)], kinds[:len(top)] = [r["c"] for r in top], 1
    known_words = counts.sparkSession.createDataFrame([(r["word"],) for r in top], "top binary")
    rest = counts.join(F.broadcast(known_words), F.col("word") == F.col("top"), "left_anti")
    by = rest.groupBy(F.pmod(F.xxhash64("word"), F.lit(HASHED)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
    for r in by.collect():
        sizes[len(known) + r["b"]], kinds[len(known) + r["b"]] = r["c"], r["k"]
    sizes[-1], kinds[-1] = texts, min(1, texts)
    return Lexicon(known, int(sizes.sum()), int(kinds.sum()), sizes, kinds)


def batches_of(sequences: list[np.ndarray], pad: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(positions in the list, classes by step and sequence, sequences alive at each step), longest first; ``pad`` is the class
    of the cells behind a sequence's end."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        take = order[at:at + max(1, CELLS // max(1, longest))]
        at += len(take)
        ids = np.full((longest, len(take)), pad, np.int64)
        lengths = np.array([len(sequences[i]) for i in take])
        for column, i in enumerate(take):
            ids[:lengths[column], column] = sequences[i]
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        yield take, ids, alive


def emissions(m: Model) -> np.ndarray:
    """P(class | state) by state and class, with a last class that no state emits, for the cells behind a sequence's end."""
    return np.ascontiguousarray(np.concatenate([m.emit, np.zeros((1, len(m.start)))]).T)


def forward(m: Model, emitting: np.ndarray, alive: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values (states x steps x sequences) and scales (steps x sequences) for the emission probabilities of some
    steps; ``before`` are the values of the step before the first one, none at the start of the sequences."""
    alphas, scales = np.zeros_like(emitting), np.ones(emitting.shape[1:])
    move = np.ascontiguousarray(m.move.T)
    for t, n in enumerate(alive):
        now, scale = alphas[:, t, :n], scales[t, :n]
        if before is None:
            np.multiply(m.start[:, None], emitting[:, t, :n], out=now)
        else:
            np.matmul(move, before[:, :n], out=now)
            now *= emitting[:, t, :n]
        np.add.reduce(now, axis=0, out=scale)
        now /= scale
        before = now
    return alphas, scales


def likelihoods(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence."""
    out, table = np.zeros(len(sequences)), emissions(m)
    for take, ids, alive in batches_of(sequences, len(m.emit)):
        before, steps = None, max(1, CELLS // len(take))  # a long text is walked in pieces that hand their last values on
        for at in range(0, len(ids), steps):
            alphas, scales = forward(m, np.take(table, ids[at:at + steps], axis=1), alive[at:at + steps], before)
            out[take] += np.log10(scales).sum(axis=0)
            before = alphas[:, -1].copy()
    return out


def expected(m: Model, sequences: list[np.ndarray], emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
    """Adds the expected counts of the sequences to the three arrays."""
    cut = [s[i:i + LONGEST] for s in sequences for i in range(0, len(s), LONGEST)]
    table, states = emissions(m), len(m.start)
    for _, ids, alive in batches_of(cut, len(m.emit)):
        width = ids.shape[1]
        into = np.take(table, ids, axis=1)
        alphas, scales = forward(m, into, alive)
        into /= scales
        gammas, beta = np.zeros_like(alphas), np.ones((states, width))
        for t in range(len(ids) - 1, -1, -1):
            n = alive[t]
            np.multiply(alphas[:, t, :n], beta[:, :n], out=gammas[:, t, :n])
            if t:
                ahead = into[:, t, :n]
                ahead *= beta[:, :n]
                np.matmul(m.move, ahead, out=beta[:, :n])
        started += gammas[:, 0].sum(axis=1)
        moved += (alphas.reshape(states, -1)[:, :-width] @ into.reshape(states, -1)[:, width:].T) * m.move
        seen = ids.ravel()
        for k in range(states):
            emitted[:, k] += np.bincount(seen, gammas[k].ravel(), minlength=len(emitted) + 1)[:-1]


def renewed(lex: Lexicon, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> Model:
    """The model of the expected counts. Classes that training never saw keep the probability all states share; the others are
    drawn towards it the more, the more different classes a state emits for its number of tokens (Witten-Bell)."""
    shared = (lex.counts + 0.5) / (lex.counts.sum() + 0.5 * len(lex.counts))
    seen = lex.counts > 0
    known = shared[seen].sum()
    own = emitted[seen]
    kinds, tokens = np.minimum(own, 1.0).sum(axis=0), own.sum(axis=0)
    emit = np.repeat(shared[:, None], len(started), axis=1)
    emit[seen] = known * (own + kinds * (shared[seen] / max(known, 1e-300))[:, None] + 1e-9 * shared[seen][:, None]) / (tokens + kinds + 1e-9 * known)
    move, start = moved + 1.0, started + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def first_model(lex: Lexicon, sample: list[np.ndarray]) -> Model:
    """Baum-Welch on the sample, from states that differ by fixed noise and rather stay than move."""
    rng = np.random.default_rng(7)
    shared = (lex.counts + 0.5) / (lex.counts.sum() + 0.5 * len(lex.counts))
    emit = shared[:, None] * rng.gamma(1.0, size=(len(shared), STATES))
    m = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1)), emit / emit.sum(axis=0))
    for _ in range(SAMPLE_ROUNDS if sample else 0):
        sums = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start)
        expected(m, sample, *sums)
        m = renewed(lex, *sums)
    return m


def train(texts: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """``texts``: (ids binary) of all training texts."""
    spark, size = texts.sparkSession, len(lex.counts)
    # The sample is that of the lowest hashes; rows whose hash cannot be among them are left out first, and copies of a text are one, so the
    # driver gets about three times the sample at most, however many tasks there are. Only the start of the training depends on it.
    short = texts.where(F.octet_length("ids") <= 2 * SAMPLE_TOKENS).select("ids", F.xxhash64("ids").alias("h"))
    share = min(1.0, 3 * SAMPLE / max(1, int(lex.counts[lex.end])))  # one end for each training text
    drawn = short if share == 1.0 else short.where(F.col("h") < int(-(1 << 63) + share * (1 << 64)))
    sample = drawn.groupBy("h").agg(F.first("ids").alias("ids")).orderBy("h").limit(SAMPLE).collect()
    m = first_model(lex, [np.frombuffer(r["ids"], np.uint16) for r in sample])
    names = [f"g{k}" for k in range(STATES)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            sums = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start)
            for batch in batches:
                expected(m, [np.frombuffer(b, np.uint16) for b in batch.column("ids").to_pylist()], *sums)
            rows = np.concatenate([sums[0], sums[1], sums[2][None]])
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(rows[at, k]) for k in range(STATES))], names=["at", *names])

        found = texts.select("ids").mapInArrow(run, "at int, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(
            *[F.sum(n).alias(n) for n in names]).toPandas()
        rows = np.zeros((size + STATES + 1, STATES))
        rows[found["at"].to_numpy(int)] = found[names].to_numpy()
        m = renewed(lex, rows[:size], rows[size:-1], rows[-1])
    return m


def score(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` plus n_tokens, n_known, train_tokens, base_score and score (columns of these names are replaced);
    ``learn`` says which rows are training rows (over the columns of ``docs``)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (text, *MADE)]
    rows = docs.select(F.struct(*keep, F.lit(1).alias("__one")).alias("row"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts, _ = written(count_words(rows.where("learn")), "words")
    lex = lexicon(counts, rows.where("learn").count())
    shared = spark.sparkContext.broadcast(lex)

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = shared.value, []
        logs = own.base(own.counts)
        for parts in map(words, batch.column("text").to_pylist()):
            ids, rest = own.classes(parts)
            plain = (ids < len(own.top)) | (ids == own.end)
            some = Counter(rest)
            out.append((ids.tobytes(), len(ids), int((own.counts[ids[plain]] > 0).sum()), float(logs[ids[plain]].sum()),
                        [{"word": w, "n": n} for w, n in some.items()]))
        cols = list(zip(*out, strict=True))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "row", "learn")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                          names=["rid", "row", "learn", "ids", "n_tokens", "n_known", "base", "rare"])

    kept = rows.select(F.monotonically_increasing_id().alias("rid"), "row", "learn", "text")
    kind = kept.schema["row"].dataType.simpleString()
    parsed, _ = written(kept.mapInArrow(in_batches(parse), f"rid long, row {kind}, learn boolean, ids binary, n_tokens long, n_known long, base double, "
                                                            "rare array<struct<word: binary, n: bigint>>"), "parsed")
    m = train(parsed.where("learn").select("ids"), lex)
    model = spark.sparkContext.broadcast(m)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = likelihoods(model.value, [np.frombuffer(b, np.uint16) for b in batch.column("ids").to_pylist()])
        keep = ("rid", "row", "n_tokens", "n_known", "base")
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "hmm"])

    scored = parsed.select("rid", "row", "n_tokens", "n_known", "base", "ids").mapInArrow(
        in_batches(run), f"rid long, row {kind}, n_tokens long, n_known long, base double, hmm double")
    sizes = spark.createDataFrame([(i, float(lex.counts[len(lex.top) + i] + 0.5 * (lex.kinds_in[len(lex.top) + i] + 1))) for i in range(HASHED)], "b long, size double")
    rare = parsed.select("rid", F.explode("rare").alias("x")).select("rid", "x.word", "x.n")
    both = rare.join(counts.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    both = both.join(F.broadcast(sizes), F.pmod(F.xxhash64("word"), F.lit(HASHED)) == F.col("b"))
    c = F.coalesce("c", F.lit(0)) + 0.5
    per = both.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10(c / (lex.tokens + 0.5 * (lex.kinds + 1)))).alias("base2"), F.sum(F.col("n") * F.log10(c / F.col("size"))).alias("in_class"))
    out = scored.join(per, "rid", "left")
    return out.select("row.*", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), (F.col("hmm") + F.coalesce("in_class", F.lit(0.0))).alias("score")).drop("__one")
