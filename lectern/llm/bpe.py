"""Operator 6: byte-pair encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded by backtracking over longest token matches, which an
Aho-Corasick automaton finds in one pass. Two neighbouring tokens may stand side by side only if merging their bytes would
leave exactly these two (pair compatibility); where they may not, the encoder takes the next shorter token or steps back.
The result is the one that merging by rank gives, in time linear in the piece. Decoding gathers bytes through an offset table.

Empty and null texts have no tokens. Repeated rows are each encoded. Other columns are not touched.
"""
from __future__ import annotations

import functools
import gc
import itertools
import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.common import in_batches

# Fixed value: how this tokenizer family cuts texts before encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What a task remembers of words and of pairs before it starts afresh, in bytes as they weigh in Python. It changes no result
#: and is given back when the task ends.
REMEMBERED_BYTES = 24 << 20
WORD_BYTES, PAIR_BYTES = 220, 110
NEVER = 1 << 60
ID = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Known(dict):
    """Results of ``make`` by string. Once full, it starts afresh and keeps the generation before at hand."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.before, self.weight = make, {}, 0

    def forget(self) -> None:
        self.clear()
        self.before, self.weight = {}, 0

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= 64:
            if self.weight >= REMEMBERED_BYTES:
                self.before = dict(self)
                self.clear()
                self.weight = 0
            self.weight += WORD_BYTES + len(part) + len(found)
            self[part] = found
        return found


class Decoder:
    """The bytes of every token in one array, with an offset table."""

    def __init__(self, data: dict) -> None:
        letters, vocab = byte_letters(), data["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for t in data["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.length = list(map(len, self.bytes))
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        return self.blob[where].tobytes().decode("utf-8", "replace")


class Encoder(Decoder):
    """One tokenizer file, ready to encode texts and decode ids."""

    def __init__(self, data: dict) -> None:
        super().__init__(data)
        vocab, size = data["model"]["vocab"], len(self.bytes)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        # merged[left << 32 | right] = rank; halves[id] = the pair it is made of and that merge's rank
        self.merged: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(data["model"]["merges"]):
            i = vocab[left + right]
            self.merged.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.halves.setdefault(i, (vocab[left], vocab[right], rank))
        self.automaton = ahocorasick.Automaton()
        ids = {self.bytes[i].decode("latin-1"): i for i in vocab.values()}
        for token, i in ids.items():
            self.automaton.add_word(token, len(token) << 32 | i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for token, i in ids.items():
            self.shorter[i] = next((ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ids), -1)
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pieces = Known(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())
        self.parts = Known(self.spaced)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the left (0) or right (1) edge while ``token`` is built, smallest first, each with the
        rank of the merge that takes it up."""
        known = self.edges[side]
        if token not in known:
            out, at = [(token, NEVER)], token
            while at in self.halves:
                rank, at = self.halves[at][2], self.halves[at][side]
                out.append((at, rank))
            known[token] = out[::-1]
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the boundary comes before the two tokens are complete; of equal ranks the leftmost merges first."""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        good, merged = True, self.merged
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = merged.get(x << 32 | y, NEVER)
            if rank < x_ends and rank <= y_ends:
                good = False
                break
            # Of two merges of one rank the left one is first; both are over before the boundary is looked at again.
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self.pairs) * PAIR_BYTES >= REMEMBERED_BYTES:
            self.pairs.clear()
        self.pairs[left << 32 | right] = good
        return good

    def forget(self) -> None:
        """Drops what was remembered; the tables of the vocabulary stay."""
        self.pieces.forget()
        self.parts.forget()
        self.pairs.clear()
        self.edges = ({}, {})

    def encode_piece(self, data: bytes) -> list[int]:
        n, length, pairs = len(data), self.length, self.pairs
        longest = [-1] * n
        for end, found in self.automaton.iter(data.decode("latin-1")):  # length << 32 | token
            start = end + 1 - (found >> 32)
            if found > longest[start]:
                longest[start] = found
        closed, tokens, at = set(), [], 0
        token, last = longest[0] & ID if n and longest[0] >= 0 else -1, -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in closed and (last < 0 or (pairs[last << 32 | token] if (last << 32 | token) in pairs else self.compatible(last, token))):
                    break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                at, last = end, token
                token = longest[at] & ID if at < n and longest[at] >= 0 else -1
            else:
                if not tokens:
                    raise ValueError("the vocabulary cannot spell this text")
                closed.add(at)
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
        return tokens

    def spaced(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise KeyError(part)
        return self.cut(" " + part)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. A single space between two other characters always begins a piece, so texts
        are looked up by what stands between spaces; where two blanks meet, the pattern cuts the whole text."""
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.cut(text)
        try:
            return self.cut(first) + b"".join(map(self.parts.__getitem__, rest))
        except KeyError:
            return self.cut(text)

    def cut(self, text: str) -> bytes:
        """Encodes by the pattern. The pieces of long texts are held a part at a time."""
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        parts = itertools.batched((m[0] for m in self.pattern.finditer(text)), 1 << 16)
        return b"".join(b"".join(map(self.pieces.__getitem__, p)) for p in parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.split_added or not any(token in text for token in self.added):
            return self.plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self.plain(text[at:m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


@functools.lru_cache(maxsize=2)
def load(kind: type, path: str) -> Decoder:
    with open(path, encoding="utf-8") as f:
        made = kind(json.load(f))
    gc.freeze()  # the tables live as long as the worker
    return made


def _with_columns(df: DataFrame, new: dict[str, T.DataType], source: str, fn: Callable[[pa.Array], list[pa.Array]],
                  at_end: Callable[[], None] = lambda: None) -> DataFrame:
    """``df`` with the columns ``new`` (at the end) made from ``source``, batch by batch; ``at_end`` runs when a task's rows end."""
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(name, kind) for name, kind in new.items())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch.column(source))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *new])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from in_batches(run)(batches)
        finally:
            at_end()

    return df.mapInArrow(task, schema)


def _encoded(e: Encoder, texts: pa.Array) -> pa.Array:
    return pa.array([e.encode(t) if t else b"" for t in texts.to_pylist()], pa.binary())


def _decoded(d: Decoder, packed: pa.Array) -> pa.Array:
    return pa.array([d.decode(p) if p else "" for p in packed.to_pylist()], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids``: binary, each id a little-endian unsigned 32-bit integer. ``path``: a byte-level BPE file of the
    tokenizers library, present on every node. Empty and null texts give no ids; a column of the name is replaced."""
    return _with_columns(df, {ids: T.BinaryType()}, text, lambda texts: [_encoded(load(Encoder, path), texts)], lambda: load(Encoder, path).forget())


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` plus ``text``: what the ids spell. Null ids give an empty text; a column of the name is replaced."""
    return _with_columns(df, {text: T.StringType()}, ids, lambda packed: [_decoded(load(Decoder, path), packed)])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass of one worker: ``df`` plus ``ids`` and ``decoded``; columns of these names are replaced."""
    def run(texts: pa.Array) -> list[pa.Array]:
        e = load(Encoder, path)
        packed = _encoded(e, texts)
        return [packed, _decoded(e, packed)]

    return _with_columns(df, {ids: T.BinaryType(), decoded: T.StringType()}, text, run, lambda: load(Encoder, path).forget())
