"""Operator 8: secret scans with multipart credential linking.

Strong findings (an assignment to a secret's name, an access key, a long hex string) are always reported. Weak parts, each of
which is common in clean text, are reported only where complementary parts meet within a scope: a stretch of ``SCOPE`` code
points in which a login or access key and a secret stand; an endpoint counts where both do. The interval join of the parts of
one text is a merge of their sorted positions, so it is linear in their number, and the whole text is read.

Null and empty texts have no findings. Positions are code points, ends exclusive. Repeated rows are each scanned.
"""
from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.common import in_batches

KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
SCOPE = 400

NAMES = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

LOGIN = re.compile(r"""(?ai:(?:user(?:_?name)?|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""")
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?ai:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")
VARIED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def strong(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings that stand for themselves."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def weak(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside what is taken: logins, strings that look like keys (lower, upper and digits), endpoints."""
    out = [(m.start(1), 3, m.end(1)) for m in LOGIN.finditer(text)] if "=" in text or ":" in text else []
    out += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if all(v.search(m[0]) for v in VARIED)]
    out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    spans = sorted((s, e) for s, _, e in taken)
    starts = [s for s, _ in spans]

    def free(part: tuple[int, int, int]) -> bool:
        i = bisect_left(starts, part[2]) - 1  # the last taken span that starts before the candidate ends
        return i < 0 or spans[i][1] <= part[0]

    return [p for p in out if free(p)]


def near(positions: list[int], start: int, end: int) -> bool:
    """Whether a position lies within a scope of the span."""
    i = bisect_left(positions, start - SCOPE)
    return i < len(positions) and positions[i] <= end + SCOPE


def linked(found: list[tuple[int, int, int]], parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts that complementary parts confirm; strong ones confirm as well."""
    both = [*found, *parts]
    logins = sorted(s for s, k, _ in both if k in (1, 3))
    secrets = sorted(s for s, k, _ in both if k in (0, 2, 4))
    return [(s, k, e) for s, k, e in parts
            if (k == 4 or near(secrets, s, e)) and (k == 3 or near(logins, s, e))]


def findings(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text, (start, kind, end) in order."""
    if not text:
        return []
    base = strong(text)
    return sorted([*base, *linked(base, weak(text, base))])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """``docs`` without ``text`` plus ``spans``: array of (kind, start, end) by start, then kind."""
    keep = [c for c in docs.columns if c not in (text, spans)]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(spans, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in findings(t)] for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, kind)], names=[*keep, spans])

    return docs.mapInArrow(in_batches(run), schema)
