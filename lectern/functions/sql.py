"""The text and scoring functions by name in SQL.

``register(spark)`` creates a temporary SQL function for each; ``statements()`` gives the text. Bodies are SQL expressions made of
built-in functions, so a query that uses them is planned like any other. Arguments used more than once are bound by a
one-element array, as the Column forms do.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from . import text as T

STRINGS, SCORES = "ARRAY<STRING>", "STRUCT<em: DOUBLE, anls: DOUBLE, contains: DOUBLE, abstain: DOUBLE, error: DOUBLE>"


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _text(x: str) -> str:
    return f"coalesce({x}, '')"


def _spaced(x: str) -> str:
    return f"btrim(regexp_replace({x}, {literal('(?U)' + chr(92) + 's+')}, ' '))"


def clean(x: str) -> str:
    return _spaced(f"lower({_text(x)})")


def normalize(x: str) -> str:
    return f"btrim({clean(x)}, {literal(T.OUTER_PUNCT)})"


def compat(x: str) -> str:
    out = f"translate({_text(x)}, {literal(T._COMPAT[0])}, {literal(T._COMPAT[1])})"
    for ligature, plain in T._LIGATURES:
        out = f"replace({out}, {literal(ligature)}, {literal(plain)})"
    return out


def norm_text(x: str) -> str:
    low = f"translate(lower({compat(x)}), {literal(T.CURLY)}, {literal(T.STRAIGHT)})"
    joined = f"regexp_replace({low}, {literal(r'(?<=\d),(?=\d{3})')}, '')"
    return _spaced(f"regexp_replace({joined}, {literal(r'(?U)[^\w\s.%$/-]')}, ' ')")


def tokens(x: str) -> str:
    return f"filter(transform(split({norm_text(x)}, ' '), t -> btrim(t, '.-/')), t -> t <> '')"


def numbers(x: str) -> str:
    found = f"regexp_extract_all({norm_text(x)}, {literal(T.NUMBER)}, 0)"
    bare = "rtrim('.', replace(m, '$', ''))"
    return f"array_distinct(transform({found}, m -> {let('n', bare, _trimmed('n'))}))"


def _trimmed(n: str) -> str:
    return f"CASE WHEN contains({n}, '.') THEN rtrim('.', rtrim('0', {n})) ELSE {n} END"


def is_number(x: str) -> str:
    return f"({x} RLIKE {literal('^(?:' + T.NUMBER + ')$')})"


def _stop(t: str) -> str:
    return f"{t} IN ({', '.join(map(literal, T.STOP_WORDS))})"


def bm25_tokens(x: str) -> str:
    return f"array_remove(split(btrim(lower(regexp_replace({_text(x)}, '[^A-Za-z0-9]+', ' '))), ' '), '')"


def bm25_query_tokens(x: str) -> str:
    return f"filter({bm25_tokens(x)}, t -> NOT {_stop('t')})"


def content_tokens(x: str) -> str:
    return f"array_distinct(filter({tokens(x)}, t -> NOT {_stop('t')} AND (length(t) >= 4 OR {is_number('t')})))"


def match_keys(x: str) -> str:
    return f"transform({content_tokens(x)}, k -> ltrim('$', k))"


def vocabulary(x: str) -> str:
    return f"array_distinct(transform({tokens(x)}, k -> ltrim('$', k)))"


def is_not_found(x: str) -> str:
    return f"contains({norm_text(x)}, {literal(T.NOT_FOUND_KEY)})"


def is_abstain(x: str) -> str:
    return f"contains({normalize(x)}, {literal(T.NOT_FOUND_KEY)})"


def normalize_question(x: str) -> str:
    return f"rtrim(' ?.!', {clean(x)})"


def alnum(x: str) -> str:
    return f"regexp_replace(lower({compat(x)}), '[^0-9a-z]', '')"


def raw_words(x: str) -> str:
    return f"filter(transform(split({_spaced(compat(x))}, ' '), w -> btrim(w, {literal(T.WORD_PUNCT)})), w -> w <> '')"


def split_claims(x: str) -> str:
    parts = f"split({_text(x)}, {literal(r'(?<=[.!?])(?U:\s+)|\n+')})"
    head = literal("^(?U:\\s*)(?:[-*\u2022]|\\d+[.)])(?U:\\s*)")
    return f"filter(transform({parts}, p -> btrim(regexp_replace(p, {head}, ''), ' \\n\\t\\r')), c -> c <> '')"


def is_short(x: str) -> str:
    a = _text(x)
    return f"({a} <> '' AND NOT {is_not_found(x)} AND length({a}) <= {T.SHORT_LIMIT} AND length({a}) - length(replace({a}, '\\n', '')) <= 1)"


def numeric_strings(x: str) -> str:
    return f"regexp_extract_all({_text(x)}, {literal(r'\d+(?:[.,]\d+)*')}, 0)"


def safe_name(x: str) -> str:
    base = f"element_at(split(coalesce(nullif({x}, ''), 'upload'), '/'), -1)"
    return f"coalesce(nullif(regexp_replace({base}, '[^A-Za-z0-9._ -]', '_'), ''), 'upload')"


def _golds(g: str) -> str:
    return f"coalesce({g}, CAST(array() AS {STRINGS}))"


def anls(p: str, g: str) -> str:
    distance = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 0D ELSE levenshtein(a, b) / greatest(length(a), length(b)) END"
    each = let("d", distance, "CASE WHEN d < 0.5D THEN 1D - d ELSE 0D END")
    return f"coalesce({let('a', clean(p), f'array_max(transform({_golds(g)}, x -> {let("b", clean("x"), each)}))')}, 0D)"


def exact_match(p: str, g: str) -> str:
    return f"CAST(array_contains(transform({_golds(g)}, x -> {normalize('x')}), {normalize(p)}) AS DOUBLE)"


def contains_match(p: str, g: str) -> str:
    inside = f"exists(transform({_golds(g)}, x -> {normalize('x')}), b -> b <> '' AND contains(a, b))"
    return f"CAST({let('a', normalize(p), inside)} AS DOUBLE)"


def score_item(p: str, g: str) -> str:
    scores = "named_struct('em', {}, 'anls', {}, 'contains', {}, 'abstain', {}, 'error', {})".format
    zero, one = "0D", "1D"
    return (f"CASE WHEN {p} IS NULL THEN {scores(zero, zero, zero, zero, one)} WHEN {is_abstain(p)} THEN {scores(zero, zero, zero, one, zero)} "
            f"ELSE {scores(exact_match(p, g), anls(p, g), contains_match(p, g), zero, zero)} END")


def answer_in_text(g: str, t: str) -> str:
    flat = lambda x: f"regexp_replace({x}, {literal('(?U)[' + chr(92) + 's|]+')}, ' ')"
    wanted = f"transform({_golds(g)}, x -> {flat(normalize('x'))})"
    return let("a", flat(f"lower({_text(t)})"), f"exists({wanted}, b -> b <> '' AND contains(a, b))")


_ONE = (("s", "STRING"),)
#: name -> (parameters, type, body)
FUNCTIONS: dict[str, tuple[tuple[tuple[str, str], ...], str, Callable[..., str]]] = {
    **{f.__name__: (_ONE, "STRING", f) for f in (clean, normalize, compat, norm_text, normalize_question, alnum, safe_name)},
    **{f.__name__: (_ONE, STRINGS, f) for f in (tokens, numbers, bm25_tokens, bm25_query_tokens, content_tokens, match_keys, vocabulary, raw_words,
                                                split_claims, numeric_strings)},
    **{f.__name__: (_ONE, "BOOLEAN", f) for f in (is_number, is_not_found, is_abstain, is_short)},
    **{f.__name__: ((("pred", "STRING"), ("golds", STRINGS)), kind, f) for f, kind in (
        (anls, "DOUBLE"), (exact_match, "DOUBLE"), (contains_match, "DOUBLE"), (score_item, SCORES))},
    "answer_in_text": ((("golds", STRINGS), ("page", "STRING")), "BOOLEAN", answer_in_text),
}


def statements(prefix: str = "lectern_") -> list[str]:
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(map(' '.join, params))}) RETURNS {kind} RETURN {body(*[p for p, _ in params])}"
            for name, (params, kind, body) in FUNCTIONS.items()]


def register(spark: SparkSession, prefix: str = "lectern_") -> list[str]:
    """Creates the functions in the session; returns their names."""
    for s in statements(prefix):
        spark.sql(s)
    return [prefix + name for name in FUNCTIONS]
