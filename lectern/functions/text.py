"""Text normalisation as column expressions.

Everything here is a native Spark expression: nothing leaves the JVM, and a scan that only needs one of these
still prunes to the columns it reads. ``Column`` in, ``Column`` out.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
# These must equal the values the results are compared with, so they are listed as they are.
NOT_FOUND = "Not found in document."

STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "is", "are", "was", "were", "be", "what", "which",
    "who", "whom", "whose", "when", "where", "how", "does", "do", "did", "and", "or", "by", "with", "this",
    "that", "it", "its", "as", "from", "there", "their", "has", "have", "had", "please", "tell", "me",
)

NUMBER = r"\$?\d[\d,]*(?:\.\d+)?%?"
NOT_FOUND_KEY = "not found in document"
OUTER_PUNCT = " .,:;!?\"'"
WORD_PUNCT = ".,;:!?\"'()[]{}“”‘’"
SHORT_LIMIT = 200
CURLY, STRAIGHT = "’“”", "'\"\""
# ----------------------------------------------------------------------------------------------------------------


def _compat_pairs() -> tuple[str, str]:
    """Single characters whose compatibility form is another single character, built by rule:
    full-width forms sit 0xFEE0 above ASCII, super- and subscript digits in runs, and the wide spaces."""
    src = [chr(c) for c in range(0xFF01, 0xFF5F)]
    dst = [chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)]
    for digits in ("\u2070\u00b9\u00b2\u00b3" + "".join(chr(0x2070 + i) for i in range(4, 10)),
                   "".join(chr(0x2080 + i) for i in range(10))):
        src += list(digits)
        dst += list("0123456789")
    spaces = "\u00a0\u3000\u202f\u205f" + "".join(chr(c) for c in range(0x2000, 0x200B))
    src += list(spaces)
    dst += [" "] * len(spaces)
    return "".join(src), "".join(dst)


_COMPAT = _compat_pairs()
_LIGATURES = (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2026", "..."))


def _text(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind_all(use, *values: Column) -> Column:
    """``bind`` for several values."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return bind(packed, lambda p: use(*[p[f"v{i}"] for i in range(len(values))]))


def _plain(s: Column) -> Column:
    """No character that ``compat`` or the straightening of quotes could change: all of those are in these two ranges."""
    return ~s.rlike("[\u00a0\u00b2\u00b3\u00b9\u2000-\uffff]")


def compat(s: Column) -> Column:
    """The compatibility folding that matters for documents (full-width forms, super/subscript digits, wide spaces,
    ligatures, ellipsis). Spark has no Unicode normalisation function; other compatibility characters stay as they are."""
    out = F.translate(_text(s), *_COMPAT)
    for lig, plain in _LIGATURES:
        out = F.replace(out, F.lit(lig), F.lit(plain))
    return out


def clean(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_text(s)), r"(?U)\s+", " "))


def normalize(s: Column) -> Column:
    return F.btrim(clean(s), F.lit(OUTER_PUNCT))


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def _runs(s: Column, pattern: str, between: str) -> Column:
    return F.array_join(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), between)


def _folded(s: Column) -> Column:
    t = _text(s)
    return F.when(_ascii(t) | _plain(t), F.lower(t)).otherwise(F.translate(F.lower(compat(s)), CURLY, STRAIGHT))


def may_hold(text: Column, words: Column) -> Column:
    """True wherever ``vocab(text)`` has all of ``words``, and seldom elsewhere; far cheaper than cutting the text into tokens."""
    return bind(F.replace(_folded(text), F.lit(","), F.lit("")), lambda t: F.forall(words, lambda w: F.contains(t, w)))


def _parts(s: Column) -> Column:
    """Runs of the characters of tokens. They are looked for themselves: an expression for what lies between them is slower. Folding is
    left out where there are only ASCII characters."""
    joined = F.regexp_replace(_folded(s), r",(?<=\d,)(?=\d{3})", "")
    return F.regexp_extract_all(joined, F.lit(r"(?U)[a-z0-9_.%$/\w-]+"), F.lit(0))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda t: F.btrim(t, F.lit(".-/"))), lambda t: t != "")


def norm_text(s: Column) -> Column:
    return F.array_join(_parts(s), " ")


def tokens_of_norm(norm: Column) -> Column:
    """Tokens of a text that already went through ``norm_text``."""
    return _trimmed(F.split(norm, " "))


def tokens(s: Column) -> Column:
    return _trimmed(_parts(s))


def _strip_zeros(n: Column) -> Column:
    return F.when(F.contains(n, F.lit(".")),
                  F.rtrim(F.rtrim(n, F.lit("0")), F.lit("."))).otherwise(n)


def numbers_of_norm(norm: Column) -> Column:
    found = F.regexp_extract_all(norm, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(
        found, lambda m: _strip_zeros(F.rtrim(F.replace(m, F.lit("$"), F.lit("")), F.lit(".")))))


def numbers(s: Column) -> Column:
    """Distinct canonical numbers: no currency sign, no thousands commas, no trailing zeros; a percent sign is kept."""
    return numbers_of_norm(norm_text(s))


def is_number(token: Column) -> Column:
    return token.rlike("^(?:" + NUMBER + ")$")


def bm25_tokens(s: Column, drop_stop: bool = False) -> Column:
    toks = F.array_remove(F.split(F.lower(_runs(_text(s), "[A-Za-z0-9]+", " ")), " "), "")
    return F.filter(toks, lambda t: ~t.isin(*STOP_WORDS)) if drop_stop else toks


def content_of_tokens(toks: Column) -> Column:
    return F.array_distinct(F.filter(
        toks, lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) >= 4) | is_number(t))))


def content_tokens(s: Column) -> Column:
    """The distinct words and numbers that carry an answer, in order of first use."""
    return content_of_tokens(tokens(s))


def unprefixed(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.ltrim(t, F.lit("$")))


def keys(s: Column) -> Column:
    """Content tokens without the currency sign: the form in which answers are matched with pages."""
    return unprefixed(content_tokens(s))


def vocab(s: Column) -> Column:
    """Distinct tokens of a text in matching form."""
    return F.array_distinct(unprefixed(tokens(s)))


def is_not_found(s: Column) -> Column:
    return F.contains(norm_text(s), F.lit(NOT_FOUND_KEY))


def is_abstain(s: Column) -> Column:
    return F.contains(normalize(s), F.lit(NOT_FOUND_KEY))


def normalize_question(q: Column) -> Column:
    return F.rtrim(clean(q), F.lit(" ?.!"))


def alnum(s: Column) -> Column:
    return _runs(F.lower(F.when(_ascii(_text(s)) | _plain(_text(s)), _text(s)).otherwise(compat(s))), "[0-9a-z]+", "")


def outer_norm(s: Column) -> Column:
    """Like ``normalize`` but with compatibility folding: the form in which whole answers are aligned."""
    return F.btrim(F.regexp_replace(F.lower(compat(s)), r"(?U)\s+", " "), F.lit(OUTER_PUNCT))


def raw_words(s: Column) -> Column:
    words = F.split(F.btrim(F.regexp_replace(compat(s), r"(?U)\s+", " ")), " ")
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(WORD_PUNCT))), lambda w: w != "")


def as_written(key: Column, source: Column) -> Column:
    """A matching key the way ``source`` writes it; the key itself when the source does not have it."""
    hit = F.filter(raw_words(source), lambda w: F.coalesce(
        F.ltrim(F.get(tokens(w), F.lit(0)), F.lit("$")) == key, F.lit(False)))
    return F.coalesce(F.ltrim(F.get(hit, F.lit(0)), F.lit("$")), key)


def split_claims(answer: Column) -> Column:
    parts = F.split(_text(answer), r"(?<=[.!?])(?U:\s+)|\n+")
    bare = F.transform(parts, lambda p: F.btrim(
        F.regexp_replace(p, "^(?U:\\s*)(?:[-*\u2022]|\\d+[.)])(?U:\\s*)", ""), F.lit(" \n\t\r")))
    return F.filter(bare, lambda c: c != "")


def is_short(answer: Column) -> Column:
    a = _text(answer)
    return ((a != "") & ~is_not_found(a) & (F.length(a) <= SHORT_LIMIT)
            & (F.length(a) - F.length(F.replace(a, F.lit("\n"), F.lit(""))) <= 1))


def numeric_strings(s: Column) -> Column:
    return F.regexp_extract_all(_text(s), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))


def answer_keywords(answer: Column) -> Column:
    """Words of an answer that are looked for in lines of text: letters and digits only, longer than two characters."""
    words = F.split(F.lower(F.regexp_replace(_text(answer), r"(?U)\s+", " ")), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_]", "")), lambda w: F.length(w) > 2)


def safe_name(name: Column) -> Column:
    base = F.element_at(F.split(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload")), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(base, "[^A-Za-z0-9._ -]", "_"), F.lit("")), F.lit("upload"))
