"""How alike two short strings are: LCS ratio, look-alike characters, edits."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, bind_all

# --- fixed values: characters that are read as one another, and the two-letter forms read as one letter -----------
CONFUSABLE = (
    ("I", "l"), ("l", "1"), ("I", "1"), ("i", "l"), ("O", "0"), ("o", "0"), ("D", "0"), ("Q", "O"), ("S", "5"),
    ("s", "5"), ("B", "8"), ("Z", "2"), ("z", "2"), ("G", "6"), ("g", "9"), ("q", "9"), ("rn", "m"), ("cl", "d"),
    ("vv", "w"), ("ii", "u"), (",", "."), ("e", "c"), ("h", "b"), ("n", "h"), ("u", "v"), ("t", "f"), ("i", "j"),
    ("A", "4"), ("T", "7"), ("E", "F"), ("C", "G"), ("U", "V"), ("a", "o"), ("ri", "n"), ("m", "nn"),
)
# -------------------------------------------------------------------------------------------------------------------


def _single_pairs() -> list[str]:
    """Both orders and both cases of every one-character pair, as two-character strings."""
    out = set()
    for a, b in CONFUSABLE:
        if len(a) == 1 and len(b) == 1:
            for x, y in ((a, b), (a.lower(), b.lower())):
                out |= {x + y, y + x}
    return sorted(p for p in out if p[0] != p[1])


SINGLE = _single_pairs()
DIGRAPHS = [(a, b) if len(a) == 2 else (b, a) for a, b in CONFUSABLE if len(a) + len(b) == 3]


def _classes() -> tuple[str, str]:
    """A representative per set of characters that are connected by look-alike pairs. Two words that differ only in
    look-alike characters become the same string, so candidates can be found by equality."""
    rep: dict[str, str] = {}

    def root(c: str) -> str:
        while rep.setdefault(c, c) != c:
            c = rep[c]
        return c

    for p in SINGLE:
        a, b = sorted((root(p[0]), root(p[1])))
        rep[b] = a
    chars = sorted(rep)
    return "".join(chars), "".join(root(c) for c in chars)


CLASS_FROM, CLASS_TO = _classes()


def fold_digraphs(s: Column) -> Column:
    for two, one in DIGRAPHS:
        s = F.replace(s, F.lit(two), F.lit(one))
    return s


DIGRAPH = "|".join(two for two, _ in DIGRAPHS)


def class_form(s: Column) -> Column:
    """Two words of one length for which ``is_lookalike`` holds have the same class form; others have it after folding digraphs."""
    return F.translate(s, CLASS_FROM, CLASS_TO)


def shapes(s: Column) -> Column:
    """Both forms of a word: two words for which ``is_lookalike`` holds share one of them."""
    return F.array(F.concat(F.lit("="), class_form(s)), F.concat(F.lit("~"), class_form(fold_digraphs(s))))


def char_pairs(a: Column, b: Column) -> Column:
    """Position-wise differing characters of two strings of the same length, as two-character strings."""
    return F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)),
                    lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))


def swaps(true: Column, read: Column) -> Column:
    """Edits turning one word into the other, as two-character strings. Words of unequal length are compared after
    folding the look-alike digraphs; when that does not make them equally long there is no swap reading (NULL)."""
    ft, fr = fold_digraphs(true), fold_digraphs(read)
    return (F.when(F.length(true) == F.length(read), char_pairs(true, read))
            .when(F.length(ft) == F.length(fr), char_pairs(ft, fr)))


def swap_count(true: Column, read: Column) -> Column:
    """Number of edits in ``swaps``: differing positions, plus the folded digraphs the two words do not share."""
    folded = F.abs(F.length(true) - F.length(read))
    return F.size(swaps(true, read)) + F.when(F.length(true) == F.length(read), F.lit(0)).otherwise(folded)


def is_confusable(pair: Column) -> Column:
    """Looks the two-character string up in one constant: a single node, where a list would be one per pair."""
    return F.contains(F.lit("|" + "|".join(SINGLE) + "|"), F.concat(F.lit("|"), pair, F.lit("|")))


def all_lookalike(pairs: Column) -> Column:
    return F.forall(pairs, is_confusable)


def is_lookalike(true: Column, read: Column) -> Column:
    """At least one edit, and every edit between characters of the same shape."""
    same_length = F.length(true) == F.length(read)
    return F.coalesce(bind(swaps(true, read), lambda p: ((F.size(p) > 0) | ~same_length) & all_lookalike(p)), F.lit(False))


BITS = 62  # characters that fit into one BIGINT with room for a carry


def _lcs_table(long: Column, short: Column) -> Column:
    """Longest common subsequence by the usual table, one row of it at a time; the shorter string spans the row."""
    zero = F.transform(F.sequence(F.lit(0), F.length(short)), lambda i: F.lit(0))

    def next_row(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.split(short, ""), F.array(F.lit(0)),
            lambda cur, y: F.concat(cur, F.array(
                F.when(x == y, F.get(prev, F.size(cur) - 1) + 1)
                .otherwise(F.greatest(F.get(prev, F.size(cur)), F.get(cur, F.size(cur) - 1))))))

    return F.aggregate(F.split(long, ""), zero, next_row, lambda row: F.element_at(row, -1))


def _lcs_bits(long: Column, short: Column) -> Column:
    """The same for a shorter string of at most ``BITS`` characters: one bit per character of it that is not matched yet, last
    character lowest, so the longer one is read backwards. A step adds the bits that can be matched to the vector; carries
    move a match on to the next free place."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(short)) - 1

    def count(letters: Column, own: Column) -> Column:
        masks = F.transform(own, lambda c: F.aggregate(letters, F.lit(0).cast("long"), lambda acc, y: acc * 2 + F.when(y == c, 1).otherwise(0)))

        def walk(masks: Column, full: Column) -> Column:
            def step(v: Column, x: Column) -> Column:
                return bind(F.coalesce(F.get(masks, F.array_position(own, x).cast("int") - 1), F.lit(0).cast("long")), lambda m: (
                    (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))).bitwiseAND(full))
            return F.length(short) - F.bit_count(F.aggregate(F.split(F.reverse(long), ""), full, step))

        return bind_all(walk, masks, full)

    return bind(F.split(short, ""), lambda letters: bind(F.array_distinct(letters), lambda own: count(letters, own)))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of characters."""
    long = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    short = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
            .when(F.least(F.length(a), F.length(b)) <= BITS, _lcs_bits(long, short)).otherwise(_lcs_table(long, short)))


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return (F.when(total == 0, F.lit(1.0)).when(a == b, F.lit(1.0))
            .otherwise(2.0 * lcs_length(a, b) / total))


def within_ratio(a: Column, b: Column, cutoff: float) -> Column:
    """Cheap necessary condition for ``ratio(a, b) >= cutoff`` (never rejects a pair that passes)."""
    return F.levenshtein(a, b) <= F.floor(F.lit(1.0 - cutoff + 1e-9) * (F.length(a) + F.length(b)))


def near_score(key: Column, word: Column, cutoff: float) -> Column:
    """Struct(kind, ratio) when ``word`` is a likely misreading of ``key``, else NULL. Kind 1: only look-alike characters
    differ, and not too many; kind 0: similar enough, and no digits are involved (another number is another value, not a
    misreading)."""
    usable = ((word != key) & (F.length(key) >= 3) & (F.abs(F.length(key) - F.length(word)) <= 2))
    digits = key.rlike("[0-9]") | word.rlike("[0-9]")
    most = F.greatest(F.lit(2), F.floor(F.length(key) / 2))

    def judge(alike: Column, few: Column, close: Column) -> Column:
        kind = F.when(alike & few, F.lit(1)).when(close & (~digits | alike), F.lit(0))
        return F.when(kind.isNotNull(), bind(ratio(key, word), lambda r: F.when(
            (kind == 1) | (r >= cutoff), F.struct(kind.alias("kind"), r.alias("ratio")))))

    folded = F.abs(F.length(key) - F.length(word))

    def looks(p: Column) -> Column:
        alike = F.coalesce(((F.size(p) > 0) | (folded > 0)) & all_lookalike(p), F.lit(False))
        return bind_all(judge, alike, F.size(p) + folded <= most, within_ratio(key, word, cutoff))

    return F.when(usable, bind(swaps(key, word), looks))


def near(key: Column, words: Column, cutoff: float = 0.75) -> Column:
    """Best likely misreading of ``key`` in a small array of words (a line, another answer), or NULL.
    Whole vocabularies go through ``support.near_words``, which scores only pairs that pass cheap tests."""
    def scored(w: Column) -> Column:
        return bind(near_score(key, w, cutoff), lambda s: F.when(
            s.isNotNull(), F.struct((-s["kind"]).alias("k"), (-s["ratio"]).alias("r"), w.alias("w"))))

    return F.array_min(F.filter(F.transform(words, scored), lambda x: x.isNotNull()))["w"]
