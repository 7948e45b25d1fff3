"""Per-item answer scores as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def rounded(x: Column, places: int) -> Column:
    """Rounded in doubles, as the SQL has it: a half is what the multiplication makes one, whatever the shortest decimal form of ``x`` says."""
    return F.round(x * 10.0 ** places) / 10.0 ** places


def _no_golds(golds: Column) -> Column:
    return F.coalesce(golds, F.array().cast("array<string>"))


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    def one(p: Column, g: Column) -> Column:
        def of(dist: Column) -> Column:
            return F.when(dist < threshold, 1.0 - dist).otherwise(F.lit(0.0))

        longest = F.greatest(F.length(p), F.length(g))
        return T.bind(F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(p, g) / longest), of)

    cleaned = F.transform(_no_golds(golds), T.clean)
    return F.coalesce(T.bind(T.clean(pred), lambda p: F.array_max(F.transform(cleaned, lambda g: one(p, g)))), F.lit(0.0))


def _normalized(golds: Column) -> Column:
    return F.transform(_no_golds(golds), T.normalize)


def exact_match(pred: Column, golds: Column) -> Column:
    return F.array_contains(_normalized(golds), T.normalize(pred)).cast("double")


def contains_match(pred: Column, golds: Column) -> Column:
    return T.bind(T.normalize(pred), lambda p: F.exists(
        _normalized(golds), lambda g: (g != "") & F.contains(p, g))).cast("double")


def score_item(pred: Column, golds: Column) -> Column:
    """Struct of em, anls, contains, abstain, error. A missing answer is an error; an abstention scores nothing else."""
    zero = F.lit(0.0)

    def scores(em, an, co, ab, er):
        return F.struct(em.alias("em"), an.alias("anls"), co.alias("contains"), ab.alias("abstain"), er.alias("error"))

    one = F.lit(1.0)
    return (F.when(pred.isNull(), scores(zero, zero, zero, zero, one))
            .when(T.is_abstain(pred), scores(zero, zero, zero, one, zero))
            .otherwise(scores(exact_match(pred, golds), anls(pred, golds), contains_match(pred, golds), zero, zero)))


def answer_in_text(golds: Column, text: Column) -> Column:
    """Is any gold answer somewhere in the text, ignoring case, whitespace and table bars?"""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s|]+", " ")
    wanted = F.transform(_normalized(golds), lambda g: F.regexp_replace(g, r"(?U)[\s|]+", " "))
    return T.bind(flat, lambda t: F.exists(wanted, lambda g: (g != "") & F.contains(t, g)))


def is_right(scores: Column) -> Column:
    return F.coalesce(scores["contains"] == 1.0, F.lit(False))


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short token arrays."""
    return F.aggregate(
        F.array_intersect(a, b), F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def token_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of two token arrays, for short arrays (claims). Longer texts: ``support.page_similarity``."""
    return f1_from_counts(multiset_common(a, b), F.size(a), F.size(b))


def f1_from_counts(common: Column, n_a: Column, n_b: Column) -> Column:
    """F1 of precision common/n_a and recall common/n_b, 0 when nothing is shared."""
    p, r = common / n_a, common / n_b
    return F.when((common == 0) | (n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def claim_label(f1, ctx, wordless, contained, same_text, nums_differ) -> Column:
    """Label of a pair of claims. ``ctx`` is the F1 over words alone, ``wordless`` that neither side has words."""
    return (F.when(nums_differ & ((ctx >= 0.3) | wordless), "conflict")
            .when(same_text | contained | (f1 >= 0.8), "agree").when(f1 >= 0.4, "partial").otherwise("none"))


def claim_score(label, f1, contained) -> Column:
    return F.bround(F.when((label == "agree") & contained, F.greatest(f1, F.lit(0.8))).otherwise(f1), 3)


def compare_claims(a: Column, b: Column) -> Column:
    """Struct(label, score) of two claims given as text: agree, partial, conflict or none."""
    def parts(norm: Column) -> Column:
        return T.bind(T.tokens_of_norm(norm), lambda t: F.struct(
            norm.alias("norm"), t.alias("toks"), F.filter(t, lambda x: ~T.is_number(x)).alias("words"),
            F.array_sort(T.numbers_of_norm(norm)).alias("nums")))

    def measures(x: Column, y: Column) -> Column:
        tx, ty = x["toks"], y["toks"]
        return F.struct(
            f1_from_counts(multiset_common(tx, ty), F.size(tx), F.size(ty)).alias("f1"),
            f1_from_counts(multiset_common(x["words"], y["words"]), F.size(x["words"]), F.size(y["words"])).alias("ctx"),
            ((F.size(x["words"]) == 0) & (F.size(y["words"]) == 0)).alias("wordless"),
            ((F.size(tx) > 0) & (F.size(ty) > 0) & (
                (F.size(F.array_except(tx, ty)) == 0) | (F.size(F.array_except(ty, tx)) == 0))).alias("contained"),
            (x["norm"] == y["norm"]).alias("same"), (x["nums"] != y["nums"]).alias("differ"))

    def verdict(m: Column) -> Column:
        return T.bind(claim_label(m["f1"], m["ctx"], m["wordless"], m["contained"], m["same"], m["differ"]),
                      lambda lab: F.struct(lab.alias("label"), claim_score(lab, m["f1"], m["contained"]).alias("score")))

    return T.bind(T.bind_all(lambda x, y: measures(x, y), T.bind(T.norm_text(a), parts), T.bind(T.norm_text(b), parts)),
                  verdict)


def recommended_correct(recommended: Column, vlm_pred: Column, ocr_pred: Column, golds: Column) -> Column:
    pred = F.when(recommended == "vlm", vlm_pred).when(recommended == "ocr", ocr_pred)
    return F.when(pred.isNotNull(), ~T.is_abstain(pred) & (
        (contains_match(pred, golds) == 1.0) | (anls(pred, golds) >= 0.5)))


def config_fingerprint(**fields: Column) -> Column:
    """One comparable value for everything that changes an answer; field order does not matter."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]),
                            {"ignoreNullFields": "false"}), 256)
