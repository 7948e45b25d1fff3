"""Two answers to the same question, compared claim by claim."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .staging import staged


def _comparable(asks: DataFrame, a: str, b: str) -> DataFrame:
    return asks.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def _claim_stats(asks: DataFrame, key: str, side: str) -> DataFrame:
    """One row per claim with its token statistics; the claim's own text stays behind."""
    c = asks.select(key, F.posexplode(T.split_claims(F.col(side))).alias("ord", "claim"))
    c = c.select(key, "ord", T.norm_text(F.col("claim")).alias("norm"))
    c = c.select(key, "ord", "norm", T.tokens_of_norm(F.col("norm")).alias("toks"),
                 F.array_join(F.array_sort(T.numbers_of_norm(F.col("norm"))), " ").alias("nums"))
    return c.select(
        key, "ord", "norm", "toks", "nums", F.size("toks").alias("n"), F.size(F.array_distinct("toks")).alias("d"),
        F.size(F.filter("toks", lambda t: ~T.is_number(t))).alias("w"))


def _token_rows(stats: DataFrame, key: str, p: str) -> DataFrame:
    rows = stats.select(key, F.col("ord").alias(f"{p}_ord"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "d", "w", "nums")],
                        F.explode("toks").alias("tok"))
    return rows.groupBy(key, f"{p}_ord", f"{p}_n", f"{p}_d", f"{p}_w", f"{p}_nums", "tok").agg(F.count("*").alias(f"{p}_cnt"))


def _sharing_pairs(sa: DataFrame, sb: DataFrame, key: str) -> DataFrame:
    """Claim pairs that share a token, with label and score. Overlap counts come from the join itself, so claims that
    share nothing are never paired."""
    m = _token_rows(sa, key, "a").join(_token_rows(sb, key, "b"), [key, "tok"])
    both = F.least("a_cnt", "b_cnt")
    g = m.groupBy(key, "a_ord", "b_ord", "a_n", "a_d", "a_w", "a_nums", "b_n", "b_d", "b_w", "b_nums").agg(
        F.sum(both).alias("common"), F.count("*").alias("common_d"),
        F.sum(F.when(T.is_number(F.col("tok")), 0).otherwise(both)).alias("common_w"))
    g = g.select(
        key, "a_ord", "b_ord", S.f1_from_counts(F.col("common"), F.col("a_n"), F.col("b_n")).alias("f1"),
        S.f1_from_counts(F.col("common_w"), F.col("a_w"), F.col("b_w")).alias("ctx"),
        ((F.col("a_w") == 0) & (F.col("b_w") == 0)).alias("wordless"),
        ((F.col("common_d") == F.col("a_d")) | (F.col("common_d") == F.col("b_d"))).alias("contained"),
        (F.col("a_nums") != F.col("b_nums")).alias("differ"))
    label = S.claim_label(F.col("f1"), F.col("ctx"), F.col("wordless"), F.col("contained"), F.lit(False), F.col("differ"))
    g = g.withColumn("label", label)
    return g.select(key, "a_ord", "b_ord", "label", S.claim_score(F.col("label"), F.col("f1"), F.col("contained")).alias("score"))


def _wordless_pairs(sa: DataFrame, sb: DataFrame, key: str) -> DataFrame:
    """Claims made of numbers only conflict with any other such claim even when they share no token. Of all of those only
    the first right claim can be chosen, so the two earliest distinct number sets of a question are enough; claims
    without any token match the same text."""
    first = (sb.where("w = 0").groupBy(key, "nums").agg(F.min("ord").alias("ord"))
             .groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "nums"))), 1, 2).alias("firsts")))
    a = sa.where("w = 0").select(key, F.col("ord").alias("a_ord"), "nums", "norm", "n")
    conflict = a.join(first, key).select(
        key, "a_ord", F.get(F.filter("firsts", lambda f: f["nums"] != F.col("nums")), F.lit(0))["ord"].alias("b_ord"),
        F.lit("conflict").alias("label"), F.lit(0.0).alias("score")).where("b_ord IS NOT NULL")
    same = (a.where("n = 0").join(sb.where("n = 0").groupBy(key, "norm").agg(F.min("ord").alias("b_ord")), [key, "norm"])
            .select(key, "a_ord", "b_ord", F.lit("agree").alias("label"), F.lit(0.0).alias("score")))
    return conflict.unionByName(same)


def best_matches(asks: DataFrame, key: str = "qid", a: str = "vlm", b: str = "ocr") -> DataFrame:
    """For every left claim that matches anything, its best right claim: better label, then score, then first.
    Several left claims may take the same right one."""
    asks = _comparable(asks, a, b).where(~T.is_not_found(F.col(a)) & ~T.is_not_found(F.col(b)))
    sa, sb = _claim_stats(asks, key, a), _claim_stats(asks, key, b)
    cand = _sharing_pairs(sa, sb, key).unionByName(_wordless_pairs(sa, sb, key))
    rank = (F.when(F.col("label") == "agree", 3).when(F.col("label") == "partial", 2).when(F.col("label") == "conflict", 1))
    return cand.where("label <> 'none'").groupBy(key, "a_ord").agg(
        F.max_by(F.struct("b_ord", "label", "score"), F.struct(rank, F.col("score"), -F.col("b_ord"))).alias("m")
    ).select(key, "a_ord", "m.b_ord", "m.label", "m.score")


def claim_pairs(asks: DataFrame, key: str = "qid", a: str = "vlm", b: str = "ocr") -> DataFrame:
    """The claim ledger: (key, ord, vlm, ocr, label, score). Unmatched claims of either side get their own row; when just
    one side found an answer the whole answers conflict."""
    picks = best_matches(asks, key, a, b).groupBy(key).agg(
        F.collect_list(F.struct("a_ord", "b_ord", "label", "score")).alias("picks"))
    both = _comparable(asks, a, b).select(
        key, F.col(a).alias("_a"), F.col(b).alias("_b"), T.is_not_found(F.col(a)).alias("_na"), T.is_not_found(F.col(b)).alias("_nb"))
    j = (both.where(~F.col("_na") & ~F.col("_nb"))
         .select(key, T.split_claims(F.col("_a")).alias("ca"), T.split_claims(F.col("_b")).alias("cb")).join(picks, key, "left"))
    j = j.withColumn("picks", F.coalesce("picks", F.array().cast("array<struct<a_ord:int,b_ord:int,label:string,score:double>>")))
    j = j.withColumn("by_a", F.map_from_entries(F.transform("picks", lambda p: F.struct(p["a_ord"], p)))).withColumn(
        "used", F.transform("picks", lambda p: p["b_ord"]))
    left = j.select(key, F.posexplode("ca").alias("ord", "vlm"), "cb", "by_a").withColumn("m", F.try_element_at("by_a", F.col("ord")))
    left = left.select(key, "ord", "vlm", F.when(F.col("m").isNotNull(), F.get("cb", F.col("m.b_ord"))).alias("ocr"),
                       F.coalesce("m.label", F.lit("only_vlm")).alias("label"), F.coalesce("m.score", F.lit(0.0)).alias("score"))
    right = j.select(key, F.size("ca").alias("_n"), F.posexplode("cb").alias("ord", "ocr"), "used").where(
        ~F.array_contains("used", F.col("ord")))
    right = right.select(key, (F.col("_n") + F.col("ord")).alias("ord"), F.lit(None).cast("string").alias("vlm"), "ocr",
                         F.lit("only_ocr").alias("label"), F.lit(0.0).alias("score"))
    one_sided = both.where(F.col("_na") != F.col("_nb")).select(
        key, F.lit(0).alias("ord"), F.col("_a").alias("vlm"), F.col("_b").alias("ocr"), F.lit("conflict").alias("label"),
        F.lit(0.0).alias("score"))
    return left.unionByName(right).unionByName(one_sided)


def verdicts(asks: DataFrame, key: str = "qid", a: str = "vlm", b: str = "ocr") -> DataFrame:
    """Verdict and agreement per question: consistent, partial, conflict or disagree; NULL-sided questions have none. Also
    the number of claims only one side makes. Only label counts are needed, so claim texts never leave the scan."""
    asks = staged(_comparable(asks, a, b).select(key, a, b), "answers")  # read several times below, and what makes them may cost much
    both = asks.select(
        key, T.is_not_found(F.col(a)).alias("_na"), T.is_not_found(F.col(b)).alias("_nb"),
        F.size(T.split_claims(F.col(a))).alias("_ca"), F.size(T.split_claims(F.col(b))).alias("_cb"))
    picks = best_matches(asks, key, a, b).groupBy(key).agg(
        F.count_if(F.col("label") == "agree").alias("agree"), F.count_if(F.col("label") == "partial").alias("partial"),
        F.count_if(F.col("label") == "conflict").alias("conflict"), F.count_distinct("b_ord").alias("taken"), F.count("*").alias("matched"))
    j = both.join(picks, key, "left").na.fill(0, ["agree", "partial", "conflict", "taken", "matched"])
    pairs = F.col("_ca") + F.col("_cb") - F.col("taken")
    agreement = F.when(pairs == 0, 0.0).otherwise((F.col("agree") + 0.5 * F.col("partial")) / pairs)
    j = j.withColumn("_agreement", agreement).withColumn("_pairs", pairs)
    both_nf, one_nf = F.col("_na") & F.col("_nb"), F.col("_na") != F.col("_nb")
    verdict = (F.when(both_nf, "consistent").when(one_nf, "conflict")
               .when((F.col("_pairs") > 0) & (F.col("agree") == F.col("_pairs")), "consistent")
               .when(F.col("conflict") > 0, "conflict").when(F.col("_agreement") >= 0.5, "partial").otherwise("disagree"))
    return j.select(key, verdict.alias("verdict"),
                    F.when(both_nf, 1.0).when(one_nf, 0.0).otherwise(F.bround("_agreement", 3)).alias("agreement"),
                    F.when(both_nf, 0).when(one_nf, 1).otherwise(F.col("_pairs")).cast("long").alias("pairs"),
                    F.when(both_nf | one_nf, 0).otherwise(F.col("_ca") - F.col("matched")).cast("long").alias("n_only_vlm"),
                    F.when(both_nf | one_nf, 0).otherwise(F.col("_cb") - F.col("taken")).cast("long").alias("n_only_ocr"))


def numbers_only(asks: DataFrame, key: str = "qid", a: str = "vlm", b: str = "ocr") -> DataFrame:
    """Numbers that stand in one answer and not in the other, sorted."""
    n = _comparable(asks, a, b).select(key, T.numbers(F.col(a)).alias("x"), T.numbers(F.col(b)).alias("y"))
    return n.select(key, F.array_sort(F.array_except("x", "y")).alias("numbers_only_vlm"),
                    F.array_sort(F.array_except("y", "x")).alias("numbers_only_ocr"))


def agreement_flags(items: DataFrame, keys: list[str], a: str = "vlm_pred", b: str = "ocr_pred") -> DataFrame:
    """Adds ``agree``: verdict is consistent; NULL unless both sides answered."""
    one = F.struct(*keys)
    v = verdicts(items.select(one.alias("_k"), F.col(a).alias("vlm"), F.col(b).alias("ocr")), "_k")
    return items.join(v.select(F.col("_k.*"), (F.col("verdict") == "consistent").alias("agree")), keys, "left")


def ledger(asks: DataFrame, key: str = "qid", a: str = "vlm", b: str = "ocr") -> DataFrame:
    """Per question: what both say, what only one says, and where they contradict, in claim order. Questions where one
    or both sides are silent or found nothing have a fixed form."""
    silent = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    asks = asks.select(key, F.col(a).alias("vlm"), F.col(b).alias("ocr"))
    said = asks.where(~silent(F.col("vlm")) & ~silent(F.col("ocr")))
    pairs = claim_pairs(said.where(~T.is_not_found(F.col("vlm")) & ~T.is_not_found(F.col("ocr"))), key)

    def texts(label: str, col):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("ord", col.alias("t"))))),
                           lambda x: x["t"])

    told = F.concat(F.lit("Vision reported '"), F.col("vlm"), F.lit("' while OCR reported '"), F.col("ocr"), F.lit("'"))
    g = pairs.groupBy(key).agg(texts("agree", F.col("vlm")).alias("consensus"), texts("only_vlm", F.col("vlm")).alias("vlm_unique"),
                               texts("only_ocr", F.col("ocr")).alias("ocr_unique"), texts("conflict", told).alias("discrepancies"))
    none = F.array().cast("array<string>")
    v, o = F.btrim("vlm"), F.btrim("ocr")
    sv, so = silent(F.col("vlm")), silent(F.col("ocr"))
    nv, no = T.is_not_found(F.col("vlm")), T.is_not_found(F.col("ocr"))
    j = asks.join(g, key, "left")
    only_v, only_o = (so & ~sv) | (~sv & ~so & no & ~nv), (sv & ~so) | (~sv & ~so & nv & ~no)
    both_nf = ~sv & ~so & nv & no
    return j.select(
        key, F.when(sv & so, "nothing").when(both_nf, "not_found").when(only_v, "only_vlm").when(only_o, "only_ocr").otherwise("both").alias("case"),
        F.when(both_nf, F.array(F.lit(T.NOT_FOUND))).otherwise(F.coalesce("consensus", none)).alias("consensus"),
        F.when(only_v, F.array(v)).otherwise(F.coalesce("vlm_unique", none)).alias("vlm_unique"),
        F.when(only_o, F.array(o)).otherwise(F.coalesce("ocr_unique", none)).alias("ocr_unique"),
        F.coalesce("discrepancies", none).alias("discrepancies"))
