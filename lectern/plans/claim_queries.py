"""Claim ledger, verdicts and the comparisons below them."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import claims as C
from . import fixtures as X
from . import sqlparts as Q
from .registry import query


def _count(lst: str, t: str) -> str:
    return f"len(list_filter({lst}, lambda x_: x_ = {t}))"


def _common(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t_: least({_count(a, 't_')}, {_count(b, 't_')}))), 0)"


def _f1(common: str, na: str, nb: str) -> str:
    p, r = f"({common}::DOUBLE / {na})", f"({common}::DOUBLE / {nb})"
    return f"CASE WHEN {common} = 0 OR {na} = 0 OR {nb} = 0 THEN 0.0e0 ELSE 2.0e0 * {p} * {r} / ({p} + {r}) END"


def claims_sql(asks: str) -> str:
    """CTEs from a table asks(qid, vlm, ocr): every claim pair of a question is compared, then the best is taken."""
    def split(side, out):
        parts = f"regexp_split_to_array(regexp_replace({side}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+')"
        return f"""{out}_parts AS (SELECT qid, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS o FROM found_),
{out}_bare AS (SELECT qid, o, trim(regexp_replace(part, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), ' ' || chr(10) || chr(9) || chr(13)) AS claim FROM {out}_parts),
{out}_ AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS ord, claim, {Q.norm_text('claim')} AS norm FROM {out}_bare WHERE claim <> ''),
{out} AS (SELECT *, {Q.toks_of('norm')} AS t, list_filter({Q.toks_of('norm')}, lambda t_: NOT {Q.is_num('t_')}) AS w, {Q.nums_of('norm')} AS n FROM {out}_)"""
    return f"""base_ AS (SELECT qid, vlm, ocr, {Q.not_found('vlm')} AS nv, {Q.not_found('ocr')} AS no FROM {asks} WHERE vlm IS NOT NULL AND ocr IS NOT NULL),
found_ AS (SELECT * FROM base_ WHERE NOT nv AND NOT no),
{split('vlm', 'ca')},
{split('ocr', 'cb')},
cross_ AS (SELECT ca.qid, ca.ord AS a_ord, cb.ord AS b_ord, ca.claim AS ac, cb.claim AS bc, ca.n AS an, cb.n AS bn, ca.norm AS anorm, cb.norm AS bnorm,
  len(ca.t) AS lt_a, len(cb.t) AS lt_b, len(ca.w) AS lw_a, len(cb.w) AS lw_b, {_common('ca.t', 'cb.t')} AS common, {_common('ca.w', 'cb.w')} AS common_w,
  len(ca.t) > 0 AND len(cb.t) > 0 AND (list_has_all(cb.t, ca.t) OR list_has_all(ca.t, cb.t)) AS contained
  FROM ca JOIN cb ON ca.qid = cb.qid),
scored_ AS (SELECT *, {_f1('common', 'lt_a', 'lt_b')} AS f1, {_f1('common_w', 'lw_a', 'lw_b')} AS ctx FROM cross_),
labelled_ AS (SELECT *, CASE WHEN an <> bn AND (ctx >= 0.3e0 OR (lw_a = 0 AND lw_b = 0)) THEN 'conflict'
  WHEN anorm = bnorm OR contained OR f1 >= 0.8e0 THEN 'agree' WHEN f1 >= 0.4e0 THEN 'partial' ELSE 'none' END AS label FROM scored_),
ranked_ AS (SELECT *, CASE label WHEN 'agree' THEN 3 WHEN 'partial' THEN 2 WHEN 'conflict' THEN 1 ELSE 0 END AS rk,
  round_even(CASE WHEN label = 'agree' AND contained THEN greatest(f1, 0.8e0) ELSE f1 END, 3) AS score FROM labelled_),
best_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, a_ord ORDER BY rk DESC, score DESC, b_ord) AS rn FROM ranked_) WHERE rn = 1 AND label <> 'none'),
pairs_ AS (
  SELECT ca.qid, ca.ord, ca.claim AS vlm, best_.bc AS ocr, coalesce(best_.label, 'only_vlm') AS label, coalesce(best_.score, 0.0e0) AS score, best_.b_ord
    FROM ca LEFT JOIN best_ ON ca.qid = best_.qid AND ca.ord = best_.a_ord
  UNION ALL SELECT cb.qid, (SELECT count(*) FROM ca WHERE ca.qid = cb.qid) + cb.ord, NULL, cb.claim, 'only_ocr', 0.0e0, NULL FROM cb
    WHERE NOT EXISTS (SELECT 1 FROM best_ WHERE best_.qid = cb.qid AND best_.b_ord = cb.ord)
  UNION ALL SELECT qid, 0, vlm, ocr, 'conflict', 0.0e0, NULL FROM base_ WHERE nv <> no),
counts_ AS (SELECT qid, count(*) FILTER (label = 'agree') AS ag, count(*) FILTER (label = 'partial') AS pa,
  count(*) FILTER (label = 'conflict') AS co, count(*) AS n FROM pairs_ GROUP BY qid),
verdicts_ AS (SELECT qid, CASE WHEN nv AND no THEN 'consistent' WHEN nv <> no THEN 'conflict' WHEN n > 0 AND ag = n THEN 'consistent'
    WHEN co > 0 THEN 'conflict' WHEN n > 0 AND (ag + 0.5e0 * pa) / n >= 0.5e0 THEN 'partial' ELSE 'disagree' END AS verdict,
  CASE WHEN nv AND no THEN 1.0e0 WHEN nv <> no OR coalesce(n, 0) = 0 THEN 0.0e0 ELSE round_even((ag + 0.5e0 * pa) / n, 3) END AS agreement,
  coalesce(n, 0)::BIGINT AS pairs FROM base_ LEFT JOIN counts_ USING (qid))"""


CHAT = f"WITH {Q.ASKS}, {claims_sql('asks_')}"
QA_ASKS = Q.QA + ", qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), " + claims_sql("qa_asks")


@query("token_f1", f"WITH {Q.QA}, t AS (SELECT idx, {Q.tokens('vlm_pred')} AS a, {Q.tokens('gold[1]')} AS b FROM qa) "
       f"SELECT idx, {_f1(_common('a', 'b'), 'len(a)', 'len(b)')} AS f1 FROM t")
def token_f1(spark, sf):
    from ..functions import text as T
    p = X.predictions(spark, sf).select("idx", T.tokens(F.col("vlm_pred")).alias("a"), T.tokens(F.col("gold")[0]).alias("b"))
    return p.select("idx", S.token_f1(F.col("a"), F.col("b")).alias("f1"))


@query("compare_claims", f"""WITH {Q.QA}, asks_ AS (SELECT qid, coalesce(vlm_pred, '') AS vlm, coalesce(ocr_pred, '') AS ocr FROM qa),
x AS (SELECT qid, {Q.norm_text('vlm')} AS anorm, {Q.norm_text('ocr')} AS bnorm FROM asks_),
y AS (SELECT *, {Q.toks_of('anorm')} AS ta, {Q.toks_of('bnorm')} AS tb, {Q.nums_of('anorm')} AS an, {Q.nums_of('bnorm')} AS bn FROM x),
z AS (SELECT *, list_filter(ta, lambda t_: NOT {Q.is_num('t_')}) AS wa, list_filter(tb, lambda t_: NOT {Q.is_num('t_')}) AS wb FROM y),
m AS (SELECT *, {_f1(_common('ta', 'tb'), 'len(ta)', 'len(tb)')} AS f1, {_f1(_common('wa', 'wb'), 'len(wa)', 'len(wb)')} AS ctx,
  len(ta) > 0 AND len(tb) > 0 AND (list_has_all(tb, ta) OR list_has_all(ta, tb)) AS contained FROM z),
l AS (SELECT *, CASE WHEN an <> bn AND (ctx >= 0.3e0 OR (len(wa) = 0 AND len(wb) = 0)) THEN 'conflict'
  WHEN anorm = bnorm OR contained OR f1 >= 0.8e0 THEN 'agree' WHEN f1 >= 0.4e0 THEN 'partial' ELSE 'none' END AS label FROM m)
SELECT qid, label, round_even(CASE WHEN label = 'agree' AND contained THEN greatest(f1, 0.8e0) ELSE f1 END, 3) AS score FROM l""")
def compare_claims(spark, sf):
    p = X.predictions(spark, sf).select("qid", S.compare_claims(F.col("vlm_pred"), F.col("ocr_pred")).alias("c"))
    return p.select("qid", "c.label", "c.score")


@query("claim_pairs", CHAT + " SELECT qid, ord::INT AS ord, vlm, ocr, label, score FROM pairs_ WHERE label <> 'only_ocr'")
def claim_pairs(spark, sf):
    return C.claim_pairs(X.asks(spark, sf)).where("label <> 'only_ocr'").select("qid", "ord", "vlm", "ocr", "label", "score")


@query("unmatched_claims", CHAT + " SELECT qid, ord::INT AS ord, ocr FROM pairs_ WHERE label = 'only_ocr'")
def unmatched_claims(spark, sf):
    return C.claim_pairs(X.asks(spark, sf)).where("label = 'only_ocr'").select("qid", "ord", "ocr")


@query("verdicts", CHAT + " SELECT qid, verdict, agreement, pairs FROM verdicts_")
def verdicts(spark, sf):
    return C.verdicts(X.asks(spark, sf)).select("qid", "verdict", "agreement", "pairs")


@query("reader_agreement", f"WITH {QA_ASKS} SELECT idx, verdict = 'consistent' AS agree FROM qa LEFT JOIN verdicts_ USING (qid)")
def reader_agreement(spark, sf):
    return C.agreement_flags(X.predictions(spark, sf).select("idx", "vlm_pred", "ocr_pred"), ["idx"]).select("idx", "agree")


@query("numbers_only", f"""WITH {Q.ASKS}, n AS (SELECT qid, {Q.numbers('vlm')} AS x, {Q.numbers('ocr')} AS y FROM asks_)
SELECT qid, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), '|') AS numbers_only_vlm,
  array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), '|') AS numbers_only_ocr FROM n""")
def numbers_only(spark, sf):
    return C.numbers_only(X.asks(spark, sf)).select("qid", *[
        F.array_join(c, "|").alias(c) for c in ("numbers_only_vlm", "numbers_only_ocr")])


def _sql_texts(label, expr, name):
    return f"coalesce(string_agg({expr}, '|' ORDER BY ord) FILTER (label = '{label}'), '') AS {name}"


@query("synthesis_ledger", CHAT + f""", g AS (SELECT p.qid, {_sql_texts('agree', 'vlm', 'consensus')}, {_sql_texts('only_vlm', 'vlm', 'vlm_unique')},
  {_sql_texts('only_ocr', 'ocr', 'ocr_unique')},
  {_sql_texts('conflict', "'Vision reported ''' || vlm || ''' while OCR reported ''' || ocr || ''''", 'discrepancies')}
  FROM pairs_ p WHERE p.qid IN (SELECT qid FROM found_) GROUP BY p.qid)
SELECT b.qid, CASE WHEN nv AND no THEN 'not_found' WHEN no THEN 'only_vlm' WHEN nv THEN 'only_ocr' ELSE 'both' END AS "case",
  CASE WHEN nv AND no THEN '{Q.NF}' ELSE coalesce(consensus, '') END AS consensus,
  CASE WHEN no AND NOT nv THEN trim(vlm) ELSE coalesce(vlm_unique, '') END AS vlm_unique,
  CASE WHEN nv AND NOT no THEN trim(ocr) ELSE coalesce(ocr_unique, '') END AS ocr_unique, coalesce(discrepancies, '') AS discrepancies
FROM base_ b LEFT JOIN g ON g.qid = b.qid""")
def synthesis_ledger(spark, sf):
    return C.ledger(X.asks(spark, sf)).select("qid", "case", *[
        F.array_join(c, "|").alias(c) for c in ("consensus", "vlm_unique", "ocr_unique", "discrepancies")])
