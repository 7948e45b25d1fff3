"""Causes, run diagnoses, findings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as M
from ..functions import text as T
from ..operators import causes as K
from ..operators import claims as C
from ..operators import findings as N
from ..operators import items as I
from ..operators import support as P
from ..operators.staging import staged, work_dir
from ..sources import exports
from . import fixtures as X
from . import sqlparts as Q
from .claim_queries import claims_sql
from .layout_queries import LAYOUT, PAGE, locate_sql
from .registry import query
from .retrieval_queries import _LOOK, _SIM, CARD, _asks, _both_texts, _fold

RUN = ["exp_id"]


def _outer(x):
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'), ' .,:;!?\"''')"


def _flat(x):
    return f"replace({_outer(x)}, ' ', '')"


def _diff(a, b):
    return f"list_filter(list_transform(range(1, length({a}) + 1), lambda i_: {a}[i_] || {b}[i_]), lambda p_: p_[1] <> p_[2])"


def _swaps(a, b):
    fa, fb = _fold(a), _fold(b)
    return f"CASE WHEN length({a}) = length({b}) THEN {_diff(a, b)} WHEN length({fa}) = length({fb}) THEN {_diff('(' + fa + ')', '(' + fb + ')')} END"


def _looks(a, b):
    s = _swaps(a, b)
    return (f"coalesce({s} IS NOT NULL AND (len({s}) > 0 OR length({a}) <> length({b})) AND coalesce(list_bool_and(list_transform({s}, lambda q_: list_contains({_LOOK}, q_))), true), false)")


_PAIR = f"WITH {Q.QA}, w_ AS (SELECT idx, {_flat('gold[1]')} AS a, {_flat('vlm_pred')} AS b, {_flat('ocr_pred')} AS c FROM qa)"


@query("word_swaps", f"{_PAIR} SELECT idx, array_to_string({_swaps('a', 'b')}, '|') AS vlm_swaps, array_to_string({_swaps('a', 'c')}, '|') AS ocr_swaps FROM w_")
def word_swaps(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("idx", *[F.array_join(K.word_edits(F.col(f"{s}_pred"), F.col("gold")), "|").alias(f"{s}_swaps") for s in I.SIDES])


@query("lookalike_answers", f"{_PAIR} SELECT idx, {_looks('a', 'b')} AS vlm_alike, {_looks('a', 'c')} AS ocr_alike FROM w_")
def lookalike_answers(spark, sf):
    flat = lambda s: F.replace(T.outer_norm(s), F.lit(" "), F.lit(""))
    p = X.predictions(spark, sf).select("idx", flat(F.col("gold")[0]).alias("a"), flat(F.col("vlm_pred")).alias("b"), flat(F.col("ocr_pred")).alias("c"))
    return p.select("idx", M.is_lookalike(F.col("a"), F.col("b")).alias("vlm_alike"), M.is_lookalike(F.col("a"), F.col("c")).alias("ocr_alike"))


@query("confusion_matrix", f"{_PAIR}, s_ AS (SELECT unnest({_swaps('a', 'b')}) AS p FROM w_) SELECT p[1] AS true_char, p[2] AS read_char, count(*) AS n FROM s_ GROUP BY ALL")
def confusion_matrix(spark, sf):
    flat = lambda s: F.replace(T.outer_norm(s), F.lit(" "), F.lit(""))
    p = X.predictions(spark, sf).select(flat(F.col("gold")[0]).alias("a"), flat(F.col("vlm_pred")).alias("b"))
    return K.confusion_matrix(p, "a", "b")


# ------------------------------------------------------------------------------------------ diagnosis
def _cause(s):
    ocr = "true" if s == "ocr" else "false"
    return f"""CASE WHEN er = 1 THEN 'failed' WHEN c = 1 AND (absent OR garbled) THEN '{'repaired' if s == 'ocr' else 'beyond_ocr'}' WHEN c = 1 THEN 'correct'
  WHEN ab = 1 AND {ocr} AND absent THEN 'lost' WHEN ab = 1 AND {ocr} AND garbled THEN CASE WHEN merged THEN 'spacing' ELSE 'misread' END WHEN ab = 1 THEN 'missed'
  WHEN glued AND {ocr} AND nw < gw THEN 'spacing' WHEN glued THEN 'format' WHEN len(pk) > 0 AND len(gk) > len(pk) AND list_has_all(gk, pk) THEN 'partial'
  WHEN {ocr} AND absent THEN 'lost' WHEN {ocr} AND garbled THEN CASE WHEN merged THEN 'spacing' ELSE 'misread' END
  WHEN alike THEN 'misread' WHEN an > 0 AND NOT othernum AND NOT {ocr} AND edited <= 3 THEN 'misread' WHEN an > 0 AND NOT othernum THEN 'near_miss'
  WHEN len(pk) > 0 AND list_has_all(voc, pk) THEN 'wrong_value' ELSE 'unsupported' END"""


def _nums(x):
    return f"list_sort(list_distinct(regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*')))"


def _words(x):
    return f"len(list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w_: w_ <> ''))"


DIAG = f"""{Q.SCORED}, {LAYOUT},
la_ AS (SELECT idx * 10 + generate_subscripts(gold, 1) - 1 AS k, doc_id AS g, unnest(gold) AS answer FROM qa), {locate_sql('la_')},
lp_ AS (SELECT k // 10 AS idx, k % 10 AS no, misreads, merged, round_even(score, 3) AS conf, layout, small FROM loc_ JOIN lay_ ON lay_.doc_id = g AND lay_.line_no = loc_.line_no),
pk_ AS (SELECT qa.idx, CASE WHEN min(no) FILTER (misreads = '') IS NOT NULL THEN min(no) FILTER (misreads = '') ELSE max(no) FILTER (no = len(gold) - 1) END AS pick
  FROM qa LEFT JOIN lp_ USING (idx) GROUP BY qa.idx),
pl2_ AS (SELECT pk_.idx, pick IS NOT NULL AS located, coalesce(misreads, '') AS misreads, coalesce(merged, false) AS merged, conf, layout, small
  FROM pk_ LEFT JOIN lp_ ON lp_.idx = pk_.idx AND lp_.no = pick),
sd_ AS (SELECT s.idx, 'vlm' AS side, vlm_pred AS pred, vlm_contains AS c, vlm_anls AS an, vlm_abstain AS ab, vlm_error AS er, gold, ocr_text, answer_in_ocr FROM scored s
  UNION ALL SELECT s.idx, 'ocr', ocr_pred, ocr_contains, ocr_anls, ocr_abstain, ocr_error, gold, ocr_text, answer_in_ocr FROM scored s),
cg_ AS (SELECT idx, side, pred, unnest(gold) AS g, generate_subscripts(gold, 1) AS no FROM sd_ WHERE pred IS NOT NULL),
p2_ AS (SELECT DISTINCT {_outer('pred')} AS a, {_outer('g')} AS b FROM cg_ UNION SELECT DISTINCT {_flat('g')}, {_flat('pred')} FROM cg_),
lcs2_ AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS r FROM p2_
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN k = 1 THEN 0 WHEN b[k - 1] = a[i + 1] THEN greatest(r[k], r[k - 1] + 1) ELSE r[k] END))) FROM lcs2_ WHERE i < length(a)),
l2_ AS (SELECT a, b, r[-1] AS l FROM lcs2_ WHERE i = length(a)),
bg_ AS (SELECT idx, side, g FROM (SELECT *, row_number() OVER (PARTITION BY idx, side ORDER BY CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2.0e0 * l / (length(a) + length(b)) END DESC, no) AS rn
  FROM cg_ JOIN l2_ ON a = {_outer('pred')} AND b = {_outer('g')}) WHERE rn = 1),
ft_ AS (SELECT sd_.*, bg_.g, located, misreads, merged, conf, layout, small, coalesce(NOT located AND NOT answer_in_ocr, false) AS absent,
  located AND (misreads <> '' OR merged) AND NOT answer_in_ocr AS garbled, {Q.alnum('pred')} AS pa, {Q.alnum('bg_.g')} AS ga,
  list_distinct({Q.keys('pred')}) AS pk, list_distinct({Q.keys('bg_.g')}) AS gk, {Q.vocab('ocr_text')} AS voc, {_words('pred')} AS nw, {_words('bg_.g')} AS gw,
  len({_nums('pred')}) > 0 AND len({_nums('bg_.g')}) > 0 AND {_nums('pred')} <> {_nums('bg_.g')} AS othernum, {_flat('bg_.g')} AS fg, {_flat('pred')} AS fp
  FROM sd_ LEFT JOIN bg_ USING (idx, side) JOIN pl2_ USING (idx)),
fu_ AS (SELECT ft_.*, (pa <> '' AND list_contains(list_transform(gold, lambda g_: {Q.alnum('g_')}), pa)) OR (ga <> '' AND contains(pa, ga) AND length(pa) - length(ga) <= 12 AND nw < gw) AS glued,
  {_looks('fg', 'fp')} AS alike, CASE WHEN length(fg) = length(fp) THEN 2 * len({_diff('fg', 'fp')}) ELSE length(fg) + length(fp) - 2 * l END AS edited
  FROM ft_ LEFT JOIN l2_ ON l2_.a = fg AND l2_.b = fp),
ca2_ AS (SELECT idx, side, CASE side WHEN 'vlm' THEN {_cause('vlm')} ELSE {_cause('ocr')} END AS cause, c FROM fu_),
dg_ AS (SELECT s.exp_id, s.idx, s.types, located, misreads, merged, conf, layout, small, CASE WHEN NOT located AND answer_in_ocr THEN 'read clearly by OCR' WHEN NOT located THEN 'not read by OCR'
    WHEN misreads <> '' OR merged THEN 'read with errors by OCR' WHEN conf >= 0.9e0 THEN 'read clearly by OCR' ELSE 'read with low confidence by OCR' END AS bucket,
  v.cause AS vlm_cause, o.cause AS ocr_cause, vlm_contains = 1 AS v, ocr_contains = 1 AS o, CASE WHEN vlm_contains = 1 AND ocr_contains = 1 THEN 'both' WHEN vlm_contains = 1 THEN 'vlm'
    WHEN ocr_contains = 1 THEN 'ocr' ELSE 'neither' END AS better
  FROM scored s JOIN pl2_ USING (idx) JOIN ca2_ v ON v.idx = s.idx AND v.side = 'vlm' JOIN ca2_ o ON o.idx = s.idx AND o.side = 'ocr')"""

_W = "('misread', 'spacing', 'lost', 'wrong_value', 'missed', 'partial', 'near_miss', 'format', 'unsupported', 'failed')"
_LOST = f"""lo_ AS (SELECT exp_id, better AS winner, CASE better WHEN 'vlm' THEN ocr_cause ELSE vlm_cause END AS cause, count(*) AS n FROM dg_ WHERE better IN ('vlm', 'ocr') GROUP BY ALL),
lost_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exp_id, winner ORDER BY n DESC, cause) AS rank FROM (
  SELECT *, n / sum(n) OVER (PARTITION BY exp_id, winner) AS share FROM lo_) WHERE cause IN {_W}) WHERE rank <= 3)"""
_GROUPS = f"""ge_ AS (SELECT exp_id, 'type' AS kind, unnest(types) AS grp, v, o, vlm_cause, ocr_cause FROM dg_ UNION ALL SELECT exp_id, 'reading', bucket, v, o, vlm_cause, ocr_cause FROM dg_
  UNION ALL SELECT exp_id, 'layout', CASE WHEN located THEN CASE layout WHEN 'table' THEN 'table row' WHEN 'form' THEN 'label and value' ELSE 'running text' END
    WHEN bucket = 'not read by OCR' THEN bucket ELSE 'in OCR''s text, place not found' END, v, o, vlm_cause, ocr_cause FROM dg_),
gc_ AS (SELECT exp_id, kind, grp, side, arg_min(cause, (-n, cause)) AS main FROM (SELECT exp_id, kind, grp, 'vlm' AS side, vlm_cause AS cause, count(*) AS n FROM ge_ WHERE vlm_cause IN {_W} GROUP BY ALL
  UNION ALL SELECT exp_id, kind, grp, 'ocr', ocr_cause, count(*) FROM ge_ WHERE ocr_cause IN {_W} GROUP BY ALL) GROUP BY ALL),
gr_ AS (SELECT exp_id, kind, grp, count(*) AS n, round_even(avg(v::INT), 4) AS vlm_right, round_even(avg(o::INT), 4) AS ocr_right,
  CASE WHEN avg(v::INT) - avg(o::INT) >= 0.05e0 THEN 'vlm' WHEN avg(v::INT) - avg(o::INT) <= -0.05e0 THEN 'ocr' ELSE 'same' END AS better FROM ge_ GROUP BY ALL),
groups_ AS (SELECT gr_.*, v.main AS vlm_main_cause, o.main AS ocr_main_cause FROM gr_ LEFT JOIN gc_ v ON v.exp_id = gr_.exp_id AND v.kind = gr_.kind AND v.grp = gr_.grp AND v.side = 'vlm'
  LEFT JOIN gc_ o ON o.exp_id = gr_.exp_id AND o.kind = gr_.kind AND o.grp = gr_.grp AND o.side = 'ocr')"""


def _diagnosed(spark, sf):
    items = I.score_items(I.with_coverage(X.predictions(spark, sf))).drop("layer_text")
    return K.item_diagnosis(items, X.ocr_lines(spark, sf), ["idx"], PAGE)


def _judged(spark, sf):
    """Diagnosed items with the readers' agreement."""
    items = K.without_texts(I.score_items(I.with_coverage(X.predictions(spark, sf))).drop("layer_text"))
    return K.item_diagnosis(C.agreement_flags(items, ["idx"]), X.ocr_lines(spark, sf), ["idx"], PAGE)


_JUDGED = f"{DIAG}, qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), {claims_sql('qa_asks')}"


@query("items_csv", f"""WITH RECURSIVE {_JUDGED} SELECT s.qid, question, CASE WHEN len(gold) = 2 THEN '["' || gold[1] || '","' || gold[2] || '"]' ELSE '["' || gold[1] || '"]' END AS gold,
  vlm_pred, ocr_pred, vlm_em, round(vlm_anls, 6) AS vlm_anls, ocr_em, round(ocr_anls, 6) AS ocr_anls, vlm_ms, ocr_ms, answer_in_ocr, verdict = 'consistent' AS pipelines_agree, dg_.better,
  dg_.vlm_cause, dg_.ocr_cause, bucket AS answer_region, dg_.vlm_cause AS why_vlm, dg_.ocr_cause AS why_ocr FROM scored s JOIN dg_ USING (idx) LEFT JOIN verdicts_ v ON v.qid = s.qid""")
def items_csv(spark, sf):
    """All columns, written as CSV and read back."""
    folder = f"{work_dir(spark, 'csv')}/items"
    exports.export_items_csv(_judged(spark, sf), folder)
    return exports.read_items_csv(spark, folder).withColumns({"vlm_anls": F.round("vlm_anls", 6), "ocr_anls": F.round("ocr_anls", 6)})


_PICKED = (("all", "misread"), ("vlm_only", "spacing"), ("ocr_only", "missed"), ("ocr_missing", "lost"), ("disagree", "wrong_value"))
_MODES = {"all": "true", "disagree": "verdict <> 'consistent'", "vlm_only": "v AND NOT o", "ocr_only": "o AND NOT v", "ocr_missing": "NOT answer_in_ocr"}


@query("items_by_cause", f"WITH RECURSIVE {_JUDGED}, fm_ AS (SELECT dg_.*, answer_in_ocr, verdict FROM dg_ JOIN scored s USING (idx) LEFT JOIN verdicts_ w ON w.qid = s.qid) " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, '{cause}' AS cause, idx FROM fm_ WHERE ({_MODES[mode]}) AND (vlm_cause = '{cause}' OR ocr_cause = '{cause}')" for mode, cause in _PICKED))
def items_by_cause(spark, sf):
    """The analyst's filters, each with a cause."""
    d = staged(_judged(spark, sf).select("idx", "agree", "answer_in_ocr", "vlm_scores", "ocr_scores", "vlm_cause", "ocr_cause"), "judged")
    parts = [I.filter_items(d, mode, cause).select(F.lit(mode).alias("mode"), F.lit(cause).alias("cause"), "idx") for mode, cause in _PICKED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("closest_golds", f"WITH RECURSIVE {DIAG} SELECT idx, g AS gold FROM bg_ WHERE side = 'ocr'")
def closest_golds(spark, sf):
    p = X.predictions(spark, sf).where("ocr_pred IS NOT NULL")
    return p.select("idx", K.closest_gold(F.col("ocr_pred"), F.col("gold")).alias("gold"))


@query("reading_buckets", f"WITH RECURSIVE {DIAG} SELECT exp_id, bucket, count(*) AS n FROM dg_ GROUP BY ALL")
def reading_buckets(spark, sf):
    return _diagnosed(spark, sf).groupBy("exp_id", "bucket").agg(F.count("*").alias("n"))


@query("side_causes", f"WITH RECURSIVE {DIAG} SELECT idx, vlm_cause, ocr_cause FROM dg_")
def side_causes(spark, sf):
    return _diagnosed(spark, sf).select("idx", "vlm_cause", "ocr_cause")


@query("item_diagnosis", f"WITH RECURSIVE {DIAG} SELECT idx, located, conf, layout, small, CASE WHEN located THEN misreads END AS misreads, CASE WHEN located THEN merged END AS merged, bucket, better FROM dg_")
def item_diagnosis(spark, sf):
    d = _diagnosed(spark, sf)
    return d.select("idx", "located", "conf", "layout", "small", F.array_join(F.array_sort("misreads"), "|").alias("misreads"), "merged", "bucket", "better")


@query("outcomes", f"WITH {Q.SCORED} SELECT exp_id, CASE WHEN vlm_contains = 1 AND ocr_contains = 1 THEN 'both' WHEN vlm_contains = 1 THEN 'vlm' WHEN ocr_contains = 1 THEN 'ocr' ELSE 'neither' END AS better, count(*) AS n FROM scored GROUP BY ALL")
def outcomes(spark, sf):
    from ..functions import scoring as S
    s = I.score_items(X.predictions(spark, sf))
    v, o = S.is_right(F.col("vlm_scores")), S.is_right(F.col("ocr_scores"))
    return K.outcomes(s.withColumn("better", F.when(v & o, "both").when(v, "vlm").when(o, "ocr").otherwise("neither")), RUN)


@query("cause_counts", f"WITH RECURSIVE {DIAG} SELECT exp_id, 'vlm' AS side, vlm_cause AS cause, count(*) AS n FROM dg_ GROUP BY ALL UNION ALL SELECT exp_id, 'ocr', ocr_cause, count(*) FROM dg_ GROUP BY ALL")
def cause_counts(spark, sf):
    return K.cause_counts(_diagnosed(spark, sf), RUN)


@query("lost_to", f"WITH RECURSIVE {DIAG}, {_LOST} SELECT exp_id, winner, cause, n, round(share, 6) AS share, rank::INT AS rank FROM lost_")
def lost_to(spark, sf):
    return K.lost_to(_diagnosed(spark, sf), RUN).withColumn("share", F.round("share", 6))


@query("grouped_accuracy", f"WITH RECURSIVE {DIAG}, {_GROUPS} SELECT * FROM groups_")
def grouped_accuracy(spark, sf):
    return K.grouped_accuracy(_diagnosed(spark, sf), RUN)


@query("run_diagnosis", f"""WITH RECURSIVE {DIAG}, {_LOST}, {_GROUPS}
SELECT exp_id, 'outcome' AS section, better AS name, NULL AS other, count(*) AS n, NULL::DOUBLE AS value FROM dg_ GROUP BY ALL
UNION ALL SELECT exp_id, 'cause', vlm_cause, 'vlm', count(*), NULL FROM dg_ GROUP BY ALL UNION ALL SELECT exp_id, 'cause', ocr_cause, 'ocr', count(*), NULL FROM dg_ GROUP BY ALL
UNION ALL SELECT exp_id, 'lost_to', cause, winner, n, round(share, 4) FROM lost_ UNION ALL SELECT exp_id, kind, grp, better, n, round(vlm_right - ocr_right, 4) FROM groups_""")
def run_diagnosis(spark, sf):
    return K.run_diagnosis(_diagnosed(spark, sf), RUN).withColumn("value", F.round("value", 4))


@query("run_findings", f"""WITH RECURSIVE {DIAG}, {_LOST}, {_GROUPS}, h_ AS (SELECT exp_id, count(*) FILTER (better = 'both') AS b, count(*) FILTER (better = 'vlm') AS v, count(*) FILTER (better = 'ocr') AS o, count(*) FILTER (better = 'neither') AS n FROM dg_ GROUP BY exp_id)
SELECT exp_id, 'head_to_head' AS kind, unnest(['both', 'vlm', 'ocr', 'neither']) AS name, unnest([b, v, o, n])::DOUBLE AS value FROM h_
UNION ALL SELECT exp_id, 'ahead', CASE WHEN v > o THEN 'vlm' WHEN o > v THEN 'ocr' ELSE 'none' END, abs(v - o)::DOUBLE FROM h_
UNION ALL SELECT exp_id, 'reason', winner || ': ' || cause, round(share, 4) FROM lost_
UNION ALL SELECT exp_id, 'type_gap', grp, round(vlm_right - ocr_right, 4) FROM groups_ WHERE kind = 'type' AND n >= 5 AND abs(vlm_right - ocr_right) >= 0.05e0
UNION ALL SELECT exp_id, 'beyond_text', 'repaired', count(*)::DOUBLE FROM dg_ WHERE ocr_cause = 'repaired' GROUP BY exp_id
UNION ALL SELECT exp_id, 'beyond_text', 'beyond_ocr', count(*)::DOUBLE FROM dg_ WHERE vlm_cause = 'beyond_ocr' GROUP BY exp_id
UNION ALL SELECT exp_id, 'wrong_answers', 'vlm', count(*)::DOUBLE FROM dg_ WHERE vlm_cause IN {_W} GROUP BY exp_id
UNION ALL SELECT exp_id, 'wrong_answers', 'ocr', count(*)::DOUBLE FROM dg_ WHERE ocr_cause IN {_W} GROUP BY exp_id""")
def run_findings(spark, sf):
    d = staged(K.narrow(_diagnosed(spark, sf), RUN), "findings")
    f = N.run_findings(K.outcomes(d, RUN), K.lost_to(d, RUN), K.grouped_accuracy(d, RUN), K.cause_counts(d, RUN), RUN)
    return f.withColumn("value", F.round("value", 4))


# ------------------------------------------------------------------------------------------ single questions
_QA_CLAIMS = f"qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), {claims_sql('qa_asks')}"


def _open_asks(spark, sf):
    """Questions judged by a reference, by a closer reading, or by nothing."""
    return _with_verdicts(_closer_asks(spark, sf))


def _closer_asks(spark, sf):
    return _asks(spark, sf).withColumn("closer_text", F.when(F.col("idx") % 8 == 3, F.col("first_gold")))


def _asked(spark, sf):
    """The same questions, prepared; their texts are left where they are read."""
    return K.better_reader(_with_verdicts(staged(K.asked_words(K.prepare_asks(_closer_asks(spark, sf))), "asked")))


def _with_verdicts(a):
    i = F.col("idx")
    v = C.verdicts(a.select("qid", F.col("vlm_answer").alias("vlm"), F.col("ocr_answer").alias("ocr"))).select(
        "qid", "verdict", "n_only_vlm", "n_only_ocr")
    return a.join(v, "qid", "left").na.fill(0, ["n_only_vlm", "n_only_ocr"]).withColumns({
        "vlm_survived": F.when(i % 4 < 2, i % 4 == 0), "ocr_survived": F.when(i % 6 < 3, i % 6 == 1)})


def _supp(k):
    return f"CASE WHEN jv IS NOT NULL AND len({k}) > 0 THEN len(list_filter({k}, lambda t: list_contains(jv, t))) / len({k})::DOUBLE END"


_BETTER = f"""{Q.QA}, {_QA_CLAIMS}, on_ AS (SELECT qid, count(*) FILTER (label = 'only_vlm') AS ov, count(*) FILTER (label = 'only_ocr') AS oo FROM pairs_ GROUP BY qid),
j0_ AS (SELECT qa.idx, qa.qid, vlm_pred, ocr_pred, verdict, coalesce(ov, 0) AS ov, coalesce(oo, 0) AS oo,
  CASE WHEN idx % 4 <> 3 THEN {Q.vocab('layer_text')} WHEN idx % 8 = 3 THEN {Q.vocab('gold[1]')} END AS jv,
  vlm_pred IS NOT NULL AND {Q.not_found('vlm_pred')} AS nv, ocr_pred IS NOT NULL AND {Q.not_found('ocr_pred')} AS no,
  CASE WHEN vlm_pred IS NOT NULL AND NOT {Q.not_found('vlm_pred')} THEN {Q.keys('vlm_pred')} ELSE [] END AS kv,
  CASE WHEN ocr_pred IS NOT NULL AND NOT {Q.not_found('ocr_pred')} THEN {Q.keys('ocr_pred')} ELSE [] END AS ko FROM qa LEFT JOIN verdicts_ USING (qid) LEFT JOIN on_ USING (qid)),
j1_ AS (SELECT *, {_supp('kv')} AS a, {_supp('ko')} AS b FROM j0_),
better_ AS (SELECT *, CASE WHEN vlm_pred IS NULL AND ocr_pred IS NOT NULL THEN 'ocr' WHEN ocr_pred IS NULL AND vlm_pred IS NOT NULL THEN 'vlm'
  WHEN jv IS NOT NULL AND a IS NULL AND b IS NULL THEN CASE WHEN nv AND no THEN 'same' ELSE 'undecided' END
  WHEN jv IS NOT NULL AND (b IS NULL OR coalesce(a - b >= 0.1e0, false)) THEN CASE WHEN coalesce(a, 0) >= 0.5e0 THEN 'vlm' ELSE 'undecided' END
  WHEN jv IS NOT NULL AND (a IS NULL OR coalesce(b - a >= 0.1e0, false)) THEN CASE WHEN coalesce(b, 0) >= 0.5e0 THEN 'ocr' ELSE 'undecided' END
  WHEN verdict = 'consistent' THEN 'same' WHEN jv IS NOT NULL THEN CASE WHEN oo > 0 AND ov = 0 THEN 'ocr' WHEN ov > 0 AND oo = 0 THEN 'vlm' ELSE 'undecided' END ELSE 'undecided' END AS better FROM j1_)"""


@query("better_reader", f"WITH {_BETTER} SELECT idx, better, round(a, 6) AS vlm_backing, round(b, 6) AS ocr_backing FROM better_")
def better_reader(spark, sf):
    b = K.better_reader(K.prepare_asks(_open_asks(spark, sf)))
    return b.select("idx", "better", F.round("vlm_backing", 6).alias("vlm_backing"), F.round("ocr_backing", 6).alias("ocr_backing"))


def _regions(spark, sf, prepared):
    return K.answer_regions(K.core_words(prepared), X.ocr_lines(spark, sf), ["idx"], PAGE)


@query("answer_regions")
def answer_regions(spark, sf):
    r = _regions(spark, sf, _asked(spark, sf))
    return r.select("idx", "region", "line_no", "conf", "layout", "term", "in_page", "vision", "ocr_text", "ocr_answer", "region_better")


@query("ask_causes")
def ask_causes(spark, sf):
    prepared = staged(_asked(spark, sf), "asks")
    r = staged(_regions(spark, sf, prepared).select("idx", "doc_id", "line_no").distinct(), "regions")
    words = X.ocr_lines(spark, sf).select("doc_id", "line_no", "text").join(r, ["doc_id", "line_no"]).select(
        "idx", "doc_id", "line_no", T.vocab(F.col("text")).alias("line_words"))
    return K.ask_causes(prepared, words, ["idx"])


# ------------------------------------------------------------------------------------------ findings
@query("recognition_sets", f"""WITH {Q.QA}, r_ AS (SELECT idx, CASE WHEN vlm_pred IS NOT NULL AND NOT {Q.not_found('vlm_pred')} THEN list_distinct({Q.content_of(Q.tokens('vlm_pred'))}) ELSE [] END AS v,
  CASE WHEN ocr_pred IS NOT NULL AND NOT {Q.not_found('ocr_pred')} THEN list_distinct({Q.content_of(Q.tokens('ocr_pred'))}) ELSE [] END AS o, {Q.vocab('ocr_text')} AS ocr,
  CASE WHEN idx % 4 <> 3 THEN {Q.vocab('layer_text')} END AS ref FROM qa),
u_ AS (SELECT idx, ref, list_filter(v, lambda t: NOT list_contains(ocr, ltrim(t, '$'))) AS v, list_filter(o, lambda t: NOT list_contains(ocr, ltrim(t, '$'))) AS o FROM r_)
SELECT idx, array_to_string(list_sort(CASE WHEN ref IS NULL THEN v ELSE list_filter(v, lambda t: list_contains(ref, ltrim(t, '$'))) END), '|') AS vision_saw,
  array_to_string(list_sort(CASE WHEN ref IS NULL THEN [] ELSE list_filter(o, lambda t: list_contains(ref, ltrim(t, '$'))) END), '|') AS repaired,
  array_to_string(list_sort(CASE WHEN ref IS NULL THEN [] ELSE list_filter(o, lambda t: NOT list_contains(ref, ltrim(t, '$'))) END), '|') AS invented FROM u_""")
def recognition_sets(spark, sf):
    r = N.recognition_sets(_asks(spark, sf), ["idx"])
    return r.select("idx", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("vision_saw", "repaired", "invented")])


@query("read_grades", f"WITH {_SIM} SELECT doc_id, CASE WHEN similarity >= 0.98e0 THEN 'excellent' WHEN similarity >= 0.9e0 THEN 'good' WHEN similarity >= 0.75e0 THEN 'fair' ELSE 'poor' END AS grade, missed FROM sim_")
def read_grades(spark, sf):
    s = P.page_similarity(_both_texts(spark, sf), ["doc_id"], "layer_text", "ocr_text")
    return s.select("doc_id", N.read_grade(F.col("similarity")).alias("grade"), "missed")


_SPEED = "(SELECT event_id, value * 100 AS v, value * (50 + event_id % 100) AS o, value * (20 + event_id % 30) AS om, value * (event_id % 40) AS ow, value * (event_id % 25) AS rm, CASE WHEN event_id % 2 = 0 THEN 'ocr' ELSE 'textlayer' END AS corpus FROM events)"


@query("speed_findings", f"""SELECT event_id, CASE WHEN NOT abs(v - o) >= greatest(300.0e0, 0.15e0 * greatest(v, o)) THEN 'same' WHEN v < o THEN 'vlm' ELSE 'ocr' END AS faster, round(abs(v - o), 3) AS difference_ms,
  om > 0 AND ow < 0.5e0 * om AS reused, om > 0 AND ow < 0.5e0 * om AND corpus = 'ocr' AND rm >= 0.5e0 * om AS ranked_by_ocr FROM {_SPEED} WHERE v > 0 AND o > 0""")
def speed_findings(spark, sf):
    e, i, v = X.telemetry(spark, sf), F.col("event_id"), F.col("value_ms")
    a = e.select("event_id", (v * 100).alias("vlm_ms"), (v * (50 + i % 100)).alias("ocr_total_ms"), (v * (20 + i % 30)).alias("ocr_ms"), (v * (i % 40)).alias("ocr_wall_ms"),
                 (v * (i % 25)).alias("retrieval_ms"), F.when(i % 2 == 0, "ocr").otherwise("textlayer").alias("corpus"))
    return N.speed_finding(a, ["event_id"]).withColumn("difference_ms", F.round("difference_ms", 3))


@query("page_coverage", """SELECT doc_id, n_pages, vlm_pages, n_pages AS ocr_pages, vlm_pages < n_pages AS vision_saw_part,
  CASE WHEN vlm_pages > 3 THEN 'vlm' ELSE '' END || CASE WHEN vlm_pages > 3 AND n_pages > 5 THEN '+' ELSE '' END || CASE WHEN n_pages > 5 THEN 'ocr' ELSE '' END AS in_parts,
  CASE WHEN doc_id % 2 = 0 THEN 'vlm' ELSE '' END AS combined FROM (SELECT doc_id, 1 + doc_id % 9 AS n_pages, least(1 + doc_id % 9, 6) AS vlm_pages FROM documents) WHERE n_pages > 1""")
def page_coverage(spark, sf):
    f = X.files(spark, sf).select("doc_id", "n_pages", F.least("n_pages", F.lit(6)).alias("vlm_pages"), F.col("n_pages").alias("ocr_pages"))
    f = f.withColumns({"vlm_parts": F.ceil(F.col("vlm_pages") / 3), "ocr_parts": F.ceil(F.col("ocr_pages") / 5), "vlm_combined": F.col("doc_id") % 2 == 0, "ocr_combined": F.lit(False)})
    return N.page_coverage(f, ["doc_id"])


@query("verdict_classes", f"""WITH {Q.QA}, {CARD}, {_QA_CLAIMS}, on_ AS (SELECT qid, count(*) FILTER (label = 'only_vlm') AS ov, count(*) FILTER (label = 'only_ocr') AS oo FROM pairs_ GROUP BY qid),
x_ AS (SELECT c.*, verdict, coalesce(ov, 0) AS ov, coalesce(oo, 0) AS oo FROM card_ c LEFT JOIN verdicts_ USING (qid) LEFT JOIN on_ USING (qid))
SELECT idx, CASE WHEN winner IN ('vlm', 'ocr') THEN winner || ' better supported' WHEN winner = 'tie' AND vlm_support IS NULL AND ocr_support IS NULL THEN
    CASE WHEN NOT vlm_answered AND NOT ocr_answered AND vlm_pred IS NOT NULL AND ocr_pred IS NOT NULL THEN 'both not found' ELSE 'neither checkable' END
  WHEN winner = 'tie' AND (vlm_support IS NULL OR ocr_support IS NULL) THEN 'one answered, barely supported' WHEN winner = 'tie' AND ov + oo > 0 THEN CASE WHEN oo > 0 THEN 'ocr more complete' ELSE 'vlm more complete' END
  WHEN winner = 'tie' AND vlm_support = 1 AND ocr_support = 1 AND verdict = 'consistent' THEN 'both agree and backed' WHEN winner = 'tie' THEN 'neither clearly better'
  WHEN winner = 'unknown' THEN CASE WHEN verdict = 'consistent' THEN 'agree, not checkable' ELSE 'disagree, not checkable' END ELSE 'only one ran' END AS situation FROM x_""")
def verdict_classes(spark, sf):
    card = P.scorecard(_asks(spark, sf)).withColumns({"vlm_failed": F.col("vlm_error").isNotNull(), "ocr_failed": F.col("ocr_error").isNotNull()})
    o = _open_asks(spark, sf).select("idx", "verdict", "n_only_vlm", "n_only_ocr")
    return N.verdict_class(card.join(o, "idx")).select("idx", "situation")
