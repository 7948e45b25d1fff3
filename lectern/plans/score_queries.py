"""Item scores and run statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import claims as C
from ..operators import items as I
from ..operators import stats as E
from . import fixtures as X
from . import sqlparts as Q
from .claim_queries import claims_sql
from .registry import query

RUN = ["exp_id"]


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def _scored(spark, sf):
    return I.score_items(X.predictions(spark, sf))


def _full(spark, sf):
    p = I.with_coverage(X.predictions(spark, sf)).drop("layer_text", "ocr_text")
    return C.agreement_flags(I.score_items(p), ["idx"])


@query("score_items", f"WITH {Q.SCORED} SELECT idx, round(vlm_anls, 6) AS vlm_anls, vlm_em, vlm_contains, vlm_abstain, vlm_error, "
       "round(ocr_anls, 6) AS ocr_anls, ocr_em, ocr_contains, ocr_abstain, ocr_error FROM scored")
def score_items(spark, sf):
    s = _scored(spark, sf)
    cols = [F.col(f"{d}_scores.{m}").alias(f"{d}_{m}") for d in I.SIDES for m in E.METRICS]
    return s.select("idx", *cols).select("idx", *_r("vlm_anls", "ocr_anls"), *[
        f"{d}_{m}" for d in I.SIDES for m in E.METRICS if m != "anls"])


@query("anls_scores", f"WITH {Q.QA} SELECT idx, round({Q.anls('ocr_pred', 'gold')}, 6) AS anls FROM qa")
def anls_scores(spark, sf):
    return X.predictions(spark, sf).select("idx", F.round(S.anls(F.col("ocr_pred"), F.col("gold")), 6).alias("anls"))


@query("exact_matches", f"WITH {Q.QA} SELECT idx, {Q.em('vlm_pred', 'gold')} AS em FROM qa")
def exact_matches(spark, sf):
    return X.predictions(spark, sf).select("idx", S.exact_match(F.col("vlm_pred"), F.col("gold")).alias("em"))


@query("contains_matches", f"WITH {Q.QA} SELECT idx, {Q.contains_('ocr_pred', 'gold')} AS contains FROM qa")
def contains_matches(spark, sf):
    return X.predictions(spark, sf).select("idx", S.contains_match(F.col("ocr_pred"), F.col("gold")).alias("contains"))


@query("answers_in_text", f"WITH {Q.QA} SELECT idx, {Q.in_text('gold', 'ocr_text')} AS in_ocr, {Q.in_text('gold', 'layer_text')} AS in_layer FROM qa")
def answers_in_text(spark, sf):
    return X.predictions(spark, sf).select("idx", S.answer_in_text(F.col("gold"), F.col("ocr_text")).alias("in_ocr"),
                                           S.answer_in_text(F.col("gold"), F.col("layer_text")).alias("in_layer"))


@query("right_answers", f"WITH {Q.SCORED} SELECT idx, vlm_contains = 1 AS vlm_right, ocr_contains = 1 AS ocr_right FROM scored")
def right_answers(spark, sf):
    return _scored(spark, sf).select("idx", *[S.is_right(F.col(f"{s}_scores")).alias(f"{s}_right") for s in I.SIDES])


_REC = "CASE WHEN idx % 4 = 0 THEN NULL WHEN idx % 2 = 0 THEN 'vlm' ELSE 'ocr' END"


@query("recommended_correct", f"""WITH {Q.SCORED} SELECT idx, CASE {_REC} WHEN 'vlm' THEN CASE WHEN vlm_pred IS NOT NULL THEN vlm_contains = 1 OR vlm_anls >= 0.5e0 END
  WHEN 'ocr' THEN CASE WHEN ocr_pred IS NOT NULL THEN ocr_contains = 1 OR ocr_anls >= 0.5e0 END END AS recommended_correct FROM scored""")
def recommended_correct(spark, sf):
    p = X.predictions(spark, sf).withColumn("rec", F.expr(_REC))
    return p.select("idx", S.recommended_correct(F.col("rec"), F.col("vlm_pred"), F.col("ocr_pred"), F.col("gold")).alias("recommended_correct"))


@query("filtered_items", f"""WITH {Q.SCORED}, qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), {claims_sql('qa_asks')},
f AS (SELECT s.*, verdict = 'consistent' AS agree FROM scored s LEFT JOIN verdicts_ USING (qid))
SELECT 'all' AS mode, idx FROM f UNION ALL SELECT 'disagree', idx FROM f WHERE NOT agree
UNION ALL SELECT 'vlm_only', idx FROM f WHERE vlm_contains = 1 AND ocr_contains <> 1
UNION ALL SELECT 'ocr_only', idx FROM f WHERE ocr_contains = 1 AND vlm_contains <> 1
UNION ALL SELECT 'ocr_missing', idx FROM f WHERE NOT answer_in_ocr""")
def filtered_items(spark, sf):
    return I.filter_memberships(_full(spark, sf)).select("mode", "idx")


@query("usable_items", f"WITH {Q.QA} SELECT exp_id, count(*) AS n FROM qa WHERE idx % 3 <> 0 AND idx % 5 <> 0 GROUP BY exp_id")
def usable_items(spark, sf):
    s = _scored(spark, sf)
    s = s.withColumn("vlm_scores", F.when(F.col("idx") % 3 != 0, F.col("vlm_scores"))).withColumn(
        "ocr_scores", F.when(F.col("idx") % 5 != 0, F.col("ocr_scores")))
    return I.usable_items(s).groupBy("exp_id").agg(F.count("*").alias("n"))


@query("config_fingerprints", f"""WITH {Q.MSGS} SELECT sha256('{{"mode":"' || mode || '","page_cap":' || page_cap || ',"prompt_version":"' || prompt_version ||
  '","short":' || short || '}}') AS fingerprint, count(*) AS n FROM msgs WHERE role = 'assistant' GROUP BY 1""")
def config_fingerprints(spark, sf):
    m = X.messages(spark, sf).where("role = 'assistant'")
    f = S.config_fingerprint(**{c: F.col(c) for c in ("mode", "short", "prompt_version", "page_cap")})
    return m.groupBy(f.alias("fingerprint")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------- statistics
_SIDE = """SELECT exp_id, '{s}' AS side, count(*) AS n, round(avg({s}_em), 6) AS em, round(avg({s}_anls), 6) AS anls,
  round(avg({s}_contains), 6) AS contains, round(avg({s}_abstain), 6) AS abstain_rate, round(avg({s}_error), 6) AS error_rate FROM scored GROUP BY exp_id"""


@query("side_summary", f"WITH {Q.SCORED} {_SIDE.format(s='vlm')} UNION ALL {_SIDE.format(s='ocr')}")
def side_summary(spark, sf):
    return E.side_summary(_scored(spark, sf), RUN).select(
        "exp_id", "side", "n", *_r("em", "anls", "contains", "abstain_rate", "error_rate"))


def _rank(q, v="v", n="n"):
    return f"{v}[least({n} - 1, round_even({q}::DOUBLE * ({n} - 1), 0)::BIGINT) + 1]"


_LATENCY = f"""lat_ AS (SELECT exp_id, side, n, round(m, 6) AS mean, {_rank('0.5')} AS p50, {_rank('0.95')} AS p95 FROM (
  SELECT exp_id, side, count(*) AS n, avg(ms) AS m, list(ms ORDER BY ms) AS v FROM (
    SELECT exp_id, 'vlm' AS side, vlm_ms AS ms FROM qa UNION ALL SELECT exp_id, 'ocr', ocr_ms FROM qa) GROUP BY exp_id, side))"""


@query("latency", f"WITH {Q.QA}, {_LATENCY} SELECT * FROM lat_")
def latency(spark, sf):
    return E.latency(X.predictions(spark, sf), RUN).select("exp_id", "side", "n", *_r("mean"), "p50", "p95")


@query("nearest_rank", f"""SELECT event_type AS metric, n, {_rank('0.1')} AS p10, {_rank('0.5')} AS p50, {_rank('0.95')} AS p95 FROM (
  SELECT event_type, count(*) AS n, list(value ORDER BY value) AS v FROM events GROUP BY event_type)""")
def nearest_rank(spark, sf):
    return E.nearest_rank(X.telemetry(spark, sf), ["metric"], "value_ms", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).drop("mean")


# Weights by difference: a Poisson number for each binary digit of its count, of means up to 64 by the distribution function.
_BOOT = """boot_v AS (SELECT exp_id, vlm_anls - ocr_anls AS d, count(*) AS c, min(idx) AS id FROM scored GROUP BY exp_id, d),
boot_b AS (SELECT exp_id, d, id, b, 2.0e0 ** b AS mean FROM boot_v, range(0, 41) t(b) WHERE (c >> b) & 1 = 1),
boot_h AS (SELECT exp_id, r, d, b, mean, md5('0|' || r || '|' || id || '|' || b) AS h FROM boot_b, range(0, {n}) t(r)),
boot_u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0e0 AS u, ('0x' || substr(h, 9, 8))::BIGINT::DOUBLE / 4294967296.0e0 AS v FROM boot_h),
boot_t AS (SELECT b, list(f ORDER BY k) AS cdf FROM (SELECT b, k, sum(exp(k * ln(2.0e0 ** b) - 2.0e0 ** b - lgamma(k + 1))) OVER (PARTITION BY b ORDER BY k) AS f
  FROM range(0, 7) x(b), range(0, 220) y(k)) GROUP BY b),
boot_z AS (SELECT exp_id, r, d, mean, boot_u.b, u, cdf, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS z FROM boot_u LEFT JOIN boot_t ON boot_u.b = boot_t.b),
boot_w AS (SELECT exp_id, r, d, CASE WHEN b < 7 THEN len(list_filter(cdf, lambda x: x < u))
  ELSE greatest(0, floor(mean + sqrt(mean) * z + (z * z - 1) / 6 + 0.5)) END AS w FROM boot_z),
boot_m AS (SELECT exp_id, r, sum(w * d) / sum(w) AS mean FROM boot_w GROUP BY exp_id, r),
boot_ AS (SELECT exp_id, round(diff, 6) AS diff, round(v[{lo} + 1], 6) AS ci_low, round(v[{hi} + 1], 6) AS ci_high FROM
  (SELECT exp_id, list(mean ORDER BY mean) AS v FROM boot_m GROUP BY exp_id) JOIN
  (SELECT exp_id, avg(vlm_anls - ocr_anls) AS diff FROM scored GROUP BY exp_id) USING (exp_id))"""
_BOOT = _BOOT.format(n=1000, lo=25, hi=975)

# A Poisson number of mean 1 for every item and replicate.
_ITEM_BOOT = """boot_u AS (SELECT exp_id, r, vlm_anls - ocr_anls AS d,
    ('0x' || substr(md5('0|' || r || '|' || idx), 1, 8))::BIGINT::DOUBLE / 4294967296.0e0 AS u FROM scored, range(0, {n}) t(r)),
boot_w AS (SELECT *, len(list_filter([0.36787944117144233e0, 0.7357588823428847e0, 0.9196986029286058e0, 0.9810118431238462e0, 0.9963401531726563e0,
  0.9994058151824183e0, 0.9999167588507119e0, 0.9999897508033253e0, 0.999998874797402e0, 0.9999998885745217e0, 0.9999999899522336e0, 0.9999999991683892e0],
  lambda c: u > c)) AS w FROM boot_u),
boot_m AS (SELECT exp_id, r, sum(w * d) / sum(w) AS mean FROM boot_w GROUP BY exp_id, r),
boot_ AS (SELECT exp_id, round(diff, 6) AS diff, round(v[{lo} + 1], 6) AS ci_low, round(v[{hi} + 1], 6) AS ci_high FROM
  (SELECT exp_id, list(mean ORDER BY mean) AS v FROM boot_m GROUP BY exp_id) JOIN
  (SELECT exp_id, avg(vlm_anls - ocr_anls) AS diff FROM scored GROUP BY exp_id) USING (exp_id))"""
_BOOT_200, _BOOT_1000 = _ITEM_BOOT.format(n=200, lo=5, hi=195), _ITEM_BOOT.format(n=1000, lo=25, hi=975)


@query("paired_bootstrap", f"WITH {Q.SCORED}, {_BOOT_1000} SELECT * FROM boot_")
def paired_bootstrap(spark, sf):
    b = E.paired_bootstrap(_scored(spark, sf), RUN, "idx", F.col("vlm_scores.anls"), F.col("ocr_scores.anls"))
    return b.select("exp_id", *_r("diff", "ci_low", "ci_high"))


@query("poisson_bootstrap", f"WITH {Q.SCORED}, {_BOOT_200} SELECT * FROM boot_")
def poisson_bootstrap(spark, sf):
    """With 200 replicates."""
    b = E.paired_bootstrap(_scored(spark, sf), RUN, "idx", F.col("vlm_scores.anls"), F.col("ocr_scores.anls"), n=200)
    return b.select("exp_id", *_r("diff", "ci_low", "ci_high"))


_MC = """mc_c AS (SELECT exp_id, count(*) FILTER (vlm_em = 1 AND ocr_em <> 1) AS a_only, count(*) FILTER (ocr_em = 1 AND vlm_em <> 1) AS b_only
  FROM scored GROUP BY exp_id),
mc_ AS (SELECT exp_id, a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 1.0e0 ELSE round(least(1.0e0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
  lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0e0))))), 9) END AS p_value FROM mc_c)"""


@query("mcnemar", f"WITH {Q.SCORED}, {_MC} SELECT * FROM mc_")
def mcnemar(spark, sf):
    m = E.mcnemar(_scored(spark, sf), RUN, F.col("vlm_scores.em") == 1, F.col("ocr_scores.em") == 1)
    return m.select("exp_id", "a_only", "b_only", *_r("p_value", digits=9))


_AGREE = f"qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), {claims_sql('qa_asks')}"
_RATES = """rates_ AS (SELECT exp_id, round(avg(answer_in_ocr::INT), 6) AS answer_coverage,
  round(avg((verdict <> 'consistent')::INT), 6) AS disagreement_rate,
  count(*) FILTER (NOT answer_in_ocr AND vlm_contains = 1) AS loss_cases FROM scored LEFT JOIN verdicts_ USING (qid) GROUP BY exp_id)"""


@query("coverage_rates", f"WITH {Q.SCORED}, {_AGREE}, {_RATES} SELECT * FROM rates_")
def coverage_rates(spark, sf):
    """Answer coverage, disagreement rate, loss cases."""
    return E.coverage_rates(_full(spark, sf), RUN).select("exp_id", *_r("answer_coverage", "disagreement_rate"), "loss_cases")


@query("by_type", f"""WITH {Q.SCORED} SELECT exp_id, type, count(*) AS n, round_even(avg(vlm_anls), 4) AS vlm_anls, round_even(avg(ocr_anls), 4) AS ocr_anls
  FROM (SELECT exp_id, unnest(types) AS type, vlm_anls, ocr_anls FROM scored) GROUP BY exp_id, type""")
def by_type(spark, sf):
    return E.by_type(_scored(spark, sf), RUN)


_AUROC = """SELECT exp_id, CASE WHEN count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0 THEN
  round_even((SELECT sum(CASE WHEN p.s > q.s THEN 1.0e0 WHEN p.s = q.s THEN 0.5e0 ELSE 0.0e0 END) FROM {t} p JOIN {t} q ON p.exp_id = q.exp_id AND p.ok AND NOT q.ok
    WHERE p.exp_id = {t}.exp_id) / (count(*) FILTER (ok) * count(*) FILTER (NOT ok)), 4) END AS {name} FROM {t} GROUP BY exp_id"""
_KNOWN = "SELECT exp_id, idx, trust AS s, recommended_correct AS ok, agree FROM rated_ WHERE trust IS NOT NULL AND recommended_correct IS NOT NULL"


@query("auroc", f"WITH {Q.RATED}, k_ AS ({_KNOWN}) {_AUROC.format(t='k_', name='auroc')}")
def auroc(spark, sf):
    r = X.rated(spark, sf).where("trust IS NOT NULL AND recommended_correct IS NOT NULL")
    return E.auroc(r, RUN, F.col("trust"), F.col("recommended_correct"))


@query("risk_coverage", f"""WITH {Q.RATED}, k_ AS ({_KNOWN}),
o_ AS (SELECT exp_id, ok, row_number() OVER (PARTITION BY exp_id ORDER BY s DESC, idx) AS rn, count(*) OVER (PARTITION BY exp_id) AS n FROM k_),
c_ AS (SELECT *, greatest(1, round_even(c * n, 0))::BIGINT AS k FROM o_, (SELECT unnest([0.25e0, 0.5e0, 0.75e0, 1.0e0]) AS c))
SELECT exp_id, c AS coverage, k AS n, round_even(count(*) FILTER (ok AND rn <= k) / k::DOUBLE, 4) AS accuracy FROM c_ GROUP BY exp_id, c, k""")
def risk_coverage(spark, sf):
    r = X.rated(spark, sf).where("trust IS NOT NULL AND recommended_correct IS NOT NULL")
    return E.risk_coverage(r, RUN)


@query("selective", f"""WITH {Q.RATED}, k_ AS ({_KNOWN}), g_ AS (SELECT exp_id, idx, CASE WHEN agree THEN 1.0e0 ELSE 0.0e0 END AS s, ok FROM k_),
a_ AS ({_AUROC.format(t='k_', name='auroc_trust')}), b_ AS ({_AUROC.format(t='g_', name='auroc_agreement')})
SELECT exp_id, count(*) FILTER (trust IS NOT NULL AND recommended_correct IS NOT NULL) AS n, count(*) FILTER (trust_level IN ('unknown', 'not rated')) AS unrated,
  round_even(avg(recommended_correct::INT) FILTER (trust IS NOT NULL), 4) AS accuracy, any_value(auroc_trust) AS auroc_trust, any_value(auroc_agreement) AS auroc_agreement
FROM rated_ JOIN a_ USING (exp_id) JOIN b_ USING (exp_id) GROUP BY exp_id""")
def selective(spark, sf):
    return E.selective(X.rated(spark, sf), RUN)


@query("named_winner", f"""WITH {Q.SCORED}, {_BOOT} SELECT exp_id, CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN 'none' WHEN diff > 0 THEN 'vlm' ELSE 'ocr' END AS winner FROM boot_""")
def named_winner(spark, sf):
    b = E.bootstrap_by_difference(_scored(spark, sf), RUN, "idx", F.col("vlm_scores.anls"), F.col("ocr_scores.anls"))
    return E.named_winner(b).select("exp_id", "winner")


@query("telemetry_summary", f"""SELECT event_type AS metric, n, round_even(m, 1) AS mean, round_even({_rank('0.5')}, 1) AS p50, round_even({_rank('0.95')}, 1) AS p95
  FROM (SELECT event_type, count(*) AS n, sum(value) / count(*) AS m, list(value ORDER BY value) AS v FROM events GROUP BY event_type)""")
def telemetry_summary(spark, sf):
    return E.telemetry_summary(X.telemetry(spark, sf))


@query("newest_telemetry", "SELECT event_id, event_type AS metric, value AS value_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_telemetry(spark, sf):
    return E.newest_events(X.telemetry(spark, sf)).select("event_id", "metric", "value_ms")


@query("run_progress", f"""WITH {Q.QA} SELECT exp_id, count(*) AS total, count(*) FILTER (vlm_pred IS NOT NULL AND exp_id <> 'EXP-0002') AS done,
  CASE WHEN count(*) FILTER (vlm_pred IS NOT NULL AND exp_id <> 'EXP-0002') >= count(*) THEN 'done'
    WHEN count(*) FILTER (vlm_pred IS NOT NULL AND exp_id <> 'EXP-0002') > 0 THEN 'running' ELSE 'idle' END AS status FROM qa GROUP BY exp_id""")
def run_progress(spark, sf):
    p = X.predictions(spark, sf)
    return E.run_progress(p, p.where("vlm_pred IS NOT NULL AND exp_id <> 'EXP-0002'"), RUN)


_WIDE = ", ".join(f"round(avg({s}_{c}), 6) AS {s}_{o}" for s in ("vlm", "ocr") for c, o in (
    ("em", "em"), ("anls", "anls"), ("contains", "contains"), ("abstain", "abstain_rate"), ("error", "error_rate")))
_WIDE_LAT = ", ".join(f"max({c}) FILTER (side = '{s}') AS {s}_ms_{c}" for s in ("vlm", "ocr") for c in ("mean", "p50", "p95"))


@query("experiment_report", f"""WITH {Q.SCORED}, {_LATENCY}, {_BOOT}, {_MC}, {_AGREE}, {_RATES},
w_ AS (SELECT exp_id, count(*) AS n, {_WIDE} FROM scored GROUP BY exp_id), l_ AS (SELECT exp_id, {_WIDE_LAT} FROM lat_ GROUP BY exp_id)
SELECT *, CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN 'none' WHEN diff > 0 THEN 'vlm' ELSE 'ocr' END AS winner
FROM w_ JOIN l_ USING (exp_id) JOIN boot_ USING (exp_id) JOIN mc_ USING (exp_id) JOIN rates_ USING (exp_id)""")
def experiment_report(spark, sf):
    r = E.experiment_report(_full(spark, sf), RUN)
    return r.select(*[F.round(f.name, 9 if f.name == "p_value" else 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name
                      for f in r.schema.fields])
