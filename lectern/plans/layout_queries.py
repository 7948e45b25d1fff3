"""Lines, evidence, trust."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import claims as C
from ..operators import layout as L
from ..operators import support as P
from . import fixtures as X
from . import sqlparts as Q
from .claim_queries import claims_sql
from .registry import query
from .retrieval_queries import CARD, _asks, near_sql

PAGE = ["doc_id"]


def _box(col):
    return F.array_join(F.transform(col, lambda v: F.round(v * 10000, 0).cast("long").cast("string")), ",")


def _sqlbox(parts):
    return " || ',' || ".join(f"round(({p}) * 10000, 0)::BIGINT" for p in parts)


@query("reading_order", f"""WITH RECURSIVE {Q.LINES}, s_ AS (SELECT *, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, x0, line_no) AS rn FROM lines_),
m_ AS (SELECT doc_id, median(greatest(y1 - y0, 1.0e0)) AS med FROM lines_ GROUP BY doc_id),
w_ AS (SELECT doc_id, rn, cy AS s, 1 AS n, 0 AS line FROM s_ WHERE rn = 1
  UNION ALL SELECT s_.doc_id, s_.rn, CASE WHEN abs(s_.cy - w_.s / w_.n) > 0.6e0 * med THEN s_.cy ELSE w_.s + s_.cy END,
    CASE WHEN abs(s_.cy - w_.s / w_.n) > 0.6e0 * med THEN 1 ELSE w_.n + 1 END, w_.line + CASE WHEN abs(s_.cy - w_.s / w_.n) > 0.6e0 * med THEN 1 ELSE 0 END
  FROM w_ JOIN s_ ON s_.doc_id = w_.doc_id AND s_.rn = w_.rn + 1 JOIN m_ ON m_.doc_id = w_.doc_id),
g_ AS (SELECT s_.doc_id, line, x0, text, s_.rn, CASE WHEN x0 - lag(x1) OVER p > 2.5e0 * med THEN ' | ' WHEN lag(x1) OVER p IS NOT NULL THEN ' ' ELSE '' END AS sep
  FROM s_ JOIN w_ USING (doc_id, rn) JOIN m_ USING (doc_id) WINDOW p AS (PARTITION BY s_.doc_id, line ORDER BY x0, s_.rn)),
l_ AS (SELECT doc_id, line, string_agg(sep || text, '' ORDER BY x0, rn) AS t FROM g_ GROUP BY doc_id, line)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l_ GROUP BY doc_id""")
def reading_order(spark, sf):
    return L.lines_to_text(X.ocr_lines(spark, sf), PAGE)


@query("polygon_boxes", f"WITH {Q.LINES} SELECT doc_id, line_no, {_sqlbox(['x0 - 3', 'y0 - 2', 'x1', 'y1 + 1'])} AS box FROM lines_")
def polygon_boxes(spark, sf):
    pts = F.array(F.array("x0", "y0"), F.array("x1", F.col("y0") - 2), F.array("x1", F.col("y1") + 1), F.array(F.col("x0") - 3, "y1"))
    return X.ocr_lines(spark, sf).select("doc_id", "line_no", _box(G.poly_to_box(pts)).alias("box"))


LAYOUT = f"""{Q.LINES}, pg_ AS (SELECT doc_id, median(greatest(y1 - y0, 1.0e0)) AS med, greatest(max(x1), 1.0e0) AS w, greatest(max(y1), 1.0e0) AS h FROM lines_ GROUP BY doc_id),
nb_ AS (SELECT a.doc_id, a.line_no, count(*) FILTER (abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) < 0.6e0 * med) AS band,
  count(*) FILTER (abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) >= 0.6e0 * med AND abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) < 3 * med) AS above
  FROM lines_ a JOIN lines_ b USING (doc_id) JOIN pg_ USING (doc_id) GROUP BY ALL),
lay_ AS (SELECT l.*, med, w, h, CASE WHEN band >= 3 AND above >= 3 THEN 'table' WHEN band >= 2 THEN 'form' ELSE 'text' END AS layout, l.y1 - l.y0 < 0.75e0 * med AS small,
  round_even(x0 / w, 4) AS bx0, round_even(y0 / h, 4) AS by0, round_even(x1 / w, 4) AS bx1, round_even(y1 / h, 4) AS by1
  FROM lines_ l JOIN nb_ USING (doc_id, line_no) JOIN pg_ USING (doc_id))"""
_LBOX = ["bx0", "by0", "bx1", "by1"]


@query("line_layout", f"WITH {LAYOUT} SELECT doc_id, line_no, layout, small, {_sqlbox(_LBOX)} AS box FROM lay_")
def line_layout(spark, sf):
    return L.with_layout(X.ocr_lines(spark, sf), PAGE).select("doc_id", "line_no", "layout", "small", _box(F.col("box")).alias("box"))


@query("normalised_boxes", f"WITH {Q.LINES} SELECT doc_id, line_no, {_sqlbox(['round_even(greatest(0.0e0, least(1.0e0, ' + v + ' / ' + d + ')), 4)' for v, d in (('x0', '1700.0e0'), ('y0', '2200.0e0'), ('x1', '1700.0e0'), ('y1', '2200.0e0'))])} AS box FROM lines_")
def normalised_boxes(spark, sf):
    b = G.normalise_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(1700.0), F.lit(2200.0))
    return X.ocr_lines(spark, sf).select("doc_id", "line_no", _box(b).alias("box"))


@query("mean_confidence", f"WITH {Q.LINES} SELECT doc_id, round(avg(score), 6) AS mean_conf, count(*) AS n_lines FROM lines_ GROUP BY doc_id")
def mean_confidence(spark, sf):
    return L.mean_confidence(X.ocr_lines(spark, sf), PAGE).withColumn("mean_conf", F.round("mean_conf", 6))


@query("regions", f"""WITH {LAYOUT}, r_ AS (SELECT doc_id, 0 AS ord, 'image' AS kind, 0.0e0 AS a, 0.0e0 AS b, 0.5e0 AS c, 0.4e0 AS d FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 1, 'table', 0.1e0, 0.2e0, 1.0e0, 0.7e0 FROM documents WHERE doc_id % 3 = 0)
SELECT l.doc_id, line_no, coalesce(arg_max(kind, ord) FILTER (kind IS NOT NULL), any_value(layout)) AS kind FROM lay_ l
  LEFT JOIN r_ ON r_.doc_id = l.doc_id AND (bx0 + bx1) / 2 BETWEEN a AND c AND (by0 + by1) / 2 BETWEEN b AND d GROUP BY l.doc_id, line_no""")
def regions(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id")
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    rects = d.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("ord"), F.lit("image").alias("kind"), box(0, 0, .5, .4).alias("rect")).unionByName(
        d.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("ord"), F.lit("table").alias("kind"), box(.1, .2, 1, .7).alias("rect")))
    return L.region_of(L.with_layout(X.ocr_lines(spark, sf), PAGE), rects, PAGE)


def locate_sql(asks: str) -> str:
    """CTEs from asks(k, g, answer): result loc_(k, g, line_no, misreads, merged). Every key is compared with every word of its page."""
    return f"""{asks}_t AS (SELECT k, g, answer, CASE WHEN len({Q.keys('answer')}) > 0 THEN {Q.keys('answer')} ELSE list_transform({Q.tokens('answer')}, lambda t: ltrim(t, '$')) END AS terms FROM {asks}),
lq_ AS (SELECT k, g, unnest(terms) AS term FROM {asks}_t),
lt_ AS (SELECT doc_id AS g, line_no, unnest({Q.vocab('text')}) AS token FROM lines_ WHERE doc_id IN (SELECT g FROM {asks})),
nl_ AS (SELECT DISTINCT g, term AS token FROM lq_), nv_ AS (SELECT DISTINCT g, token FROM lt_),
{near_sql('nl_', 'nv_', '0.75e0')},
nb2_ AS (SELECT g, line_no, a, arg_min(b, (-kind, -ratio, b)) AS read_as FROM nk_ JOIN lt_ USING (g) WHERE kind IS NOT NULL AND lt_.token = b GROUP BY g, line_no, a),
hit_ AS (SELECT k, lq_.g, line_no, term, 1.0e0 AS v, NULL::VARCHAR AS read_as FROM lq_ JOIN lt_ ON lt_.g = lq_.g AND lt_.token = term
  UNION ALL SELECT k, lq_.g, n.line_no, term, 0.75e0, read_as FROM lq_ JOIN nb2_ n ON n.g = lq_.g AND n.a = term
    WHERE NOT EXISTS (SELECT 1 FROM lt_ WHERE lt_.g = lq_.g AND lt_.line_no = n.line_no AND lt_.token = term)),
pl_ AS (SELECT k, h.g, h.line_no, sum(v) AS hits, string_agg(term || '>' || read_as, '|' ORDER BY term) FILTER (read_as IS NOT NULL) AS misreads FROM hit_ h GROUP BY ALL),
bl_ AS (SELECT * FROM (SELECT pl_.*, row_number() OVER (PARTITION BY k, pl_.g ORDER BY hits DESC, score DESC, pl_.line_no) AS rn
  FROM pl_ JOIN lines_ l ON l.doc_id = pl_.g AND l.line_no = pl_.line_no) WHERE rn = 1),
ok_ AS (SELECT t.k, t.g, t.answer, t.terms, b.line_no, b.misreads, coalesce(b.hits / len(t.terms) >= 0.5e0, false) AS ok FROM {asks}_t t LEFT JOIN bl_ b ON b.k = t.k AND b.g = t.g),
gl_ AS (SELECT k, g, min(l.line_no) AS line_no FROM ok_ JOIN lines_ l ON l.doc_id = g WHERE NOT ok AND len(terms) > 0 AND length({Q.alnum('answer')}) >= 4
  AND contains({Q.alnum('l.text')}, {Q.alnum('answer')}) GROUP BY k, g),
loc_ AS (SELECT k, g, line_no, coalesce(misreads, '') AS misreads, false AS merged FROM ok_ WHERE ok
  UNION ALL SELECT k, g, line_no, '', true FROM gl_)"""


@query("located_answers", f"""WITH RECURSIVE {Q.QA}, {LAYOUT}, la_ AS (SELECT idx AS k, doc_id AS g, gold[1] AS answer FROM qa), {locate_sql('la_')}
SELECT k AS idx, loc_.line_no, text, round_even(score, 3) AS conf, layout, small, misreads, merged, {_sqlbox(_LBOX)} AS box
FROM loc_ JOIN lay_ ON lay_.doc_id = g AND lay_.line_no = loc_.line_no""")
def located_answers(spark, sf):
    p = X.predictions(spark, sf).select("idx", "doc_id", F.col("gold")[0].alias("answer"))
    loc = L.locate_answer(p, X.ocr_lines(spark, sf), ["idx"], PAGE)
    return loc.select("idx", "line_no", "text", "conf", "layout", "small", F.array_join(F.array_sort("misreads"), "|").alias("misreads"), "merged",
                      _box(F.col("box")).alias("box"))


def _binder(spark, sf):
    """Documents of four pages."""
    return X.ocr_lines(spark, sf).withColumn("doc", F.floor(F.col("doc_id") / 4)).withColumn("page", F.col("doc_id") % 4)


def _binder_asks(spark, sf):
    return X.predictions(spark, sf).select("idx", F.floor(F.col("doc_id") / 4).alias("doc"), F.col("vlm_pred").alias("answer"))


_EVID = f"""{Q.QA}, {Q.LINES}, ek_ AS (SELECT idx, doc_id // 4 AS doc, unnest(list_distinct({Q.keys('vlm_pred')})) AS key FROM qa),
ev_ AS (SELECT doc_id // 4 AS doc, doc_id % 4 AS page, line_no, score, list_transform({Q.tokens('text')}, lambda t: ltrim(t, '$')) AS v FROM lines_),
eh_ AS (SELECT idx, page, line_no, score, count(*) AS hits FROM ek_ JOIN ev_ USING (doc) WHERE list_contains(v, key) GROUP BY ALL),
er_ AS (SELECT *, first_value(page) OVER (PARTITION BY idx ORDER BY hits DESC, score DESC, page, line_no) AS best FROM eh_)"""


@query("ocr_evidence", f"""WITH {_EVID} SELECT idx, page, rank, line_no, hits, score FROM (SELECT idx, page, line_no, hits, round_even(score, 3) AS score,
  (row_number() OVER (PARTITION BY idx ORDER BY hits DESC, er_.score DESC, line_no) - 1)::INT AS rank FROM er_ WHERE page = best) WHERE rank < 3""")
def ocr_evidence(spark, sf):
    return L.ocr_evidence(_binder_asks(spark, sf), _binder(spark, sf), ["idx"], "doc", "page")


_CONTENT = Q.content_of(Q.tokens('vlm_pred'))


@query("reference_evidence", f"""WITH {Q.QA}, {Q.LINES}, rc_ AS (SELECT idx, doc_id // 4 AS doc, {_CONTENT} AS c FROM qa),
rk_ AS (SELECT idx, doc, ltrim(t, '$') AS key, min(o) AS o FROM (SELECT idx, doc, unnest(c) AS t, generate_subscripts(c, 1) AS o FROM rc_) GROUP BY ALL),
rh_ AS (SELECT DISTINCT idx, doc_id % 4 AS page, line_no, key, o FROM rk_ JOIN lines_ ON doc_id // 4 = doc AND length(key) >= 2 AND contains(lower(text), key)),
rp_ AS (SELECT idx, page, count(DISTINCT key) AS n FROM rh_ GROUP BY ALL),
rb_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, page) AS rn FROM rp_) WHERE rn = 1),
rt_ AS (SELECT * FROM (SELECT idx, page, n AS keys_printed, (row_number() OVER (PARTITION BY idx ORDER BY o, line_no, key) - 1)::INT AS rank, line_no, key
  FROM rb_ JOIN rh_ USING (idx, page)) WHERE rank < 4),
rz_ AS (SELECT doc_id, greatest(max(x1), 1.0e0) AS w, greatest(max(y1), 1.0e0) AS h FROM lines_ GROUP BY doc_id)
SELECT idx, rt_.page, keys_printed, rank, rt_.line_no, key, {_sqlbox([f'round_even({c} / {s}, 4)' for c, s in (('x0', 'w'), ('y0', 'h'), ('x1', 'w'), ('y1', 'h'))])} AS box
FROM rt_ JOIN qa USING (idx) JOIN lines_ l ON l.doc_id = qa.doc_id // 4 * 4 + rt_.page AND l.line_no = rt_.line_no JOIN rz_ ON rz_.doc_id = l.doc_id""")
def reference_evidence(spark, sf):
    e = L.reference_evidence(_binder_asks(spark, sf), _binder(spark, sf), ["idx"], "doc", "page")
    return e.withColumn("box", _box(F.col("box")))


_OVERLAP = f"""{LAYOUT}, bx_ AS (SELECT doc_id, line_no, bx0 AS a0, by0 AS a1, bx1 AS a2, by1 AS a3, bx0 + (line_no % 7) / 50.0e0 AS b0, by0 + (doc_id % 5) / 60.0e0 AS b1,
  bx1 + (line_no % 4) / 30.0e0 AS b2, by1 + (doc_id % 5) / 40.0e0 AS b3 FROM lay_),
iu_ AS (SELECT *, greatest(0.0e0, least(a2, b2) - greatest(a0, b0)) * greatest(0.0e0, least(a3, b3) - greatest(a1, b1)) AS inter FROM bx_),
io_ AS (SELECT *, CASE WHEN (a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter > 0 THEN inter / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter) ELSE 0.0e0 END AS iou,
  (a0 + a2) / 2 BETWEEN b0 - 0.02e0 AND b2 + 0.02e0 AND (a1 + a3) / 2 BETWEEN b1 - 0.02e0 AND b3 + 0.02e0 AS a_in_b,
  (b0 + b2) / 2 BETWEEN a0 - 0.02e0 AND a2 + 0.02e0 AND (b1 + b3) / 2 BETWEEN a1 - 0.02e0 AND a3 + 0.02e0 AS b_in_a FROM iu_)"""


def _shifted(spark, sf):
    l = L.with_layout(X.ocr_lines(spark, sf), PAGE)
    b = lambda i: F.get("box", F.lit(i))
    other = F.array(b(0) + (F.col("line_no") % 7) / 50.0, b(1) + (F.col("doc_id") % 5) / 60.0, b(2) + (F.col("line_no") % 4) / 30.0, b(3) + (F.col("doc_id") % 5) / 40.0)
    return l.select("doc_id", "line_no", "box", other.alias("other"))


@query("box_overlap", f"WITH {_OVERLAP} SELECT doc_id, line_no, round(iou, 6) AS iou, a_in_b FROM io_")
def box_overlap(spark, sf):
    return _shifted(spark, sf).select("doc_id", "line_no", F.round(G.iou(F.col("box"), F.col("other")), 6).alias("iou"),
                                      G.center_in(F.col("box"), F.col("other")).alias("a_in_b"))


@query("same_place", f"""WITH {_OVERLAP} SELECT doc_id, CASE max(CASE WHEN f.page = o.line_no % 3 AND (iou >= 0.2e0 OR a_in_b OR b_in_a) THEN 3 WHEN f.page = o.line_no % 3 THEN 2 ELSE 1 END)
  WHEN 3 THEN 'same place' WHEN 2 THEN 'same page' ELSE 'different pages' END AS place
FROM (SELECT doc_id, min(line_no) % 3 AS page, min(line_no) AS first FROM lines_ GROUP BY doc_id) f JOIN (
  SELECT b.doc_id, b.line_no, CASE WHEN (x.a2 - x.a0) * (x.a3 - x.a1) + (b.b2 - b.b0) * (b.b3 - b.b1) - i > 0 THEN i / ((x.a2 - x.a0) * (x.a3 - x.a1) + (b.b2 - b.b0) * (b.b3 - b.b1) - i) ELSE 0.0e0 END AS iou,
    (x.a0 + x.a2) / 2 BETWEEN b.b0 - 0.02e0 AND b.b2 + 0.02e0 AND (x.a1 + x.a3) / 2 BETWEEN b.b1 - 0.02e0 AND b.b3 + 0.02e0 AS a_in_b,
    (b.b0 + b.b2) / 2 BETWEEN x.a0 - 0.02e0 AND x.a2 + 0.02e0 AND (b.b1 + b.b3) / 2 BETWEEN x.a1 - 0.02e0 AND x.a3 + 0.02e0 AS b_in_a
  FROM bx_ b JOIN bx_ x ON x.doc_id = b.doc_id AND x.line_no = (SELECT min(line_no) FROM lines_ z WHERE z.doc_id = b.doc_id),
    LATERAL (SELECT greatest(0.0e0, least(x.a2, b.b2) - greatest(x.a0, b.b0)) * greatest(0.0e0, least(x.a3, b.b3) - greatest(x.a1, b.b1)) AS i)) o USING (doc_id) GROUP BY doc_id""")
def same_place(spark, sf):
    """Is the page's first box where the other reader's boxes are?"""
    s = _shifted(spark, sf)
    first = s.groupBy("doc_id").agg(F.min_by("box", "line_no").alias("a_box"), (F.min("line_no") % 3).alias("a_page"))
    others = s.select("doc_id", (F.col("line_no") % 3).alias("b_page"), F.col("other").alias("b_box"))
    return L.same_place(first, PAGE, "a_page", "a_box", others, "b_page", "b_box")


def _grow(lo, hi, least):
    return (f"CASE WHEN {hi} - {lo} + 0.04e0 < {least} THEN ({lo} + {hi}) / 2 - {least} / 2 ELSE {lo} - 0.02e0 END",
            f"CASE WHEN {hi} - {lo} + 0.04e0 < {least} THEN ({lo} + {hi}) / 2 + {least} / 2 ELSE {hi} + 0.02e0 END")


def _r4(x):
    """Four places, halves to even, in whole numbers: halves are common here."""
    n = f"round(({x}) * 100000000.0e0, 0)::BIGINT"
    return f"({n} // 10000 + CASE WHEN {n} % 10000 > 5000 OR ({n} % 10000 = 5000 AND {n} // 10000 % 2 = 1) THEN 1 ELSE 0 END) / 10000.0e0"


_GX, _GY = _grow("bx0", "bx1", "0.25e0"), _grow("by0", "by1", "0.05e0")


@query("expanded_regions", f"""WITH {LAYOUT}, b_ AS (SELECT doc_id, line_no, {', '.join(_LBOX)} FROM lay_),
e_ AS (SELECT doc_id, line_no, {_GX[0]} AS x0, {_GX[1]} AS x1, {_GY[0]} AS y0, {_GY[1]} AS y1 FROM b_),
d_ AS (SELECT *, greatest(0.0e0, -x0) - greatest(0.0e0, x1 - 1) AS dx, greatest(0.0e0, -y0) - greatest(0.0e0, y1 - 1) AS dy FROM e_)
SELECT doc_id, line_no, {_r4('greatest(0.0e0, x0 + dx)')} AS x0, {_r4('greatest(0.0e0, y0 + dy)')} AS y0, {_r4('least(1.0e0, x1 + dx)')} AS x1, {_r4('least(1.0e0, y1 + dy)')} AS y1 FROM d_""")
def expanded_regions(spark, sf):
    r = L.with_layout(X.ocr_lines(spark, sf), PAGE).select("doc_id", "line_no", G.expand_region(F.col("box")).alias("r"))
    return r.select("doc_id", "line_no", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


_J = lambda x: f"array_to_string(list_sort({x}), '|')"


@query("arbitrated", f"""WITH {Q.QA}, k_ AS (SELECT idx, list_distinct({Q.keys('vlm_pred')}) AS kv, list_distinct({Q.keys('ocr_pred')}) AS ko, {Q.vocab('ocr_text')} AS seen FROM qa),
m_ AS (SELECT idx, list_filter(kv, lambda t: NOT list_contains(ko, t) AND NOT list_contains(seen, t)) AS mv, list_filter(ko, lambda t: NOT list_contains(kv, t) AND NOT list_contains(seen, t)) AS mo,
  list_filter(kv, lambda t: NOT list_contains(ko, t) AND list_contains(seen, t)) AS cv, list_filter(ko, lambda t: NOT list_contains(kv, t) AND list_contains(seen, t)) AS co FROM k_)
SELECT idx, CASE WHEN len(mo) > 0 AND len(mv) = 0 THEN 'vlm' WHEN len(mv) > 0 AND len(mo) = 0 THEN 'ocr' END AS supports, {_J('mv')} AS vlm_not_seen, {_J('mo')} AS ocr_not_seen,
  {_J('cv')} AS vlm_confirmed, {_J('co')} AS ocr_confirmed FROM m_""")
def arbitrated(spark, sf):
    a = X.predictions(spark, sf).select("idx", L.arbitrate(F.col("vlm_pred"), F.col("ocr_pred"), F.col("ocr_text")).alias("a"))
    return a.select("idx", "a.supports", *[F.array_join(f"a.{c}", "|").alias(c) for c in ("vlm_not_seen", "ocr_not_seen", "vlm_confirmed", "ocr_confirmed")])


_SURV = f"coalesce(ocr_pred <> '' AND NOT {Q.not_found('ocr_pred')} AND len({Q.keys('gold[1]')}) > 0 AND round_even(len(list_filter({Q.keys('gold[1]')}, lambda t: list_contains({Q.vocab('ocr_pred')}, t))) / len({Q.keys('gold[1]')})::DOUBLE, 3) >= 0.8e0, false)"


@query("surviving_answers", f"WITH {Q.QA} SELECT idx, {_SURV} AS survived FROM qa")
def surviving_answers(spark, sf):
    return X.predictions(spark, sf).select("idx", P.survives(F.col("gold")[0], F.col("ocr_pred")).alias("survived"))


@query("texts_without_evidence", f"""WITH {_EVID}, et_ AS (SELECT er_.idx, page, qa.doc_id // 4 * 4 + page AS src, l.text,
    row_number() OVER (PARTITION BY er_.idx ORDER BY hits DESC, er_.score DESC, er_.line_no) AS rank
  FROM er_ JOIN qa USING (idx) JOIN lines_ l ON l.doc_id = qa.doc_id // 4 * 4 + page AND l.line_no = er_.line_no WHERE page = best),
e_ AS (SELECT idx, page, src, list(text ORDER BY rank) AS ls FROM et_ WHERE rank <= 3 GROUP BY ALL)
SELECT idx, page, md5(replace(replace(replace({Q.DOCS_MISREAD}, ls[1], ''), coalesce(ls[2], chr(7)), ''), coalesce(ls[3], chr(7)), '')) AS text_md5
FROM e_ JOIN documents ON doc_id = src""")
def texts_without_evidence(spark, sf):
    asks, lines = _binder_asks(spark, sf), _binder(spark, sf)
    pages = X.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc"), (F.col("doc_id") % 4).alias("page"),
                                                   X.ocr_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = L.ocr_evidence(asks, lines, ["idx"], "doc", "page")
    return L.texts_without_evidence(found, asks, lines, pages, ["idx"], "doc", "page").select("idx", "page", F.md5("text").alias("text_md5"))


TRUST_IN = f"""{CARD}, qa_asks AS (SELECT qid, vlm_pred AS vlm, ocr_pred AS ocr FROM qa), {claims_sql('qa_asks')},
ti_ AS (SELECT c.*, v.verdict, CASE idx % 3 WHEN 0 THEN 'same place' WHEN 1 THEN 'different pages' END AS place,
  CASE idx % 5 WHEN 0 THEN 'vlm' WHEN 1 THEN 'ocr' END AS closer, CASE WHEN idx % 4 < 2 THEN idx % 4 = 0 END AS vlm_survived, CASE WHEN idx % 6 < 3 THEN idx % 6 = 1 END AS ocr_survived
  FROM card_ c LEFT JOIN verdicts_ v USING (qid)),
tr_ AS (SELECT *, CASE WHEN winner IN ('vlm', 'ocr') THEN winner WHEN closer IS NOT NULL THEN closer WHEN verdict = 'consistent' THEN 'vlm' END AS rec FROM ti_),
ts_ AS (SELECT *, CASE WHEN rec = 'vlm' THEN vlm_support ELSE ocr_support END AS sup, CASE WHEN rec = 'vlm' THEN vlm_survived ELSE ocr_survived END AS surv FROM tr_),
tt_ AS (SELECT *, CASE WHEN rec IS NOT NULL THEN round_even(greatest(0.0e0, least(1.0e0, 0.35e0
  + CASE WHEN verdict = 'consistent' THEN 0.35e0 WHEN verdict = 'partial' THEN 0.1e0 WHEN verdict IS NOT NULL THEN -0.25e0 ELSE 0 END
  + CASE WHEN has_ref AND sup IS NOT NULL THEN round_even(0.25e0 * sup - 0.1e0, 3) ELSE 0 END
  + CASE place WHEN 'same place' THEN 0.15e0 WHEN 'different pages' THEN -0.1e0 ELSE 0 END
  + CASE WHEN closer IS NULL THEN 0 WHEN closer = rec THEN 0.15e0 ELSE -0.25e0 END
  + CASE WHEN surv IS NULL THEN 0 WHEN NOT surv THEN 0.1e0 ELSE -0.05e0 END)), 3) END AS trust FROM ts_)"""


def trust_inputs(spark, sf):
    card = P.scorecard(_asks(spark, sf)).withColumn("has_reference", F.col("idx") % 4 != 3)
    v = C.verdicts(X.predictions(spark, sf).select("qid", F.col("vlm_pred").alias("vlm"), F.col("ocr_pred").alias("ocr"))).select("qid", "verdict")
    i = F.col("idx")
    return card.join(v, "qid", "left").withColumns({
        "place": F.when(i % 3 == 0, "same place").when(i % 3 == 1, "different pages"), "closer": F.when(i % 5 == 0, "vlm").when(i % 5 == 1, "ocr"),
        "vlm_survived": F.when(i % 4 < 2, i % 4 == 0), "ocr_survived": F.when(i % 6 < 3, i % 6 == 1)})


_WHY = """array_to_string(list_filter([CASE WHEN verdict IN ('consistent', 'partial') THEN '+verdict' WHEN verdict IS NOT NULL THEN '-verdict' END,
  CASE WHEN has_ref AND sup IS NOT NULL THEN CASE WHEN round_even(0.25e0 * sup - 0.1e0, 3) >= 0 THEN '+support' ELSE '-support' END END,
  CASE place WHEN 'same place' THEN '+place' WHEN 'different pages' THEN '-place' END, CASE WHEN closer = rec THEN '+closer look' WHEN closer <> rec THEN '-closer look' END,
  CASE WHEN surv THEN '-ablation' WHEN NOT surv THEN '+ablation' END], lambda x: x IS NOT NULL), '|')"""


@query("trust", f"""WITH {Q.QA}, {TRUST_IN} SELECT idx, rec AS recommended, trust, CASE WHEN trust IS NULL THEN 'unknown' WHEN trust >= 0.75e0 THEN 'high' WHEN trust >= 0.5e0 THEN 'medium' ELSE 'low' END AS trust_level,
  CASE WHEN trust IS NULL THEN 'unsettled' ELSE {_WHY} END AS reasons FROM tt_""")
def trust(spark, sf):
    return L.trust(trust_inputs(spark, sf)).select("idx", "recommended", "trust", "trust_level", F.array_join("reasons", "|").alias("reasons"))


@query("not_rated", f"WITH {Q.ASKS} SELECT qid, NOT ({Q.short('vlm')} OR {Q.short('ocr')}) AS not_rated FROM asks_")
def not_rated(spark, sf):
    return X.asks(spark, sf).select("qid", L.not_rated(F.col("vlm"), F.col("ocr")).alias("not_rated"))


@query("box_replies", f"""WITH {LAYOUT} SELECT doc_id, line_no, CASE WHEN line_no % 4 <> 0 THEN (line_no % 3)::INT END AS page, CASE WHEN line_no % 4 <> 0 THEN
  least(x0, x1)::BIGINT || ',' || least(y0, y1)::BIGINT || ',' || greatest(x0, x1)::BIGINT || ',' || greatest(y0, y1)::BIGINT END AS box FROM lay_""")
def box_replies(spark, sf):
    n = lambda c: F.col(c).cast("long").cast("string")
    reply = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit('see {"bbox_2d": ['), n("x0"), F.lit(", oops}"))).otherwise(F.concat(
        F.lit('Here: [{"page": '), (F.col("line_no") % 3).cast("string"), F.lit(', "bbox_2d": ['), F.concat_ws(", ", n("x1"), n("y1"), n("x0"), n("y0")),
        F.lit(']}, {"page": 9, "bbox_2d": [1, 2, 3, 4]}]')))
    p = X.ocr_lines(spark, sf).select("doc_id", "line_no", G.parse_box_reply(reply).alias("p"))
    return p.select("doc_id", "line_no", "p.page", F.array_join(F.transform("p.box", lambda v: v.cast("long").cast("string")), ",").alias("box"))
