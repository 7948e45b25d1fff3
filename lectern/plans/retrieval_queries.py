"""Ranking, selection, support."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import similarity as M
from ..functions import text as T
from ..operators import retrieval as D
from ..operators import support as P
from . import fixtures as X
from . import sqlparts as Q
from .registry import query

_BM = f"""{Q.PAGES}, {Q.QUESTIONS},
tk AS (SELECT doc, page, regexp_extract_all(lower(layer_text), '[a-z0-9]+') AS t FROM pages_),
st AS (SELECT doc, count(*) AS n_pages, avg(len(t)) AS avgdl FROM tk GROUP BY doc),
tf AS (SELECT doc, page, dl, term, count(*) AS tf FROM (SELECT doc, page, len(t)::BIGINT AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT doc, term, count(*) AS df FROM tf GROUP BY ALL),
ix AS (SELECT tf.*, df.df, st.n_pages, st.avgdl, ln(1 + (n_pages - df + 0.5e0) / (df + 0.5e0)) AS idf FROM tf JOIN df USING (doc, term) JOIN st USING (doc)),
qt AS (SELECT qid, doc, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: NOT list_contains({Q.STOP}, t))) AS term FROM questions_),
sc AS (SELECT qid, doc, page, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 10) AS score FROM qt JOIN ix USING (doc, term) GROUP BY ALL),
rk0 AS (SELECT q.qid, p.doc, p.page, coalesce(score, 0.0e0) AS score FROM questions_ q JOIN pages_ p USING (doc) LEFT JOIN sc USING (qid, doc, page)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page) - 1 AS rank FROM rk0)"""


def _pages(spark, sf):
    return X.doc_pages(spark, sf).select("doc", "page", F.col("layer_text").alias("text"))


@query("bm25_index", f"WITH {_BM} SELECT doc, page, term, tf, dl, df, n_pages, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM ix")
def bm25_index(spark, sf):
    return D.bm25_index(_pages(spark, sf)).withColumns({c: S.rounded(F.col(c), 6) for c in ("avgdl", "idf")})


@query("bm25_rank", f"WITH {_BM} SELECT qid, doc, page, round(score, 4) AS score, rank FROM rk")
def bm25_rank(spark, sf):
    return D.bm25_rank(_pages(spark, sf), X.doc_questions(spark, sf)).withColumn("score", S.rounded(F.col("score"), 4))


@query("bm25_rank_sliced", f"WITH {_BM} SELECT qid, doc, page, round(score, 4) AS score, rank FROM rk")
def bm25_rank_sliced(spark, sf):
    """The ranking by counted scores on its own."""
    p, q = _pages(spark, sf), X.doc_questions(spark, sf)
    full = p.select("doc", "page").join(q.select("qid", "doc"), "doc").join(D.bm25_scores(p, q), ["qid", "doc", "page"], "left").na.fill(0.0, ["score"])
    return D.sliced_rank(full, ["qid", "doc"], "page").withColumn("score", S.rounded(F.col("score"), 4))


@query("selected_pages", f"WITH {_BM} SELECT qid, doc, page, round(score, 4) AS score, rank FROM rk WHERE rank < 6")
def selected_pages(spark, sf):
    return D.top_pages(_pages(spark, sf), X.doc_questions(spark, sf), 6).withColumn("score", S.rounded(F.col("score"), 4))


@query("page_policy", f"""WITH {_BM}, n_ AS (SELECT doc, count(*) AS n FROM pages_ GROUP BY doc)
SELECT qid, doc, page, n <= 6 OR rank < 6 AS vlm, n <= 6 OR rank < 6 AS ocr FROM rk JOIN n_ USING (doc)""")
def page_policy(spark, sf):
    return D.page_policy(_pages(spark, sf), X.doc_questions(spark, sf), False, 6, True)


@query("lexical_answers", f"""WITH {Q.PAGES}, {Q.QUESTIONS}, ql AS (SELECT qid, doc,
    list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: NOT list_contains({Q.STOP}, t))) AS q FROM questions_),
ln AS (SELECT doc, page, unnest(regexp_split_to_array(layer_text, '\\n+')) AS line, generate_subscripts(regexp_split_to_array(layer_text, '\\n+'), 1) AS pos FROM pages_),
s_ AS (SELECT qid, page, pos, trim(line) AS line, len(q) AS nq, len(list_intersect(q, regexp_extract_all(lower(line), '[a-z0-9]+'))) AS h FROM ql JOIN ln USING (doc)),
b_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h DESC, page, pos) AS rn FROM s_) WHERE rn = 1)
SELECT qid, CASE WHEN h > 0 THEN line ELSE '{Q.NF}' END AS answer, round(h / sqrt(nq), 6) AS score FROM b_""")
def lexical_answers(spark, sf):
    return D.lexical_answer(_pages(spark, sf), X.doc_questions(spark, sf), ["doc"]).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------------------------------ support
_LOOK = "[" + ", ".join(f"'{p}'" for p in M.SINGLE) + "]"


def _fold(x):
    for two, one in M.DIGRAPHS:
        x = f"replace({x}, '{two}', '{one}')"
    return x


def near_sql(left: str, vocab: str, cutoff: str, rule: str = "misreading") -> str:
    """CTEs: every pair of a group within two characters, its longest common subsequence row by row, then the rules.
    left(g, token), vocab(g, token); result near_(g, token, near, ratio)."""
    minlen = "AND length(l.token) >= 3" if rule == "misreading" else ""
    diff = lambda a, b: (f"list_filter(list_transform(range(1, length({a}) + 1), lambda i: {a}[i] || {b}[i]), lambda p: p[1] <> p[2])")
    looks = lambda d: f"list_bool_and(list_transform({d}, lambda p: list_contains({_LOOK}, p)))"
    fa, fb = _fold("a"), _fold("b")
    alike = (f"CASE WHEN length(a) = length(b) THEN coalesce({looks(diff('a', 'b'))}, true) WHEN length({fa}) = length({fb}) "
             f"THEN coalesce({looks(diff(fa, fb))}, true) ELSE false END")
    n_swaps = (f"CASE WHEN length(a) = length(b) THEN len({diff('a', 'b')}) WHEN length({fa}) = length({fb}) "
               f"THEN len({diff(fa, fb)}) + abs(length(a) - length(b)) ELSE 999 END")
    if rule == "misreading":
        kind = (f"CASE WHEN ({alike}) AND ({n_swaps}) <= greatest(2, length(a) // 2) THEN 1 WHEN ratio >= {cutoff} - 1e-12 "
                f"AND (NOT (regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]')) OR ({alike})) THEN 0 END")
    else:
        kind = f"CASE WHEN ratio >= {cutoff} THEN 0 END"
    return f"""np_ AS (SELECT DISTINCT l.g, l.token AS a, v.token AS b FROM {left} l JOIN {vocab} v ON l.g = v.g AND l.token <> v.token
  AND abs(length(l.token) - length(v.token)) <= 2 {minlen}),
lcs_ AS (SELECT g, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS r FROM np_
  UNION ALL SELECT g, a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN k = 1 THEN 0 WHEN b[k - 1] = a[i + 1] THEN greatest(r[k], r[k - 1] + 1) ELSE r[k] END))) FROM lcs_ WHERE i < length(a)),
nr_ AS (SELECT g, a, b, 2.0e0 * r[-1] / (length(a) + length(b)) AS ratio FROM lcs_ WHERE i = length(a)),
nk_ AS (SELECT *, {kind} AS kind FROM nr_),
near_ AS (SELECT g, a AS token, b AS near, ratio FROM (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY kind DESC, ratio DESC, b) AS rn
  FROM nk_ WHERE kind IS NOT NULL) WHERE rn = 1)"""


@query("near_tokens", f"""WITH RECURSIVE {Q.QA}, u0 AS (SELECT g, unnest({Q.keys('vlm_pred')}) AS token FROM (SELECT doc_id AS g, vlm_pred FROM qa)),
w0 AS (SELECT doc_id AS g, unnest({Q.vocab('ocr_text')}) AS token FROM qa),
l1 AS (SELECT u0.* FROM u0 WHERE NOT EXISTS (SELECT 1 FROM w0 WHERE w0.g = u0.g AND w0.token = u0.token)),
{near_sql('l1', 'w0', '0.75e0')} SELECT g AS doc_id, token, near, round(ratio, 6) AS ratio FROM near_""")
def near_tokens(spark, sf):
    p = X.predictions(spark, sf).select("doc_id", T.keys(F.col("vlm_pred")).alias("k"), T.vocab(F.col("ocr_text")).alias("v"))
    p = p.select("doc_id", F.array_except("k", "v").alias("left"), "v").where(F.size("left") > 0)
    return P.near_tokens(p, ["doc_id"], "left", "v").withColumn("ratio", F.round("ratio", 6))


@query("text_support", f"""WITH RECURSIVE {Q.QA}, t0 AS (SELECT doc_id AS g, list_distinct({Q.content_of(Q.tokens('vlm_pred'))}) AS toks, list_distinct({Q.tokens('ocr_text')}) AS voc FROM qa),
l1 AS (SELECT g, unnest(list_filter(toks, lambda t: NOT list_contains(voc, t))) AS token FROM t0), w0 AS (SELECT g, unnest(voc) AS token FROM t0),
{near_sql('l1', 'w0', '0.8e0', 'plain')}, nc AS (SELECT g, count(*) AS near, string_agg(token || '>' || near, '|' ORDER BY token || '>' || near) AS near_words FROM near_ GROUP BY g),
c AS (SELECT t0.g, len(toks) AS total, len(list_filter(toks, lambda t: list_contains(voc, t))) AS found, coalesce(near, 0) AS near, coalesce(near_words, '') AS near_words FROM t0 LEFT JOIN nc USING (g))
SELECT g AS doc_id, found::BIGINT AS found, near::BIGINT AS near, (total - found - near)::BIGINT AS missing,
  CASE WHEN total > 0 THEN round_even((found + near) / total::DOUBLE, 3) END AS coverage, near_words FROM c""")
def text_support(spark, sf):
    return P.text_support(X.predictions(spark, sf), ["doc_id"], "vlm_pred", "ocr_text").withColumn("near_words", F.array_join("near_words", "|"))


_SUP = (f"k_ AS (SELECT idx, vlm_pred, ocr_pred, {Q.keys('vlm_pred')} AS kv, {Q.keys('ocr_pred')} AS ko, {Q.vocab('layer_text')} AS voc, "
        f"list_distinct({Q.content_of(Q.tokens('ocr_pred'))}) AS co, list_distinct({Q.content_of(Q.tokens('vlm_pred'))}) AS cv FROM qa)")


def _sup(p, k):
    return (f"CASE WHEN {p} IS NOT NULL AND NOT {Q.not_found(p)} AND len({k}) > 0 THEN "
            f"round_even(len(list_filter({k}, lambda t: list_contains(voc, t))) / len({k})::DOUBLE, 3) END")


def _miss(p, c):
    return (f"CASE WHEN {p} IS NOT NULL AND NOT {Q.not_found(p)} THEN array_to_string(list_sort(list_filter({c}, lambda t: NOT list_contains(voc, ltrim(t, '$')))), '|') ELSE '' END")


@query("reference_support", f"WITH {Q.QA}, {_SUP} SELECT idx, {_sup('vlm_pred', 'kv')} AS vlm_support, {_sup('ocr_pred', 'ko')} AS ocr_support, "
       f"{_miss('ocr_pred', 'co')} AS ocr_missing FROM k_")
def reference_support(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("idx", P.reference_support(F.col("vlm_pred"), F.col("layer_text")).alias("vlm_support"),
                    P.reference_support(F.col("ocr_pred"), F.col("layer_text")).alias("ocr_support"),
                    F.array_join(F.array_sort(P.missing_from_reference(F.col("ocr_pred"), F.col("layer_text"))), "|").alias("ocr_missing"))


def _asks(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("idx", "qid", F.col("vlm_pred").alias("vlm_answer"), F.col("ocr_pred").alias("ocr_answer"),
                    F.when(F.col("vlm_pred").isNull(), "failed").alias("vlm_error"), F.when(F.col("ocr_pred").isNull(), "failed").alias("ocr_error"),
                    "vlm_ms", "ocr_ms", F.when(F.col("idx") % 4 != 3, F.col("layer_text")).alias("reference"),
                    (F.col("idx") % 11 != 5).alias("vlm_ran"), F.lit(True).alias("ocr_ran"), "ocr_text", "doc_id",
                    F.col("gold")[0].alias("first_gold"))


CARD = f"""{_SUP}, s_ AS (SELECT qa.idx, qa.qid, qa.vlm_pred, qa.ocr_pred, vlm_ms, ocr_ms, qa.idx % 4 <> 3 AS has_ref, qa.idx % 11 <> 5 AS ran,
  CASE WHEN qa.idx % 4 <> 3 THEN {_sup('qa.vlm_pred', 'kv')} END AS a, CASE WHEN qa.idx % 4 <> 3 THEN {_sup('qa.ocr_pred', 'ko')} END AS b,
  CASE WHEN qa.idx % 4 <> 3 THEN {_miss('qa.vlm_pred', 'cv')} ELSE '' END AS vlm_missing, CASE WHEN qa.idx % 4 <> 3 THEN {_miss('qa.ocr_pred', 'co')} ELSE '' END AS ocr_missing
  FROM qa JOIN k_ ON k_.idx = qa.idx),
card_ AS (SELECT idx, qid, vlm_pred IS NOT NULL AND NOT {Q.not_found('vlm_pred')} AS vlm_answered, ocr_pred IS NOT NULL AND NOT {Q.not_found('ocr_pred')} AS ocr_answered,
  a AS vlm_support, b AS ocr_support, vlm_missing, ocr_missing, vlm_ms, ocr_ms, vlm_pred, ocr_pred, has_ref, ran,
  CASE WHEN ran AND vlm_pred IS NOT NULL AND ocr_pred IS NOT NULL THEN CASE WHEN vlm_ms < ocr_ms THEN 'vlm' ELSE 'ocr' END END AS faster,
  CASE WHEN NOT ran THEN NULL WHEN NOT has_ref THEN 'unknown' WHEN a IS NULL AND b IS NULL THEN 'tie'
    WHEN (b IS NULL AND a >= 0.5e0) OR coalesce(a - b >= 0.1e0, false) THEN 'vlm' WHEN (a IS NULL AND b >= 0.5e0) OR coalesce(b - a >= 0.1e0, false) THEN 'ocr' ELSE 'tie' END AS winner FROM s_)"""


@query("scorecard", f"WITH {Q.QA}, {CARD} SELECT idx, vlm_answered, ocr_answered, vlm_support, ocr_support, vlm_missing, ocr_missing, faster, winner FROM card_")
def scorecard(spark, sf):
    c = P.scorecard(_asks(spark, sf))
    return c.select("idx", "vlm_answered", "ocr_answered", "vlm_support", "ocr_support",
                    *[F.array_join(F.array_sort(m), "|").alias(m) for m in ("vlm_missing", "ocr_missing")], "faster", "winner")


_SIM = f"""tt AS (SELECT doc_id, unnest({Q.tokens('text')}) AS tok, 0 AS f FROM documents UNION ALL SELECT doc_id, unnest({Q.tokens(Q.DOCS_MISREAD)}), 1 FROM documents),
tc AS (SELECT doc_id, tok, count(*) FILTER (f = 0) AS a, count(*) FILTER (f = 1) AS b FROM tt GROUP BY doc_id, tok),
sim_ AS (SELECT doc_id, sum(a)::BIGINT AS layer_tokens, sum(b)::BIGINT AS ocr_tokens, sum(least(a, b))::BIGINT AS shared, sum(greatest(a - b, 0))::BIGINT AS missed,
  round_even(2.0e0 * sum(least(a, b)) / (sum(a) + sum(b)), 4) AS similarity FROM tc GROUP BY doc_id)"""


def _both_texts(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", "source", F.col("text").alias("layer_text"), X.ocr_text(F.col("doc_id"), F.col("text")).alias("ocr_text"))


@query("page_similarity", f"WITH {_SIM} SELECT doc_id, layer_tokens, ocr_tokens, shared, similarity FROM sim_")
def page_similarity(spark, sf):
    return P.page_similarity(_both_texts(spark, sf), ["doc_id"], "layer_text", "ocr_text").drop("missed")


@query("shingle_similarity", f"""WITH s0 AS (SELECT doc_id, {Q.tokens('text')} AS t, 0 AS f FROM documents UNION ALL SELECT doc_id, {Q.tokens(Q.DOCS_MISREAD)}, 1 FROM documents),
tt AS (SELECT doc_id, f, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS tok FROM s0 WHERE len(t) >= 3),
tc AS (SELECT doc_id, tok, count(*) FILTER (f = 0) AS a, count(*) FILTER (f = 1) AS b FROM tt GROUP BY doc_id, tok)
SELECT doc_id, round_even(2.0e0 * sum(least(a, b)) / (sum(a) + sum(b)), 4) AS shingle_similarity FROM tc GROUP BY doc_id""")
def shingle_similarity(spark, sf):
    return P.shingle_similarity(_both_texts(spark, sf), ["doc_id"], "layer_text", "ocr_text")


@query("tokens_missed", f"WITH {_SIM} SELECT doc_id, missed FROM sim_ WHERE missed > 0")
def tokens_missed(spark, sf):
    return P.page_similarity(_both_texts(spark, sf), ["doc_id"], "layer_text", "ocr_text").where("missed > 0").select("doc_id", "missed")


@query("read_accuracy", f"""WITH {_SIM} SELECT source AS doc, round_even(avg(similarity), 4) AS read_accuracy, count(*) AS pages_checked, sum(missed)::BIGINT AS words_missed
  FROM sim_ JOIN documents USING (doc_id) GROUP BY source""")
def read_accuracy(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.col("source").alias("doc"))
    return P.read_accuracy(P.page_similarity(_both_texts(spark, sf), ["doc_id"], "layer_text", "ocr_text").join(d, "doc_id"), ["doc"])
