"""Text functions over whole texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as T
from . import fixtures as X
from . import sqlparts as Q
from .registry import query


def _over_documents(name, expr, sql):
    """One value per document."""
    @query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def run(spark, sf):
        return X.table(spark, sf, "documents").select("doc_id", expr(F.col("text")).alias("value"))


def _joined(build):
    return lambda s: F.array_join(build(s), "|")


def _sorted(build):
    return lambda s: F.array_join(F.array_sort(build(s)), "|")


def _sqljoin(x):
    return f"array_to_string({x}, '|')"


_over_documents("clean_text", T.clean, Q.clean("text"))
_over_documents("normalized_answer", T.normalize, Q.normalize("text"))
_over_documents("norm_text", T.norm_text, Q.norm_text("text"))
_over_documents("tokens", _joined(T.tokens), _sqljoin(Q.tokens("text")))
_over_documents("bm25_tokens", _joined(T.bm25_tokens),
                "regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ', '|', 'g')")
_over_documents("bm25_query_tokens", _joined(lambda s: T.bm25_tokens(s, drop_stop=True)),
                _sqljoin("list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains(" + Q.STOP + ", t))"))
_over_documents("content_tokens", _sorted(T.content_tokens), _sqljoin(f"list_sort(list_distinct({Q.content_of(Q.tokens('text'))}))"))
_over_documents("match_keys", _sorted(T.keys), _sqljoin(f"list_sort({Q.keys('text')})"))
_over_documents("alnum_form", T.alnum, Q.alnum("text"))
_over_documents("raw_words", _joined(T.raw_words), _sqljoin(
    "list_filter(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), "
    "lambda w: trim(w, '.,;:!?\"''()[]{}“”‘’')), lambda w: w <> '')"))


@query("numbers", f"WITH {Q.ASKS} SELECT qid, {_sqljoin(Q.numbers('ocr'))} AS numbers FROM asks_")
def numbers(spark, sf):
    return X.asks(spark, sf).select("qid", F.array_join(F.array_sort(T.numbers(F.col("ocr"))), "|").alias("numbers"))


NUMERIC_SQL = r"regexp_extract_all(vlm, '\d+(?:[.,]\d+)*')"


@query("numeric_strings", f"WITH {Q.ASKS} SELECT qid, {_sqljoin(NUMERIC_SQL)} AS found FROM asks_")
def numeric_strings(spark, sf):
    return X.asks(spark, sf).select("qid", F.array_join(T.numeric_strings(F.col("vlm")), "|").alias("found"))


@query("not_found_answers", f"WITH {Q.ASKS} SELECT qid, {Q.not_found('ocr')} AS not_found, {Q.abstain('ocr')} AS abstains, "
       f"{Q.not_found('vlm')} AS vlm_not_found FROM asks_")
def not_found_answers(spark, sf):
    return X.asks(spark, sf).select("qid", T.is_not_found(F.col("ocr")).alias("not_found"),
                                    T.is_abstain(F.col("ocr")).alias("abstains"), T.is_not_found(F.col("vlm")).alias("vlm_not_found"))


@query("normalized_questions", f"WITH {Q.MSGS} SELECT seq, rtrim({Q.clean('content')}, ' ?.!') AS question FROM msgs WHERE role = 'user'")
def normalized_questions(spark, sf):
    return X.messages(spark, sf).where("role = 'user'").select("seq", T.normalize_question(F.col("content")).alias("question"))


_RAW = "list_filter(list_transform(string_split(trim(regexp_replace(layer_text, '\\s+', ' ', 'g')), ' '), lambda w: trim(w, '.,:;!?\"''()[]{}“”‘’')), lambda w: w <> '')"


@query("written_forms", f"""WITH {Q.QA}, wf_ AS (SELECT idx, lower(coalesce(string_split(gold[1], ' ')[2], '')) AS word, {_RAW} AS ws FROM qa)
SELECT idx, word, coalesce(ltrim(list_filter(ws, lambda w_: ltrim(({Q.tokens('w_')})[1], '$') = word)[1], '$'), word) AS written FROM wf_""")
def written_forms(spark, sf):
    """The second word of an answer as the document writes it."""
    p = X.predictions(spark, sf)
    word = F.lower(F.coalesce(F.get(F.split(F.col("gold")[0], " "), F.lit(1)), F.lit("")))
    return p.select("idx", word.alias("word"), T.as_written(word, F.col("layer_text")).alias("written"))


@query("split_claims", f"""WITH {Q.ASKS}, parts AS (
  SELECT qid, unnest(regexp_split_to_array(regexp_replace(ocr, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+')) AS part,
    generate_subscripts(regexp_split_to_array(regexp_replace(ocr, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), 1) AS ord FROM asks_),
bare AS (SELECT qid, ord, trim(regexp_replace(part, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), ' ' || chr(10) || chr(9) || chr(13)) AS claim FROM parts)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY ord) - 1)::INT AS ord, claim FROM bare WHERE claim <> ''""")
def split_claims(spark, sf):
    return X.asks(spark, sf).select("qid", F.posexplode(T.split_claims(F.col("ocr"))).alias("ord", "claim"))


@query("short_answers", f"WITH {Q.ASKS} SELECT qid, {Q.short('vlm')} AS vlm_short, {Q.short('ocr')} AS ocr_short FROM asks_")
def short_answers(spark, sf):
    return X.asks(spark, sf).select("qid", T.is_short(F.col("vlm")).alias("vlm_short"), T.is_short(F.col("ocr")).alias("ocr_short"))


@query("matching_lines", f"""WITH {Q.QA}, {Q.LINES}, kw AS (
  SELECT doc_id, list_filter(list_transform(string_split(lower(coalesce(vlm_pred, '')), ' '), lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')),
    lambda w: length(w) > 2) AS kws FROM qa)
SELECT l.doc_id, l.line_no, length(l.text)::BIGINT AS chars,
  len(list_filter(string_split(trim(regexp_replace(l.text, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))::BIGINT AS words
FROM lines_ l JOIN kw USING (doc_id) WHERE list_bool_or(list_transform(kws, lambda w: contains(lower(l.text), w)))""")
def matching_lines(spark, sf):
    from ..operators.retrieval import matching_lines as op
    p = X.predictions(spark, sf).select("doc_id", F.col("vlm_pred").alias("answer"))
    return op(X.ocr_lines(spark, sf), p, ["doc_id"]).select("doc_id", "line_no", "chars", "words")


@query("sql_functions", f"""SELECT doc_id, md5({Q.norm_text('text')}) AS norm_md5, len({Q.tokens('text')}) AS n_tokens, {_sqljoin(f"list_sort({Q.keys('text')})")} AS match_keys,
  {Q.abstain('text')} AS abstains, round({Q.em("substr(text, 1, 40)", "['x', substr(text, 1, 40) || '.']")}, 6) AS em FROM documents""")
def sql_functions(spark, sf):
    """The functions by name in SQL."""
    sql.register(spark)
    X.table(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("lectern_texts")
    return spark.sql("""SELECT doc_id, md5(lectern_norm_text(text)) AS norm_md5, cast(size(lectern_tokens(text)) AS bigint) AS n_tokens,
        array_join(array_sort(lectern_match_keys(text)), '|') AS match_keys, lectern_is_abstain(text) AS abstains,
        lectern_score_item(substring(text, 1, 40), array('x', substring(text, 1, 40) || '.')).em AS em FROM lectern_texts""")
