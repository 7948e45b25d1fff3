"""SQL fragments for the checks: the derived inputs as CTEs and the text functions as expressions, written for a SQL
engine that has neither look-behind nor Unicode word classes."""
from __future__ import annotations

from ..functions.text import STOP_WORDS

NF = "Not found in document."
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
NUM = r"\$?\d[\d,]*(?:\.\d+)?%?"


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def normalize(x: str) -> str:
    return f"trim({clean(x)}, ' .,:;!?\"''')"


def norm_text(x: str) -> str:
    low = f"replace(replace(replace(lower(coalesce({x}, '')), '’', ''''), '“', '\"'), '”', '\"')"
    for _ in range(2):
        low = f"regexp_replace({low}, '(\\d),(\\d{{3}})', '\\1\\2', 'g')"
    low = f"regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_\\s.%$/-]', ' ', 'g')"
    return f"trim(regexp_replace({low}, '\\s+', ' ', 'g'))"


def toks_of(norm: str) -> str:
    return (f"list_filter(list_transform(string_split({norm}, ' '), lambda t_: trim(t_, '.-/')), lambda t_: t_ <> '')")


def tokens(x: str) -> str:
    return toks_of(norm_text(x))


def nums_of(norm: str) -> str:
    """Sorted distinct canonical numbers."""
    return (f"list_sort(list_distinct(list_transform(regexp_extract_all({norm}, '{NUM}'), lambda m_: "
            "CASE WHEN contains(rtrim(replace(m_, '$', ''), '.'), '.') "
            "THEN rtrim(rtrim(rtrim(replace(m_, '$', ''), '.'), '0'), '.') ELSE rtrim(replace(m_, '$', ''), '.') END)))")


def numbers(x: str) -> str:
    return nums_of(norm_text(x))


def is_num(t: str) -> str:
    return f"regexp_full_match({t}, '{NUM}')"


def content_of(toks: str) -> str:
    return (f"list_filter({toks}, lambda t_: NOT list_contains({STOP}, t_) AND (length(t_) >= 4 OR {is_num('t_')}))")


def keys(x: str) -> str:
    """Distinct content tokens without currency sign; order is not kept, so compare as sets or counts."""
    return f"list_transform(list_distinct({content_of(tokens(x))}), lambda k_: ltrim(k_, '$'))"


def vocab(x: str) -> str:
    return f"list_distinct(list_transform({tokens(x)}, lambda k_: ltrim(k_, '$')))"


def not_found(x: str) -> str:
    return f"contains({norm_text(x)}, 'not found in document')"


def abstain(x: str) -> str:
    return f"contains({normalize(x)}, 'not found in document')"


def alnum(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z]', '', 'g')"


def short(x: str) -> str:
    a = f"coalesce({x}, '')"
    return (f"({a} <> '' AND NOT {not_found(x)} AND length({a}) <= 200 "
            f"AND length({a}) - length(replace({a}, chr(10), '')) <= 1)")


def anls(p: str, golds: str) -> str:
    """ASCII answers only: the engine's levenshtein counts bytes."""
    pc, gc = clean(p), clean("g_")
    d = f"(levenshtein({pc}, {gc})::DOUBLE / greatest(length({pc}), length({gc})))"
    return (f"coalesce(list_max(list_transform({golds}, lambda g_: CASE WHEN greatest(length({pc}), length({gc})) = 0 THEN 1.0e0 "
            f"WHEN {d} < 0.5e0 THEN 1.0e0 - {d} ELSE 0.0e0 END)), 0.0e0)")


def em(p: str, golds: str) -> str:
    return f"list_contains(list_transform({golds}, lambda g_: {normalize('g_')}), {normalize(p)})::INT::DOUBLE"


def contains_(p: str, golds: str) -> str:
    g = normalize("g_")
    return f"list_bool_or(list_transform({golds}, lambda g_: {g} <> '' AND contains({normalize(p)}, {g})))::INT::DOUBLE"


def in_text(golds: str, text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '[\\s|]+', ' ', 'g')"
    g = f"regexp_replace({normalize('g_')}, '[\\s|]+', ' ', 'g')"
    return f"list_bool_or(list_transform({golds}, lambda g_: {normalize('g_')} <> '' AND contains({t}, {g})))"


DOCS_MISREAD = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'lO', '1o') ELSE text END"

QA = f"""qa_all AS (
  SELECT doc_id, source, lang, text, string_split(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents),
qa_words AS (
  SELECT *, list_transform(range(0, 6), lambda i_: coalesce(ws[i_ + CASE WHEN len(ws) >= 6 THEN 1 + (doc_id * 7) % (len(ws) - 5) ELSE 1 END], '')) AS w FROM qa_all),
qa_gold AS (
  SELECT *, rtrim(w[1] || ' ' || w[2] || ' ' || w[3]) AS g1, rtrim(w[4] || ' ' || w[5]) AS g2 FROM qa_words),
qa AS (
  SELECT 'EXP-000' || (doc_id % 4 + 1) AS exp_id, doc_id AS idx, 'q' || doc_id AS qid,
    'What does ' || w[2] || ' ' || w[4] || ' say?' AS question,
    CASE WHEN doc_id % 5 = 0 THEN [g1, g2] ELSE [g1] END AS gold,
    CASE WHEN doc_id % 10 = 0 THEN '{NF}' WHEN doc_id % 10 = 1 THEN NULL WHEN doc_id % 10 = 2 THEN translate(g1, 'leo', '1c0')
         WHEN doc_id % 10 = 3 THEN w[1] ELSE g1 END AS vlm_pred,
    CASE WHEN doc_id % 7 = 0 THEN '{NF}' WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN translate(g1, 'leo', '1c0')
         WHEN doc_id % 7 = 3 THEN replace(g1, ' ', '') WHEN doc_id % 7 = 4 THEN rtrim(w[4] || ' ' || w[5] || ' ' || w[6]) ELSE g1 END AS ocr_pred,
    (100 + (doc_id * 37) % 900)::DOUBLE AS vlm_ms, (200 + (doc_id * 53) % 3000)::DOUBLE AS ocr_ms,
    [source, lang] AS types, doc_id, text AS layer_text, {DOCS_MISREAD} AS ocr_text
  FROM qa_gold)"""


def _side(s: str) -> str:
    p = f"{s}_pred"
    scored = f"{p} IS NOT NULL AND NOT {abstain(p)}"
    return (f"CASE WHEN {scored} THEN {em(p, 'gold')} ELSE 0.0e0 END AS {s}_em, "
            f"CASE WHEN {scored} THEN {anls(p, 'gold')} ELSE 0.0e0 END AS {s}_anls, "
            f"CASE WHEN {scored} THEN {contains_(p, 'gold')} ELSE 0.0e0 END AS {s}_contains, "
            f"CASE WHEN {p} IS NOT NULL AND {abstain(p)} THEN 1.0e0 ELSE 0.0e0 END AS {s}_abstain, "
            f"CASE WHEN {p} IS NULL THEN 1.0e0 ELSE 0.0e0 END AS {s}_error")


SCORED = QA + f""",
scored AS (SELECT *, {_side('vlm')}, {_side('ocr')}, {in_text('gold', 'ocr_text')} AS answer_in_ocr FROM qa)"""

PAGES = f"""pages_ AS (
  SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, doc_id,
    text AS layer_text, {DOCS_MISREAD} AS ocr_text, n_chars FROM documents)"""

QUESTIONS = """questions_ AS (
  SELECT 'ask-' || item_id AS qid, 'src' || (item_id % 20) AS doc,
    'What is the ' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) || '?' AS question FROM benchmark)"""

LINES = f"""lines_raw AS (
  SELECT doc_id, unnest(string_split({DOCS_MISREAD}, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines_ AS (
  SELECT doc_id, (pos * 3 + cell)::BIGINT AS line_no, text,
    0.80e0 + ((doc_id * 13 + pos + cell) % 20)::DOUBLE / 100.0e0 AS score,
    10.0e0 + 800.0e0 * cell AS x0, 30.0e0 * pos AS y0, 10.0e0 + 800.0e0 * cell + 7.0e0 * length(text) AS x1,
    30.0e0 * pos + 20.0e0 AS y1
  FROM lines_raw, (SELECT unnest([0, 1, 2]) AS cell)
  WHERE cell = 0 OR (doc_id + pos) % 5 = 0)"""

MSGS = f"""msgs AS (
  SELECT conv_id, conv_id * 4294967296 + turn AS seq, turn::BIGINT AS turn, role,
    CASE WHEN role = 'user' THEN 'What is item ' || ((conv_id * 3 + turn) % 5) || '?' ELSE text END AS content,
    md5((conv_id % 40)::VARCHAR) AS sha256, 1700000000 + conv_id * 1000 + turn AS created_s,
    CASE WHEN role = 'assistant' THEN text END AS vlm_answer,
    CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 6 = 0 THEN NULL WHEN conv_id % 6 = 1 THEN '{NF}' ELSE text END END AS ocr_answer,
    CASE WHEN role = 'assistant' AND (conv_id * 1000 + turn) % 13 = 0 THEN 'timeout' END AS error,
    CASE WHEN conv_id % 3 = 0 THEN 'both' ELSE 'vlm' END AS mode, conv_id % 2 = 0 AS short,
    (conv_id % 4)::VARCHAR AS prompt_version, CASE WHEN conv_id % 7 = 0 THEN 3 ELSE 6 END AS page_cap
  FROM conversations)"""

CONVS = MSGS + """,
convs AS (
  SELECT conv_id, 'Conversation ' || conv_id AS title, CASE WHEN conv_id % 11 <> 0 THEN conv_id % 40 END AS doc_id,
    CASE WHEN conv_id % 11 <> 0 AND conv_id % 5 <> 0 THEN sha256 END AS doc_sha256,
    min(created_s) AS created_s, max(created_s) AS updated_s FROM msgs GROUP BY conv_id, sha256)"""

FILES = """files_ AS (
  SELECT doc_id, source || '-' || (doc_id % 60) || '.pdf' AS filename, 1 + doc_id % 9 AS n_pages, n_chars AS size_bytes,
    md5((doc_id % 60)::VARCHAR) AS sha256, 1690000000 + doc_id * 61 AS created_s FROM documents)"""

RATED = """rated_ AS (
  SELECT 'EXP-000' || (doc_id % 3 + 1) AS exp_id, doc_id AS idx,
    CASE WHEN doc_id % 8 <> 0 THEN ((doc_id * 61) % 1001)::DOUBLE / 1000.0e0 END AS trust,
    CASE WHEN doc_id % 8 = 0 THEN 'not rated' ELSE 'medium' END AS trust_level,
    CASE WHEN doc_id % 8 <> 0 THEN quality = 1 END AS recommended_correct, toxic = 0 AS agree FROM labels)"""

ASKS = f"""asks_ AS (
  SELECT qid, CASE WHEN about % 10 = 0 THEN '{NF}' WHEN k = 5 THEN other ELSE a END AS vlm,
    CASE WHEN k = 0 THEN '{NF}' WHEN k = 1 THEN a WHEN k = 2 THEN translate(text, 'e', 'c') || ' The total is 1' || n3 ||
        '.5.' || chr(10) || 'It took ' || other || ' days.' WHEN k = 3 THEN text
      WHEN k = 4 THEN '1. ' || lower(text) || chr(10) || '- Total: ' || amount || chr(10) || other
      WHEN k = 5 THEN '- ' || amount ELSE reverse(text) || ' Done! 12%' END AS ocr
  FROM (SELECT *, text || ' The total is $1,' || n3 || '.50. It took ' || amount || ' days.' AS a FROM (
    SELECT conv_id * 4294967296 + turn AS qid, conv_id * 1000 + turn AS about, text, (conv_id * 1000 + turn) % 7 AS k, (1000 + (conv_id * 1000 + turn) % 97)::VARCHAR AS amount,
      (2000 + (conv_id * 1000 + turn) % 89)::VARCHAR AS other, lpad(((conv_id * 1000 + turn) % 1000)::VARCHAR, 3, '0') AS n3
    FROM conversations WHERE role = 'assistant')))"""
