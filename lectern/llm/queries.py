"""One query per operator, over its whole table, and the SQL where SQL can express it."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, decontaminate, hmm, langid, linededup, manifest, pii, secrets, simhash, topk, urlrules, variants
from lectern.llm.common import ascii_lower, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    """The vocabulary file used by the queries; LECTERN_TOKENIZER names another."""
    import public_tokenizers
    return os.environ.get("LECTERN_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null doc_ids stay; null and empty texts have no tokens and the digests of nothing; repeated rows stay repeated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.round_trip(docs, tokenizer_path())
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null doc_id are neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, remainder(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op3_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_decontamination", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bs, unnest(range(1, len(w) - k + 2)) t(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, dw.win, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


@query("op7_exact_topk", sql="""
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.id <> c.id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return secrets.scan(docs).select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                                     joined(F.col("secrets")).alias("spans"))


@query("op9_chat_windows", sql=r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(role) + 24 AS len,
      len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) + 4 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM c),
q AS (SELECT *, first_value(role) OVER o = 'system' AND first_value(tok) OVER o <= 512 AS led, first_value(tok) OVER o AS t0, first_value(len) OVER o AS l0, sum(tok) OVER o - tok AS before
      FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
r AS (SELECT *, CASE WHEN led THEN t0 ELSE 0 END AS lt, 768 - CASE WHEN led THEN t0 ELSE 0 END AS step, greatest(before - CASE WHEN led THEN t0 ELSE 0 END, 0) AS begins, led AND pos = 1 AS lead_ FROM q),
s AS (SELECT *, CAST(floor(begins / step) AS BIGINT) AS slot, CASE WHEN lead_ THEN 0 ELSE tok END AS own FROM r),
v AS (SELECT *, max(begins + own) OVER g > (slot + 1) * step AND count(*) FILTER (NOT lead_) OVER g > 1 AND pos = max(pos) OVER g AS alone FROM s WINDOW g AS (PARTITION BY conv_id, slot)),
w AS (SELECT *, 2 * slot + CASE WHEN alone THEN 1 ELSE 0 END AS win FROM v),
n AS (SELECT conv_id, win, min(begins) FILTER (NOT lead_) AS starts, sum(own) AS total FROM w GROUP BY conv_id, win),
f AS (SELECT *, lead(starts) OVER o AS next_starts, lead(total) OVER o AS next_total FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY win)),
e AS (SELECT w.*, coalesce(next_starts - begins <= least(256, 1024 - lt - next_total) AND NOT lead_, false) AS again FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.win = f.win)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len) + coalesce(sum(len) FILTER (again), 0) + CASE WHEN any_value(led) THEN (count(DISTINCT win) - 1) * any_value(l0) ELSE 0 END AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's digests need its whole text in one row; everything before them is per window."""
    made = spark.sql("""SELECT cast(-1 AS BIGINT) AS conv_id, cast(t AS BIGINT) AS turn, role, '<|im_end|><|im_start|>assistant ok' AS text
                        FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    read = chat.read_back(chat.windows(turns))
    per_window = read.select(
        "conv_id", F.size("turns").alias("n"), "chars", F.struct(
            "window", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss")).alias("x"))
    per = per_window.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("x")).alias("xs"))
    per = per.select("conv_id", "n_turns", "formatted_chars", F.array_join("xs.turns", "").alias("turns"), F.array_join("xs.loss", "").alias("loss"))
    return per.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op1_line_dedup", sql=r"""
WITH l AS (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
      FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, whole, pos, line, regexp_extract_all(line, '[^\x09-\x0D\x20]+') AS raw FROM l),
h AS (SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tok, len(raw) AS n,
      3 + CAST(ceil((len(raw) - 3) / 2) AS BIGINT) AS m FROM t),
k AS (SELECT doc_id, whole, pos, 0 AS kind, '0 ' || array_to_string(tok, ' ') AS key, len(list_filter(tok, lambda x: x <> '<*>')) AS kept FROM h WHERE len(list_filter(tok, lambda x: x <> '<*>')) >= 2
      UNION ALL SELECT doc_id, whole, pos, 1, '1 ' || n || ' ' || array_to_string(tok[1:m], ' '), 0 FROM h WHERE n >= 6 AND len(list_filter(tok[1:m], lambda x: x <> '<*>')) >= 4
      UNION ALL SELECT doc_id, whole, pos, 2, '2 ' || n || ' ' || array_to_string(tok[1:3], ' ') || '  ' || array_to_string(tok[m + 1:], ' '), 0 FROM h
        WHERE n >= 6 AND len(list_filter(tok[1:3] || tok[m + 1:], lambda x: x <> '<*>')) >= 4),
c AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING count(DISTINCT whole) >= CASE WHEN max(kept) >= 20 THEN 2 ELSE 10 END),
x AS (SELECT k.doc_id, k.whole, k.pos, bool_or(kind = 0 AND NOT own) AS gone, bool_or(kind = 0 AND own) AS stays, bool_or(kind = 1 AND NOT own) AS one, bool_or(kind = 2 AND NOT own) AS two
      FROM (SELECT k.*, k.doc_id IS NOT DISTINCT FROM c.first AS own FROM k JOIN c ON k.key = c.key) k GROUP BY ALL),
y AS (SELECT doc_id, whole, pos, gone OR one AS one, gone OR two AS two FROM x WHERE NOT stays AND (gone OR one OR two)),
z AS (SELECT h.doc_id, h.whole, h.pos, one AND two AS out, one <> two AS cut, CASE WHEN y.pos IS NULL THEN line WHEN one AND two THEN NULL WHEN one THEN array_to_string(raw[m + 1:], ' ') ELSE array_to_string(raw[4:m], ' ') END AS left_
      FROM h LEFT JOIN y ON h.doc_id = y.doc_id AND h.whole = y.whole AND h.pos = y.pos),
r AS (SELECT doc_id, whole, count(*) AS n_lines, count(*) FILTER (out) AS n_dropped, count(*) FILTER (cut) AS n_cut, coalesce(string_agg(left_, chr(10) ORDER BY pos), '') AS text FROM z GROUP BY doc_id, whole)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_cut, 0) AS n_cut, r.text FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND d.text = r.whole""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__cut").alias("n_cut"), "text")


@query("op2_hmm_scores")
def hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null doc_id are training rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder(5) == 1, F.lit(False))
    return hmm.score(docs.withColumn("held_out", held), ~held)


@query("op10_pseudonyms")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text pseudonymised. The key comes from LECTERN_KEY; without it each run draws one that nobody learns, so
    equal values are linked within the run only."""
    key = os.environ["LECTERN_KEY"].encode() if os.environ.get("LECTERN_KEY") else os.urandom(32)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.array_sort(F.transform("private", lambda s: s["kind"]))
    return pii.pseudonymise(docs, key).select("doc_id", "text", F.size("private").cast("long").alias("n_private"), F.array_join(kinds, ",").alias("kinds"), "private")


@query("op11_url_filter", sql=r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS at FROM pages),
h AS (SELECT page_id, CASE WHEN at > 0 THEN regexp_extract(substr(url, at + 3), '^[^/?#]*') ELSE '' END AS given,
      CASE WHEN at > 0 THEN substr(url, at + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rhost, rpath, said)),
f AS (SELECT page_id, host, path, max(struct_pack(n := length(rhost || rpath), m := length(rhost), rule := rhost || rpath, verdict := said)) AS best
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, CASE WHEN best.n IS NOT NULL THEN best.rule END AS rule, CASE WHEN best.n IS NOT NULL THEN best.verdict ELSE 'allow' END AS verdict
FROM p JOIN f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("""SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS t(host, path, verdict)""")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def slipped_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of Latin letters in ``text``, A-Z lower-cased, that are long enough for a word; one run in 31, by a hash of
    doc_id and run, has lost a code point. Null texts have no runs; a null doc_id is hashed as an empty one."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{variants.SHORTEST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    size = F.char_length("run")
    at = (h % size).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = runs.select(F.when(h % 31 == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= variants.SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(slipped_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op13_manifest")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, by a hash of its id, is looked at as if its line breaks had been deleted. Null ids are untouched."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = manifest.leaf_of(*fields, F.col("text"))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"),
                       F.when(altered & F.contains("text", F.lit("\n")), manifest.leaf_of(*fields, F.replace("text", F.lit("\n")))).alias("altered"))
    made = manifest.manifest(rows, F.col("leaf"), F.col("source"), F.col("doc_id"))
    out = made.select("row.doc_id", "leaf", "subroot", "root", manifest.digest(manifest.siblings(F.col("path"))).alias("proof_sha256"),
                      manifest.folded(F.coalesce("row.altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
