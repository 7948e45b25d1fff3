"""Why an answer is wrong: one cause per side from a fixed, ordered set of rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import similarity as M
from ..functions import text as T
from .layout import LOW_CONFIDENCE, key_hits, locate_answer, with_layout
from .staging import staged

# The causes of wrong answers.
WRONG = ("misread", "spacing", "lost", "wrong_value", "missed", "partial", "near_miss", "format", "unsupported", "failed")
LAYOUT_NAMES = {"table": "table row", "form": "label and value", "text": "running text"}
NO_WORDS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_WORDS)


def closest_gold(pred: Column, golds: Column) -> Column:
    """The gold most like the prediction; the first one on ties. A single gold needs no comparison."""
    best = T.bind(T.outer_norm(pred), lambda p: F.array_max(F.transform(
        golds, lambda g, i: F.struct(M.ratio(p, T.outer_norm(g)).alias("r"), (-i).alias("i"), g.alias("g"))))["g"])
    return F.when(F.size(golds) == 1, F.get(golds, F.lit(0))).when(F.size(golds) > 1, best).otherwise("")


def word_edits(pred: Column, golds: Column) -> Column:
    """Swaps that turn the first gold into the prediction, spaces aside."""
    flat = lambda s: F.replace(T.outer_norm(s), F.lit(" "), F.lit(""))
    return M.swaps(flat(F.get(golds, F.lit(0))), flat(pred))


def confusion_matrix(pairs: DataFrame, true: str, read: str) -> DataFrame:
    """How often which character is read as which."""
    s = pairs.select(F.explode(M.swaps(F.col(true), F.col(read))).alias("p"))
    return s.groupBy(F.substring("p", 1, 1).alias("true_char"), F.substring("p", 2, 1).alias("read_char")).agg(F.count("*").alias("n"))


def reading_bucket(located: Column, misreads: Column, merged: Column, conf: Column, in_text: Column) -> Column:
    """How OCR read the place of an answer."""
    errors = (F.size(F.coalesce(misreads, _none())) > 0) | F.coalesce(merged, F.lit(False))
    return (F.when(~located & F.coalesce(in_text, F.lit(False)), "read clearly by OCR").when(~located, "not read by OCR")
            .when(errors, "read with errors by OCR").when(conf >= LOW_CONFIDENCE, "read clearly by OCR")
            .otherwise("read with low confidence by OCR"))


def _n_words(s: Column) -> Column:
    return F.size(F.array_remove(F.split(F.btrim(F.regexp_replace(s, r"(?U)\s+", " ")), " "), ""))


def _unsettled(side: str) -> Column:
    p, sc = F.col(f"{side}_pred"), F.col(f"{side}_scores")
    return ~S.is_right(sc) & (sc["abstain"] == 0) & (sc["error"] == 0) & p.isNotNull()


def printed(side: str) -> Column:
    """Whether the text has every word of a wrong answer; NULL where no rule asks for it."""
    def all_there(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.when(T.may_hold(F.col("ocr_text"), words), F.size(F.array_except(words, T.vocab(F.col("ocr_text")))) == 0).otherwise(False))

    return F.when(_unsettled(side), T.bind(F.array_distinct(T.keys(F.col(f"{side}_pred"))), all_there))


def side_cause(items: DataFrame, side: str) -> DataFrame:
    """Adds ``<side>_cause``. Items carry gold, <side>_pred, <side>_scores, answer_in_ocr, ocr_text (or what ``printed`` makes of it, as
    ``_<side>_printed``), and the place of the answer: located, misreads, merged. The rules are ordered; what they look at is computed once
    per item."""
    p, sc = F.col(f"{side}_pred"), F.col(f"{side}_scores")
    in_ocr = F.coalesce("answer_in_ocr", F.lit(False))
    trouble = (F.size(F.coalesce("misreads", _none())) > 0) | F.coalesce("merged", F.lit(False))
    flat = lambda s: F.replace(T.outer_norm(s), F.lit(" "), F.lit(""))
    d = items.withColumns({
        "_absent": ~F.col("located") & ~in_ocr, "_garbled": F.col("located") & trouble & ~in_ocr,
        "_g": closest_gold(p, F.col("gold")), "_pa": T.alnum(p), "_pk": F.array_distinct(T.keys(p))})
    d = d.withColumns({
        "_ga": T.alnum(F.col("_g")), "_gk": F.array_distinct(T.keys(F.col("_g"))), "_fg": flat(F.col("_g")), "_fp": flat(p),
        "_same": F.exists("gold", lambda g: T.alnum(g) == F.col("_pa")), "_nw": _n_words(p), "_gw": _n_words(F.col("_g")),
        "_np": F.array_sort(F.array_distinct(T.numeric_strings(p))), "_ng": F.array_sort(F.array_distinct(T.numeric_strings(F.col("_g"))))})
    # Expensive looks are taken only where the rules before them can still fall through.
    wrong = _unsettled(side)
    same_length = F.length("_fg") == F.length("_fp")
    edited = F.when(same_length, 2 * F.size(M.char_pairs(F.col("_fg"), F.col("_fp")))).otherwise(
        F.length("_fg") + F.length("_fp") - 2 * M.lcs_length(F.col("_fg"), F.col("_fp")))
    d = d.withColumns({
        "_look": F.when(wrong, M.is_lookalike(F.col("_fg"), F.col("_fp"))),
        "_edited": F.when(wrong & (F.lit(side) == "vlm") & (sc["anls"] > 0), edited),
        "_printed": F.col(f"_{side}_printed") if f"_{side}_printed" in items.columns else printed(side)})
    is_ocr, is_vlm = F.lit(side == "ocr"), F.lit(side == "vlm")
    absent, garbled = F.col("_absent"), F.col("_garbled")
    reread = F.when(F.coalesce("merged", F.lit(False)), "spacing").otherwise("misread")
    glued = (F.col("_pa") != "") & F.col("_same") | (
        (F.col("_ga") != "") & F.contains("_pa", F.col("_ga")) & (F.length("_pa") - F.length("_ga") <= 12) & (F.col("_nw") < F.col("_gw")))
    inside = (F.size("_pk") > 0) & (F.size("_gk") > F.size("_pk")) & (F.size(F.array_except("_pk", "_gk")) == 0)
    other_number = (F.size("_np") > 0) & (F.size("_ng") > 0) & (F.col("_np") != F.col("_ng"))
    close = (sc["anls"] > 0) & ~other_number
    cause = (
        F.when(sc.isNull() | p.isNull() | (sc["error"] == 1), "failed")
        .when(S.is_right(sc) & is_ocr & (absent | garbled), "repaired").when(S.is_right(sc) & is_vlm & (absent | garbled), "beyond_ocr")
        .when(S.is_right(sc), "correct")
        .when((sc["abstain"] == 1) & is_ocr & absent, "lost").when((sc["abstain"] == 1) & is_ocr & garbled, reread)
        .when(sc["abstain"] == 1, "missed")
        .when(glued & is_ocr & (F.col("_nw") < F.col("_gw")), "spacing").when(glued, "format")
        .when(inside, "partial").when(is_ocr & absent, "lost").when(is_ocr & garbled, reread)
        .when(F.col("_look"), "misread").when(close & is_vlm & (F.col("_edited") <= 3), "misread").when(close, "near_miss")
        .when(F.col("_printed"), "wrong_value").otherwise("unsupported"))
    return d.withColumn(f"{side}_cause", cause).select(*items.columns, f"{side}_cause")


def without_texts(items: DataFrame) -> DataFrame:
    """Scored items, stored once, with what the rules want to know of ``ocr_text`` in its place: no later step reads the texts again, and none
    shuffles them."""
    return staged(items.withColumns({f"_{s}_printed": printed(s) for s in ("vlm", "ocr")}).drop("ocr_text"), "items")


def item_diagnosis(items: DataFrame, lines: DataFrame, keys: list[str], page: list[str]) -> DataFrame:
    """Adds located, conf, layout, small, misreads, merged, bucket, vlm_cause, ocr_cause, better to scored items. Every gold
    is looked up on the item's page; the first one that stands there as written is taken, else the last gold's place. ``ocr_text`` is left out;
    items may have gone through ``without_texts``."""
    slim = without_texts(items) if "ocr_text" in items.columns else items
    golds = slim.select(*keys, *page, F.size("gold").alias("_ng"), F.posexplode("gold").alias("_no", "answer"))
    loc = locate_answer(golds, lines, [*keys, "_no", "_ng"], page)
    place = F.struct("conf", "layout", "small", "misreads", "merged")
    clean = F.when(F.size("misreads") == 0, F.col("_no"))
    last = F.when(F.col("_no") == F.col("_ng") - 1, place)
    pick = loc.groupBy(*keys).agg(F.min_by(place, clean).alias("_c"), F.min(clean).alias("_any"), F.max(last).alias("_l"))
    pick = pick.select(*keys, F.when(F.col("_any").isNotNull(), F.col("_c")).otherwise(F.col("_l")).alias("_p"))
    out = slim.join(pick, keys, "left").select(*slim.columns, F.col("_p").isNotNull().alias("located"), "_p.*")
    out = out.withColumn("bucket", reading_bucket(F.col("located"), F.col("misreads"), F.col("merged"), F.col("conf"), F.col("answer_in_ocr")))
    v, o = S.is_right(F.col("vlm_scores")), S.is_right(F.col("ocr_scores"))
    out = side_cause(side_cause(out, "vlm"), "ocr")
    return out.drop("_vlm_printed", "_ocr_printed").withColumn("better", F.when(v & o, "both").when(v, "vlm").when(o, "ocr").otherwise("neither"))


# ------------------------------------------------------------------------------------------------ runs
def narrow(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """The columns the run summaries read; texts and lines stay behind."""
    return diagnosed.select(*keys, "types", "located", "layout", "bucket", "vlm_scores", "ocr_scores", "vlm_cause", "ocr_cause", "better")


def outcomes(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    return diagnosed.groupBy(*keys, "better").agg(F.count("*").alias("n"))


def _sides(*cols: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_cause").alias("cause")) for s in ("vlm", "ocr")]))


def cause_counts(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    return diagnosed.select(*keys, _sides().alias("s")).groupBy(*keys, "s.side", "s.cause").agg(F.count("*").alias("n"))


def lost_to(diagnosed: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """On questions only one side got right: the other side's causes with their share, most frequent first."""
    d = diagnosed.where(F.col("better").isin("vlm", "ocr"))
    c = d.groupBy(*keys, F.col("better").alias("winner"), F.when(F.col("better") == "vlm", F.col("ocr_cause")).otherwise(F.col("vlm_cause")).alias("cause")).agg(
        F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "winner")  # at most one row per cause
    c = c.withColumn("share", F.col("n") / F.sum("n").over(w)).where(F.col("cause").isin(*WRONG))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "cause"))).where(F.col("rank") <= top)


def grouped_accuracy(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """Per question type, per reading bucket and per layout: n, right rates, the better side, each side's main failing
    cause. One pass: an item becomes one row per group it belongs to, and causes are counted before anything else."""
    names = F.create_map(*[F.lit(x) for kv in LAYOUT_NAMES.items() for x in kv])
    place = F.when(F.col("located"), names[F.col("layout")]).when(F.col("bucket") == "not read by OCR", F.col("bucket")).otherwise("in OCR's text, place not found")
    entry = lambda kind, val: F.struct(F.lit(kind).alias("kind"), val.alias("grp"))
    groups = F.concat(F.transform("types", lambda t: entry("type", t)), F.array(entry("reading", F.col("bucket")), entry("layout", place)))
    e = diagnosed.select(*keys, F.explode(groups).alias("g"), "vlm_cause", "ocr_cause", S.is_right(F.col("vlm_scores")).alias("v"), S.is_right(F.col("ocr_scores")).alias("o"))
    by = [*keys, "kind", "grp"]
    c = e.select(*keys, "g.*", "vlm_cause", "ocr_cause", "v", "o").groupBy(*by, "vlm_cause", "ocr_cause").agg(
        F.count("*").alias("c"), F.count_if("v").alias("v"), F.count_if("o").alias("o"))
    total = c.groupBy(*by).agg(F.sum("c").alias("n"), F.bround(F.sum("v") / F.sum("c"), 4).alias("vlm_right"), F.bround(F.sum("o") / F.sum("c"), 4).alias("ocr_right"),
                               (F.sum("v") / F.sum("c") - F.sum("o") / F.sum("c")).alias("_gap"))
    causes = c.select(*by, "c", _sides().alias("s")).where(F.col("s.cause").isin(*WRONG)).groupBy(*by, "s.side", "s.cause").agg(F.sum("c").alias("c"))
    main = causes.groupBy(*by).agg(*[F.min_by("cause", F.when(F.col("side") == s, F.struct((-F.col("c")).alias("n"), "cause"))).alias(f"{s}_main_cause") for s in ("vlm", "ocr")])
    better = F.when(F.col("_gap") >= 0.05, "vlm").when(F.col("_gap") <= -0.05, "ocr").otherwise("same")
    return total.join(main, by, "left").select(*by, "n", "vlm_right", "ocr_right", better.alias("better"), "vlm_main_cause", "ocr_main_cause")


def run_diagnosis(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """Everything about why a run went as it did, as (keys, section, name, other, n, value) rows."""
    d = staged(narrow(diagnosed.where(F.col("vlm_scores").isNotNull() & F.col("ocr_scores").isNotNull()), keys), "diagnosis")
    none = F.lit(None).cast("string")
    zero = F.lit(None).cast("double")
    parts = [
        outcomes(d, keys).select(*keys, F.lit("outcome").alias("section"), F.col("better").alias("name"), none.alias("other"), "n", zero.alias("value")),
        cause_counts(d, keys).select(*keys, F.lit("cause").alias("section"), F.col("cause").alias("name"), F.col("side").alias("other"), "n", zero.alias("value")),
        lost_to(d, keys).select(*keys, F.lit("lost_to").alias("section"), F.col("cause").alias("name"), F.col("winner").alias("other"), "n", F.col("share").alias("value")),
        grouped_accuracy(d, keys).select(*keys, F.col("kind").alias("section"), F.col("grp").alias("name"), F.col("better").alias("other"), "n",
                                         (F.col("vlm_right") - F.col("ocr_right")).alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------------------------------------ single questions
def _said(a: Column, words=T.keys) -> Column:
    return F.when(a.isNotNull() & (a != "") & ~T.is_not_found(a), words(a)).otherwise(_none())


def _support(k: Column, vocab: Column) -> Column:
    return F.when(F.size(k) > 0, F.size(F.filter(k, lambda t: F.array_contains(vocab, t))) / F.size(k))


def prepare_asks(asks: DataFrame) -> DataFrame:
    """What the rules for single questions look at. ``asks`` has vlm_answer, ocr_answer, vlm_error, ocr_error, reference,
    closer_text, ocr_text, verdict, n_only_vlm, n_only_ocr. The judge is the reference, else the closer reading."""
    ref, clo = F.coalesce("reference", F.lit("")), F.coalesce("closer_text", F.lit(""))
    d = asks.withColumn("judge_text", F.when(ref != "", ref).when(clo != "", clo))
    d = d.withColumn("basis", F.when(ref != "", "textlayer").when(clo != "", "closer_look"))
    # Generators cut the texts once; as plain columns they would be cut again for every word that is looked up in them.
    d = d.withColumn("judge_vocab", F.explode(F.array(F.when(F.col("judge_text").isNotNull(), T.vocab(F.col("judge_text"))))))
    d = d.withColumn("ocr_vocab", F.explode(F.array(T.vocab(F.col("ocr_text")))))
    d = d.withColumns({"kv": _said(F.col("vlm_answer")), "ko": _said(F.col("ocr_answer")),
                       "wv": _said(F.col("vlm_answer"), T.vocab), "wo": _said(F.col("ocr_answer"), T.vocab)})
    for s, k in (("vlm", "kv"), ("ocr", "ko")):
        d = d.withColumn(f"{s}_nf", F.coalesce(T.is_not_found(F.col(f"{s}_answer")), F.lit(False)) & F.col(f"{s}_answer").isNotNull())
        d = d.withColumn(f"{s}_failed", F.coalesce(f"{s}_error", F.lit("")) != "")
        d = d.withColumn(f"{s}_backing", F.when(F.col("judge_text").isNotNull(), _support(F.col(k), F.col("judge_vocab"))))
    return d


def asked_words(prepared: DataFrame) -> DataFrame:
    """Asks that went through ``prepare_asks``, with short columns in place of the texts. The rules look up words of the two answers only, and
    readings of those that a text does not have, so of ``judge_vocab`` and ``ocr_vocab`` these words stay; ``judge_text`` is empty where
    there is one. Rows are then as long as the answers, whatever is stored or shuffled of them."""
    asked = F.array_union("kv", "ko")

    def kept(vocab: str, read: Column) -> Column:
        readings = F.transform(F.array_except(asked, F.col(vocab)), lambda k: M.near(k, F.col(vocab)))
        both = F.array_union(F.array_intersect(asked, F.col(vocab)), F.array_compact(F.when(read, readings).otherwise(_none())))
        return F.when(F.col(vocab).isNotNull(), both)

    # The second reader's text is searched for readings only where an answer is missing.
    missing = F.col("vlm_nf") | F.col("ocr_nf")
    return prepared.withColumns({"judge_vocab": kept("judge_vocab", F.lit(True)), "ocr_vocab": kept("ocr_vocab", missing), "judge_text": F.when(F.col("judge_text").isNotNull(), "")}).drop(
        "reference", "closer_text", "ocr_text")


def better_reader(prepared: DataFrame) -> DataFrame:
    """Adds ``better``: vlm, ocr, same or undecided."""
    a, b = F.col("vlm_backing"), F.col("ocr_backing")
    judged = F.col("judge_text").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    only = (F.when((F.col("n_only_ocr") > 0) & (F.col("n_only_vlm") == 0), "ocr").when((F.col("n_only_vlm") > 0) & (F.col("n_only_ocr") == 0), "vlm").otherwise("undecided"))
    better = (
        F.when(F.col("vlm_failed") & ~F.col("ocr_failed"), "ocr").when(F.col("ocr_failed") & ~F.col("vlm_failed"), "vlm")
        .when(judged & a.isNull() & b.isNull(), F.when(F.col("vlm_nf") & F.col("ocr_nf"), "same").otherwise("undecided"))
        .when(judged & (b.isNull() | yes(a - b >= 0.1)), F.when(F.coalesce(a, F.lit(0.0)) >= 0.5, "vlm").otherwise("undecided"))
        .when(judged & (a.isNull() | yes(b - a >= 0.1)), F.when(F.coalesce(b, F.lit(0.0)) >= 0.5, "ocr").otherwise("undecided"))
        .when(F.col("verdict") == "consistent", "same").when(judged, only).otherwise("undecided"))
    return prepared.withColumn("better", better)


def core_words(prepared: DataFrame) -> DataFrame:
    """Adds ``terms``: the words in dispute (those of the shorter answer, or of both when they share nothing), as the page
    prints them where an answer misread one."""
    kv, ko = F.col("kv"), F.col("ko")
    related = F.arrays_overlap(kv, ko) | F.exists(kv, lambda k: M.near(k, ko).isNotNull())
    both = (F.size(kv) > 0) & (F.size(ko) > 0)
    core = (F.when(~both, F.concat(kv, ko)).when(~related, F.concat(kv, ko)).when(F.size(kv) <= F.size(ko), kv).otherwise(ko))
    d = prepared.withColumn("_core", core)
    unprinted = lambda k: F.col("judge_text").isNotNull() & ~F.array_contains("judge_vocab", k)
    truth = F.transform("_core", lambda k: F.when(unprinted(k), F.coalesce(M.near(k, F.concat("kv", "ko")), M.near(k, F.col("judge_vocab")), k)).otherwise(k))
    return d.withColumn("terms", F.array_distinct(truth)).drop("_core")


def _status(key: Column, words: Column, answer: Column) -> Column:
    """"right", the word of the answer it is misread as, the way the answer writes it, or "absent". ``words`` are all words of
    the answer: one too short to be a content word may still be a misreading."""
    return F.when(F.array_contains(words, key), "right").otherwise(
        F.coalesce(F.concat(F.lit("misread as "), T.as_written(M.near(key, words), answer)), F.lit("absent")))


def answer_regions(asks: DataFrame, lines: DataFrame, ask: list[str], page: list[str], limit: int = 3) -> DataFrame:
    """Up to three lines that hold the answers' core words, each word in its best line only, with what the vision answer,
    the OCR text and the OCR answer made of it. ``asks`` went through ``core_words``."""
    asks = staged(asks.select(*ask, *page, "terms", "wv", "wo", "vlm_answer", "ocr_answer", "judge_vocab"), "asks")
    hits = staged(key_hits(asks.select(*ask, *page, "terms"), lines, ask, page), "hits")
    laid = with_layout(lines, page).select(*page, "line_no", "text", F.bround("score", 3).alias("conf"), "layout", "box")
    per = hits.groupBy(*ask, *page, "line_no").agg(F.count("*").alias("n"), F.count_if("exact").alias("x"))
    per = per.join(laid, [*page, "line_no"])
    order = F.struct((-F.col("n")).alias("n"), (-F.col("x")).alias("x"), (-F.col("conf")).alias("c"), F.col("line_no").alias("l"))
    placed = hits.join(per.select(*ask, *page, "line_no", order.alias("_o"), "conf", "layout", "box", "text"), [*ask, *page, "line_no"])
    first = placed.groupBy(*ask, *page, "term").agg(F.min_by(F.struct("line_no", "exact", F.when(F.col("read_as").isNotNull(), T.as_written(F.col("read_as"), F.col("text"))).alias("read_as"), "conf", "layout", "box", "ord"), "_o").alias("m"), F.min("_o").alias("_o"))
    w = Window.partitionBy(*ask, *page).orderBy("_o")  # one row per core word of one question
    first = first.withColumn("region", F.dense_rank().over(w) - 1).where(F.col("region") < limit)
    j = first.join(asks.drop("terms"), [*ask, *page])
    vision = _status(F.col("term"), F.col("wv"), F.col("vlm_answer"))
    reply = _status(F.col("term"), F.col("wo"), F.col("ocr_answer"))
    j = j.select(*ask, *page, "region", "m.line_no", "m.conf", "m.layout", "m.box", "term", F.col("m.ord").alias("ord"),
                 F.when(F.col("judge_vocab").isNotNull(), F.array_contains("judge_vocab", F.col("term"))).alias("in_page"),
                 vision.alias("vision"), F.when(F.col("m.exact"), "right").otherwise(F.concat(F.lit("misread as "), F.col("m.read_as"))).alias("ocr_text"),
                 reply.alias("ocr_answer"))
    r = Window.partitionBy(*ask, *page, "region")
    all_right = lambda c: F.every((F.col(c) == "right") & F.coalesce("in_page", F.lit(True))).over(r)
    v, o = all_right("vision"), all_right("ocr_answer")
    better = F.when(F.col("in_page").isNotNull(), F.when(v & o, "both").when(v, "vlm").when(o, "ocr").otherwise("neither"))
    return j.withColumn("region_better", better)


def ask_causes(asks: DataFrame, regions: DataFrame, ask: list[str]) -> DataFrame:
    """(ask, rank, who, cause) for questions without known answers, the losing side first. ``asks`` went through
    ``better_reader``, and may have gone through ``asked_words``; ``regions`` are their ``answer_regions`` with line text words in ``line_words``."""
    near_lines = regions.groupBy(*ask).agg(F.array_distinct(F.flatten(F.collect_list("line_words"))).alias("_lines"))  # at most three lines
    d = asks.join(near_lines, ask, "left").withColumn("_lines", F.coalesce("_lines", _none()))
    judged, better = F.col("judge_text").isNotNull(), F.col("better")
    for s, k, o, ko_ in (("vlm", "kv", "ocr", "ko"), ("ocr", "ko", "vlm", "kv")):
        mine, other, voc, ocr = F.col(k), F.col(ko_), F.col("judge_vocab"), F.col("ocr_vocab")
        is_ocr = F.lit(s == "ocr")
        outside = lambda ks, v: F.filter(ks, lambda t: ~F.array_contains(v, t))
        # not found here, while the other side has an answer
        other_ok = (F.size(other) > 0) & (~judged | (F.coalesce(F.col(f"{o}_backing"), F.lit(0.0)) >= 0.5))
        gone = outside(other, ocr)
        d = d.withColumns({f"_gone_{s}": F.when(F.col(f"{s}_nf") & other_ok, gone)})
        garbled = F.exists(f"_gone_{s}", lambda t: M.near(t, ocr).isNotNull())
        nf = F.when(other_ok, F.when(is_ocr & garbled, "misread").when(is_ocr & (F.size(f"_gone_{s}") == F.size(other)), "lost").otherwise("missed"))
        # judged by a text
        d = d.withColumns({f"_bad_{s}": F.when(judged, F.get(outside(mine, voc), F.lit(0))), f"_unread_{s}": F.size(outside(mine, ocr)) > 0})
        bad = F.col(f"_bad_{s}")
        supported = (F.when(F.col(f"_unread_{s}"), F.lit("repaired" if s == "ocr" else "beyond_ocr")).when(better == o, "partial")
                     .when(better.isin(s, "same"), "correct"))
        reading = F.coalesce(M.near(bad, F.filter(other, lambda t: F.array_contains(voc, t))), M.near(bad, F.col("_lines")), M.near(bad, voc))
        judged_cause = F.when(bad.isNull(), supported).when(reading.isNotNull(), "misread").otherwise("unsupported")
        # nothing to judge by: only the signature of a difference
        looks = F.transform(F.filter(mine, lambda t: ~F.array_contains(other, t)), lambda t: F.struct(
            t.alias("k"), M.near(t, other).alias("m"), (~F.array_contains(ocr, t)).alias("gone")))
        d = d.withColumn(f"_sign_{s}", F.when(~judged, F.get(F.filter(looks, lambda x: x["m"].isNotNull() | (F.lit(s == "vlm") & x["gone"])), F.lit(0))))
        sg = F.col(f"_sign_{s}")
        shaped = F.exists(M.swaps(T.as_written(sg["m"], F.col(f"{o}_answer")), T.as_written(sg["k"], F.col(f"{s}_answer"))), M.is_confusable)
        open_cause = (F.when(sg["m"].isNotNull(), F.when(is_ocr & F.coalesce(shaped, F.lit(False)) & ~F.array_contains(ocr, sg["m"]), "misread"))
                      .when(sg.isNotNull(), "beyond_ocr"))
        cause = (F.when(F.col(f"{s}_failed"), "failed").when(F.col(f"{s}_answer").isNull(), F.lit(None).cast("string"))
                 .when(F.col(f"{s}_nf"), nf).when(judged, judged_cause).otherwise(open_cause))
        d = d.withColumn(f"{s}_why", cause)
    both = (judged & (better == "undecided") & (F.coalesce("verdict", F.lit("")) != "consistent")
            & (F.col("vlm_backing") == 1.0) & (F.col("ocr_backing") == 1.0))
    survived = F.when(better == "vlm", F.col("vlm_survived")).when(better == "ocr", F.col("ocr_survived"))
    row = lambda i, who, cause: F.struct(F.lit(i).alias("i"), who.alias("who"), cause.alias("cause"))
    rows = F.filter(F.array(
        row(0, F.lit("vlm"), F.col("vlm_why")), row(1, F.lit("ocr"), F.col("ocr_why")),
        row(2, F.lit("both"), F.when(F.coalesce(both, F.lit(False)), "ambiguous")),
        row(3, better, F.when(F.coalesce(survived, F.lit(False)), "caution"))), lambda r: r["cause"].isNotNull())
    loser = F.when(better == "vlm", "ocr").when(better == "ocr", "vlm")
    ranked = F.array_sort(F.transform(rows, lambda r: F.struct(
        F.when(loser.isNull(), False).otherwise(r["who"] != loser).alias("a"), F.when(loser.isNull(), False).otherwise(r["cause"] == "correct").alias("b"),
        r["i"].alias("i"), r["who"].alias("who"), r["cause"].alias("cause"))))
    return d.select(*ask, F.posexplode(ranked).alias("rank", "r")).select(*ask, "rank", "r.who", "r.cause")
