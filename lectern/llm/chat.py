r"""Operator 9: chat formatting in budgeted windows.

A turn becomes ``<|im_start|>role LF text<|im_end|> LF``. In texts ``\`` is doubled and ``<|`` becomes ``<\|``, so no control
string can stand inside one, and ``unescape`` gives the text back; roles are URL-encoded.

Prefix sums of turn tokens choose the windows. With ``step`` = budget - history - tokens of the system turn, a turn belongs to slot
floor(tokens before it / step). All turns of a slot but the last end in it; a last turn that does not is a window of its own, so own
turns take at most ``step`` tokens of a window, unless one turn alone takes more. Every window starts with the system turn (the first
turn, if its role is system and it takes at most half the budget; a longer one is a turn like others), repeats turns of the window
before, as many of the last ``history`` tokens as its budget has room for, and then has its own turns. So a window is within the budget
unless a single own turn, with the system turn, is larger. Only texts of own assistant turns are under the loss mask, so each is a
target once.

Null texts and roles are empty; null conv_ids form a conversation. Turns are ordered by turn (nulls first), role, text hash;
repeated rows are turns of their own. A turn is never cut. A conversation of
any length is spread over tasks: prefix sums are taken within sampled ranges of the order and shifted by range totals, and a
window holds at most step / ``OVERHEAD`` turns. Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import same, written

BUDGET = 1024
HISTORY = 256
OVERHEAD = 4  # tokens of a turn's marks
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def placed(turns: DataFrame, longest_lead: int) -> DataFrame:
    """conv_id, role, text, tokens, pos (from 0), before (tokens of earlier turns), lead (the conversation's system turn of at most
    ``longest_lead`` tokens or null), lead_tokens: every turn with its place, without one task seeing a whole conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": F.regexp_count("text", F.lit(r"\S+")).cast("long") + OVERHEAD, "h": F.xxhash64("text"),
                             "tie": F.monotonically_increasing_id()})
    keys = ["turn", "role", "h", "tie"]
    ranged, _ = written(rows.repartitionByRange("conv_id", *keys).withColumn("slice", F.spark_partition_id()), "turns")
    part = ["conv_id", "slice"]
    first = F.min_by(F.struct("role", "text", "tokens"), F.struct(*keys)).alias("first")
    totals = ranged.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), first)
    earlier = Window.partitionBy("conv_id").orderBy("slice")
    shifted = totals.select(
        F.col("conv_id").alias("c"), F.col("slice").alias("s"),
        *[F.coalesce(F.sum(x).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{x}0") for x in ("n", "t")],
        F.first("first").over(earlier).alias("lead"))
    inside = Window.partitionBy(*part).orderBy(*keys)
    own = ranged.withColumns({"n1": F.row_number().over(inside) - 1,
                              "t1": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    both = own.join(shifted, same(own, shifted, {"conv_id": "c", "slice": "s"}))
    lead = F.when((F.col("lead.role") == "system") & (F.col("lead.tokens") <= longest_lead), F.col("lead"))
    return both.select("conv_id", "role", "text", "tokens", (F.col("n0") + F.col("n1")).alias("pos"), (F.col("t0") + F.col("t1")).alias("before"),
                       lead.getField("text").alias("lead"), F.coalesce(lead.getField("tokens"), F.lit(0)).alias("lead_tokens"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (increasing, with gaps), repeated (leading turns given before), formatted, loss (array of (start, end) in code
    points of ``formatted``, end exclusive). ``history`` is at most a quarter of ``budget``."""
    if not 0 <= 4 * history <= budget:
        raise ValueError("history is at most a quarter of the budget")
    rows = placed(turns, budget // 2)
    rows = rows.withColumn("step", F.lit(budget - history) - F.col("lead_tokens")).withColumn("at", F.greatest(F.col("before") - F.col("lead_tokens"), F.lit(0)))
    is_lead = (F.col("pos") == 0) & F.col("lead").isNotNull()
    turn = F.struct("pos", "role", escape(F.col("text")).alias("body"), (F.when(is_lead, 0).otherwise(F.col("tokens")) + F.col("at")).alias("until"), "at", is_lead.alias("first"))
    groups = rows.groupBy("conv_id", F.floor(F.col("at") / F.col("step")).alias("slot")).agg(
        F.array_sort(F.collect_list(turn)).alias("own"), F.first("lead").alias("lead"), F.first("lead_tokens").alias("lead_tokens"), F.first("step").alias("step"))
    end = F.element_at("own", -1)["until"]
    spoken = lambda xs: F.filter(xs, lambda x: ~x["first"])
    over = (end > (F.col("slot") + 1) * F.col("step")) & (F.size(spoken(F.col("own"))) > 1)
    # The next turn begins where this slot's last one ends; the last slot has no next.
    after = F.floor(end / F.col("step"))
    then = F.when(after > F.col("slot"), 2 * after).otherwise(-1)
    part = lambda window, own, following: F.struct(window.alias("window"), own.alias("own"), following.alias("next"))
    whole, last = 2 * F.col("slot"), F.size("own")
    split = F.array(part(whole, F.slice("own", F.lit(1), last - 1), whole + 1), part(whole + 1, F.slice("own", last, F.lit(1)), then))
    cut = groups.select("conv_id", "lead", "lead_tokens", F.inline(F.when(over, split).otherwise(F.array(part(whole, F.col("own"), then)))))
    again = F.filter("own", lambda x: (F.element_at("own", -1)["until"] - x["at"] <= history) & ~x["first"])
    none = F.filter("own", lambda x: F.lit(False))
    sent = cut.select("conv_id", "lead", "lead_tokens", F.explode(F.array(
        F.struct(F.col("window").alias("window"), F.col("own").alias("own"), none.alias("past")),
        F.struct(F.col("next").alias("window"), none.alias("own"), again.alias("past")))).alias("x"))
    met = sent.groupBy("conv_id", "x.window").agg(F.first("lead").alias("lead"), F.first("lead_tokens").alias("lead_tokens"),
                                                  F.flatten(F.collect_list("x.own")).alias("own"), F.flatten(F.collect_list("x.past")).alias("past"))
    met = met.where(F.size("own") > 0)
    begin = F.get(spoken(F.col("own")), F.lit(0))["at"]
    room = F.least(F.lit(history), budget - F.col("lead_tokens") - (F.element_at("own", -1)["until"] - begin))
    met = met.withColumn("past", F.filter("past", lambda x: F.coalesce(begin - x["at"] <= room, F.lit(False))))
    system = F.when(F.col("lead").isNotNull() & (F.element_at("own", 1)["pos"] > 0),
                    F.array(F.struct(F.lit("system").alias("role"), escape(F.col("lead")).alias("body"), F.lit(False).alias("loss"))))
    said = lambda xs, own: F.transform(xs, lambda x: F.struct(x["role"].alias("role"), x["body"].alias("body"), (F.lit(own) & (x["role"] == "assistant")).alias("loss")))
    nothing = F.filter(said(F.col("past"), False), lambda x: F.lit(False))
    before = F.concat(F.coalesce(system, nothing), said(F.col("past"), False))
    parts = met.select("conv_id", "window", before.alias("old"), said(F.col("own"), True).alias("new"))
    parts = parts.select("conv_id", "window", F.size("old").alias("repeated"), F.concat("old", "new").alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), F.url_encode(x["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(head(x), x["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def extend(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(head(x))
        b = a + F.char_length(x["body"])
        return F.struct((b + len(CLOSE)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("turns", start, extend, lambda acc: acc["spans"])
    return parts.select("conv_id", "window", "repeated", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output alone, per window: conv_id, window, turns (array of (role, text) not given before), targets (array of
    texts under the mask), chars."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    bodies = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))
    inner = F.transform(bodies, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x)))
    turns = F.transform(inner, lambda x: F.struct(
        F.url_decode(F.call_function("substring_index", x, F.lit("\n"), F.lit(1))).alias("role"),
        unescape(F.substring(x, F.call_function("locate", F.lit("\n"), x) + 1, F.char_length(x))).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))
