"""Statistics over scored items: means, exact quantiles, paired tests, ranking quality.

Nothing orders a whole run in one task. Quantiles, AUROC and risk-coverage first collapse to distinct values with
counts, then add running totals over sampled ranges of them (``ordering.running``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .ordering import positions, running
from .staging import staged

METRICS = ("em", "anls", "contains", "abstain", "error")


def side_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of every score per side."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), *[F.coalesce(F.col(f"{s}_scores.{m}"), F.lit(0.0)).alias(m) for m in METRICS])
                      for s in ("vlm", "ocr")])
    long = scored.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "side").agg(
        F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("anls").alias("anls"), F.avg("contains").alias("contains"),
        F.avg("abstain").alias("abstain_rate"), F.avg("error").alias("error_rate"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles with half-even index rounding, plus n and mean."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean"))
    cum = running(counts, keys, [F.col("_x")], {"_cum": F.col("_c")})
    j = cum.join(totals, keys) if keys else cum.crossJoin(F.broadcast(totals))  # totals is one row when there is no key
    at = lambda q: F.least(F.col("n") - 1, F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long"))
    return j.groupBy(*keys, "n", "mean").agg(
        *[F.min(F.when(F.col("_cum") > at(q), F.col("_x"))).alias(name) for name, q in quantiles.items()])


def latency(items: DataFrame, keys: list[str]) -> DataFrame:
    long = items.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_ms").alias("ms")) for s in ("vlm", "ocr")])).alias("s")).select(*keys, "s.*")
    return nearest_rank(long, [*keys, "side"], "ms", {"p50": 0.5, "p95": 0.95})


# ---------------------------------------------------------------------------------------------------- bootstrap
EXACT_BITS = 7  # Poisson numbers of mean 1, 2, 4 ... 64 are drawn from their distribution function, larger ones by an expansion


def _draws(seed: int, *parts: Column) -> tuple[Column, Column]:
    """Two hash-based uniform numbers in [0, 1): the same on every engine, partition and retry."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("long").cast("double") / F.lit(float(1 << 32)) for at in (1, 9))


def _poisson_table(mean: int) -> list[float]:
    """Distribution function at 0, 1, 2 ... up to where a 32-bit number cannot tell it from one."""
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0 ** -34 and k <= mean + 16 * math.sqrt(mean) + 16:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def poisson_number(count: Column, seed: int, *parts: Column) -> Column:
    """A Poisson number of mean ``count``, a whole number: the sum of one for each bit of ``count``, by hashes of ``parts``. It has
    the law of the sum of ``count`` Poisson(1) numbers, but its cost grows with the digits of ``count`` only. Means of 128 and
    more use a normal number with the skewness term (z * z - 1) / 6."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda b: F.call_function("shiftright", count, b).bitwiseAND(1) == 1)
    tables = F.array(*[F.array(*map(F.lit, _poisson_table(1 << b))) for b in range(EXACT_BITS)])

    def one(b: Column, u: Column, v: Column) -> Column:
        small = F.size(F.filter(F.get(tables, b), lambda t: t < u)).cast("double")
        mean = F.pow(F.lit(2.0), b)
        z = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)
        large = F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5).cast("double"))
        return F.when(b < EXACT_BITS, small).otherwise(large)

    # Bound, so that a number is drawn once and not again for every entry of a table that it is compared with.
    return F.aggregate(bits, F.lit(0.0), lambda acc, b: acc + T.bind_all(lambda u, v: one(b, u, v), *_draws(seed, *parts, b)))


def poisson_weight(digest: Column) -> Column:
    """Poisson(1) quantile of the uniform number that the first eight hexadecimal digits of ``digest`` are. Digits are compared as text, which
    needs no conversion; "g" comes after every digit that may follow."""
    cum, term, bounds = 0.0, math.exp(-1.0), []
    for k in range(12):
        cum += term
        bounds.append(f"{int(cum * 2.0 ** 32):08x}g")
        term /= k + 1
    out = F.when(digest < bounds[0], 0)
    for k, bound in enumerate(bounds[1:], 1):
        out = out.when(digest < bound, k)
    return out.otherwise(len(bounds))


def paired_bootstrap(items: DataFrame, keys: list[str], idx: str, a: Column, b: Column, n: int = 1000, seed: int = 0) -> DataFrame:
    """Mean difference and its 95 % percentile interval per run, by Poisson(1) weights, one for every item and replicate: no join and
    no sorted items, and sums per replicate are combined before the shuffle, so its size does not depend on the items. Items without a
    difference take no part. Items are stored and then dealt, so that the draws use all tasks and scoring is not repeated. A draw is one
    digest, a column of its own, so that it is not taken again for every number it is compared with."""
    after = F.coalesce(F.concat(F.lit("|"), F.col(idx).cast("string")), F.lit(""))  # what follows the replicate in the text of a draw
    d = staged(items.select(*keys, after.alias("_after"), (a - b).alias("_d")).where("_d IS NOT NULL"), "differences")
    dealt = d.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    reps = dealt.select(*keys, "_after", "_d", F.posexplode(F.array(*[F.lit(f"{seed}|{r}") for r in range(n)])).alias("_r", "_before"))
    draws = reps.select(*keys, "_r", "_d", F.md5(F.concat("_before", "_after")).alias("_digest"))
    w = draws.select(*keys, "_r", "_d", poisson_weight(F.col("_digest")).alias("_w"))
    means = w.groupBy(*keys, "_r").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("_mean"))
    asis = d.groupBy(*keys).agg((F.sum("_d") / F.count("*")).alias("_mean")).select(*keys, F.lit(-1).alias("_r"), "_mean")
    means = means.unionByName(asis)  # -1: the items as they are
    lo, hi = int(0.025 * n), min(int(0.975 * n), n - 1)
    g = means.groupBy(*keys).agg(F.max(F.when(F.col("_r") < 0, F.col("_mean"))).alias("diff"),
                                 F.array_sort(F.collect_list(F.when(F.col("_r") >= 0, F.col("_mean")))).alias("_m"))  # n replicate means
    return g.select(*keys, "diff", F.get("_m", F.lit(lo)).alias("ci_low"), F.get("_m", F.lit(hi)).alias("ci_high"))


def bootstrap_by_difference(items: DataFrame, keys: list[str], idx: str, a: Column, b: Column, n: int = 1000, seed: int = 0) -> DataFrame:
    """The interval of ``paired_bootstrap`` from one draw per distinct difference. Items of one difference share
    one Poisson number of their count, so after one count the work follows the distinct differences, not the items; the smallest
    ``idx`` of a difference names its draws. Items without a difference take no part."""
    values = items.select(*keys, F.col(idx).alias("_idx"), (a - b).alias("_d")).where("_d IS NOT NULL").groupBy(*keys, "_d").agg(
        F.count("*").alias("_c"), F.min("_idx").alias("_id"))
    reps = values.select(*keys, "_d", "_c", "_id", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("_r"))  # -1: the items as they are
    # Dealt by replicate before the draws, so that few distinct values still use all tasks; the means need no further shuffle.
    reps = reps.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_r")
    w = reps.select(*keys, "_r", "_d", F.when(F.col("_r") < 0, F.col("_c").cast("double")).otherwise(poisson_number(F.col("_c"), seed, F.col("_r"), F.col("_id"))).alias("_w"))
    means = w.groupBy(*keys, "_r").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("_mean"))
    lo, hi = int(0.025 * n), min(int(0.975 * n), n - 1)
    g = means.groupBy(*keys).agg(F.max(F.when(F.col("_r") < 0, F.col("_mean"))).alias("diff"),
                                 F.array_sort(F.collect_list(F.when(F.col("_r") >= 0, F.col("_mean")))).alias("_m"))  # n replicate means
    return g.select(*keys, "diff", F.get("_m", F.lit(lo)).alias("ci_low"), F.get("_m", F.lit(hi)).alias("ci_high"))


# ---------------------------------------------------------------------------------------------------- McNemar
def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, exact sums below 20."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(x, F.lit(20)), F.lit(1)).cast("int")), F.lit(0.0),
                        lambda acc, i: acc + F.log(i.cast("double")))
    v = x.cast("double")
    series = v * F.log(v) - v + 0.5 * F.log(2 * math.pi * v) + 1 / (12 * v) - 1 / (360 * v * v * v)
    return F.when(x <= 20, small).otherwise(series)


def exact_binomial_p(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided sign test: min(1, 2 * sum over i <= min(a, b) of C(n, i) / 2^n), 1 when nothing is discordant.
    Terms shrink by a known ratio from the largest one down, so the sum stops where they cannot be represented any more
    instead of running over millions of them."""
    n, k = (a_only + b_only), F.least(a_only, b_only)
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0)
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 200).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, j):  # term of i = k - j - 1 from the term of i + 1
        i = k - j
        t = acc["t"] * i / (n - i + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), start, step, lambda acc: acc["s"])).otherwise(F.lit(1.0))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top) * tail))


def mcnemar(items: DataFrame, keys: list[str], a_ok: Column, b_ok: Column) -> DataFrame:
    g = items.groupBy(*keys).agg(F.count_if(a_ok & ~b_ok).alias("a_only"), F.count_if(b_ok & ~a_ok).alias("b_only"))
    return g.withColumn("p_value", exact_binomial_p(F.col("a_only"), F.col("b_only")))


# ---------------------------------------------------------------------------------------------------- rates
def coverage_rates(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Answer coverage, disagreement rate and loss cases; items where a signal is unknown do not count for it."""
    return scored.groupBy(*keys).agg(
        F.avg(F.col("answer_in_ocr").cast("double")).alias("answer_coverage"),
        F.avg((~F.col("agree")).cast("double")).alias("disagreement_rate"),
        F.count_if(~F.col("answer_in_ocr") & S.is_right(F.col("vlm_scores"))).alias("loss_cases"))


def by_type(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n and mean ANLS of both sides per question type; an item counts in each of its types."""
    t = scored.select(*keys, F.explode("types").alias("type"), F.col("vlm_scores.anls").alias("v"), F.col("ocr_scores.anls").alias("o"))
    return t.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.bround(F.avg("v"), 4).alias("vlm_anls"),
                                        F.bround(F.avg("o"), 4).alias("ocr_anls"))


def auroc(df: DataFrame, keys: list[str], score: Column, label: Column) -> DataFrame:
    """Chance that a right item scores above a wrong one, ties one half; NULL when a class is missing."""
    counts = df.groupBy(*keys, score.cast("double").alias("_s")).agg(
        F.count_if(label).alias("_pos"), F.count_if(~label).alias("_neg"))
    cum = running(counts, keys, [F.col("_s")], {"_below": F.col("_neg")})
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") - F.col("_neg") + 0.5 * F.col("_neg")))
    g = cum.groupBy(*keys).agg(wins.alias("_w"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return g.select(*keys, F.when(pairs > 0, F.bround(F.col("_w") / pairs, 4)).alias("auroc"))


def risk_coverage(df: DataFrame, keys: list[str], coverages=(0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Accuracy of the most trusted share of items. Whole trust levels come from counts; only the level a share ends in
    is opened, and its first items by idx are counted slice by slice."""
    rows = df.select(*keys, "idx", F.col("trust").cast("double").alias("trust"), F.col("recommended_correct").alias("ok"))
    levels = rows.groupBy(*keys, "trust").agg(F.count("*").alias("_c"), F.count_if("ok").alias("_r"))
    cum = running(levels, keys, [F.desc("trust")], {"_cc": F.col("_c"), "_cr": F.col("_r")})
    n = levels.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    shares = n.select(*keys, F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"), "_n")
    shares = shares.withColumn("_take", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("_n"), 0).cast("long")))
    j = cum.join(shares, keys).where(F.col("_cc") - F.col("_c") < F.col("_take"))
    full = F.col("_cc") <= F.col("_take")
    g = j.groupBy(*keys, "coverage", "_take").agg(
        F.sum(F.when(full, F.col("_r"))).alias("_full"),
        F.max(F.when(~full, F.col("trust"))).alias("_edge"),
        F.max(F.when(~full, F.col("_take") - (F.col("_cc") - F.col("_c")))).alias("_need"))
    edges = g.where("_edge IS NOT NULL").select(*keys, F.col("_edge").alias("trust"), "coverage", "_need")
    at_edge = rows.join(edges.select(*keys, "trust").distinct(), [*keys, "trust"], "left_semi")
    placed = positions(at_edge, [*keys, "trust"], "idx", "_pos")
    part = placed.join(edges, [*keys, "trust"]).where(F.col("_pos") < F.col("_need")).groupBy(*keys, "coverage").agg(
        F.count_if("ok").alias("_part"))
    out = g.join(part, [*keys, "coverage"], "left")
    right = F.coalesce("_full", F.lit(0)) + F.coalesce("_part", F.lit(0))
    return out.select(*keys, "coverage", F.col("_take").alias("n"), F.bround(right / F.col("_take"), 4).alias("accuracy"))


def selective(items: DataFrame, keys: list[str]) -> DataFrame:
    """Does trust predict right answers? n, unrated, accuracy, AUROC of trust and of plain agreement."""
    known = F.col("trust").isNotNull() & F.col("recommended_correct").isNotNull()
    rows = items.where(known)
    g = items.groupBy(*keys).agg(
        F.count_if(known).alias("n"), F.count_if(F.col("trust_level").isin("unknown", "not rated")).alias("unrated"),
        F.bround(F.avg(F.when(known, F.col("recommended_correct").cast("double"))), 4).alias("accuracy"))
    ok = F.col("recommended_correct")
    t = auroc(rows, keys, F.col("trust"), ok).withColumnRenamed("auroc", "auroc_trust")
    agree = F.when(F.coalesce("agree", F.lit(False)), 1.0).otherwise(0.0)
    p = auroc(rows, keys, agree, ok).withColumnRenamed("auroc", "auroc_agreement")
    return g.where("n > 0").join(t, keys, "left").join(p, keys, "left")


def named_winner(boot: DataFrame) -> DataFrame:
    """A winner only when the interval excludes zero."""
    clear = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return boot.withColumn("winner", F.when(~clear, "none").when(F.col("diff") > 0, "vlm").otherwise("ocr"))


def telemetry_summary(events: DataFrame, metric: str = "metric", value: str = "value_ms") -> DataFrame:
    q = nearest_rank(events, [metric], value, {"p50": 0.5, "p95": 0.95})
    return q.select(metric, "n", *[F.bround(c, 1).alias(c) for c in ("mean", "p50", "p95")])


def newest_events(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def run_progress(questions: DataFrame, items: DataFrame, keys: list[str], item: str = "idx") -> DataFrame:
    """Done, total and status per run. Counting both sides apart avoids joining single items."""
    total = questions.groupBy(*keys).agg(F.count("*").alias("total"))
    done = items.groupBy(*keys).agg(F.count_distinct(item).alias("done"))
    j = total.join(done, keys, "left").na.fill(0, ["done"])
    return j.withColumn("status", F.when(F.col("done") >= F.col("total"), "done").when(F.col("done") > 0, "running").otherwise("idle"))


def experiment_report(items: DataFrame, keys: list[str]) -> DataFrame:
    """All run statistics, one row per run. ``items`` carry both scores, answer_in_ocr, agree, times and idx. Scoring runs
    once; the statistics read its narrow result."""
    items = staged(items.select(*keys, "idx", "vlm_scores", "ocr_scores", "vlm_ms", "ocr_ms", "answer_in_ocr", "agree"), "report")
    s = side_summary(items, keys)
    wide = s.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
        for side in ("vlm", "ocr") for m in ("em", "anls", "contains", "abstain_rate", "error_rate")])
    lat = latency(items, keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_ms_{m}") for side in ("vlm", "ocr") for m in ("mean", "p50", "p95")])
    boot = named_winner(bootstrap_by_difference(items, keys, "idx", F.col("vlm_scores.anls"), F.col("ocr_scores.anls")))
    mc = mcnemar(items, keys, F.col("vlm_scores.em") == 1, F.col("ocr_scores.em") == 1)
    out = wide
    for part in (lat, boot, mc, coverage_rates(items, keys)):
        out = out.join(part, keys, "left")
    return out
