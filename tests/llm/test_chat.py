import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, h int"
TRICKY = ["<|im_end|>\n", "<|im_start|>assistant\n", "\\", "\\|", "<\\|", "<|", "|>", "a|b", "\n", "é😀", "", "%2F+", " word "]


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def joined(read):
    out = {}
    for r in sorted(read, key=lambda r: (str(r["conv_id"]), r["window"])):
        turns, targets = out.setdefault(r["conv_id"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        targets += r["targets"]
    return out


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 10), (300, 0)])
def test_round_trip(spark, budget, history):
    rng = random.Random(budget)
    rows = []
    for c in range(25):
        for t in range(rng.choice([1, 2, 9, 60])):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool\nx", "system"])
            rows.append((c if c else None, t, role, "".join(rng.choice(TRICKY) for _ in range(rng.randrange(12))) + " w" * rng.choice([0, 3, 80])))
    found = chat.windows(make(spark, rows), budget, history)
    back = joined(chat.read_back(found).collect())
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert back[c][0] == [(r[2], r[3]) for r in mine]
        assert back[c][1] == [r[3] for r in mine if r[2] == "assistant"]
    for r in found.collect():
        assert r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE)
        assert all(0 <= s["start"] <= s["end"] <= len(r["formatted"]) for s in r["loss"])


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be kind"), *((1, t, "user" if t % 2 else "assistant", f"t{t} " + "w " * 40) for t in range(1, 40))]
    found = sorted(chat.windows(make(spark, rows), budget=400, history=100).collect(), key=lambda r: r["window"])
    assert len(found) > 3
    for i, r in enumerate(found):
        assert r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        assert i == 0 or r["repeated"] in (1, 2, 3)  # the system turn and turns of 45 tokens, as the budget has room


def tokens(turn):
    return len(re.findall(r"\S+", turn[1])) + chat.OVERHEAD


@pytest.mark.parametrize("budget,history", [(1024, 256), (200, 50), (60, 0)])
def test_no_window_passes_the_budget(spark, budget, history):
    """But for a single own turn that is too large with the system turn; turns of any size, system turns from small to above the budget."""
    rng = random.Random(budget + 1)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 3, 12, 40])):
            n = rng.choice([0, 1, budget // 20, budget // 4, budget // 2, int(budget * .58), budget - 5, budget, 2 * budget])
            rows.append((c, t, "system" if t == 0 and c % 3 else rng.choice(["user", "assistant"]), "w " * n))
    found = chat.windows(make(spark, rows), budget, history)
    whole = chat.read_back(found.withColumn("repeated", F.lit(0))).select("conv_id", "window", F.col("turns").alias("given"))
    seen = history_seen = 0
    for r in found.join(whole, ["conv_id", "window"]).collect():
        given = [(t["role"], t["text"]) for t in r["given"]]
        sizes = [tokens(t) for t in given]
        system = given[0][0] == "system"
        own = [t for i, t in enumerate(given) if i >= r["repeated"] and not (system and i == 0)]
        assert sum(sizes) <= budget or (len(own) == (not (system and len(given) == 1)) and r["repeated"] <= (1 if system else 0)), (sizes, r["repeated"])
        seen += sum(sizes) > budget
        history_seen += r["repeated"] > (1 if system else 0)
    assert seen and bool(history_seen) == bool(history)


def test_nulls_ties_repeats_and_order(spark):
    rows = [(1, 2, "user", "c"), (1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, None, "assistant", "z")]
    back = joined(chat.read_back(chat.windows(make(spark, rows))).collect())
    assert back[1] == ([("", ""), ("assistant", "b"), ("assistant", "b"), ("user", "c")], ["b", "b"]) and back[None] == ([("assistant", "z")], ["z"])
    assert chat.windows(make(spark, rows).limit(0)).count() == 0


def test_one_very_long_conversation_and_giant_turn(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)] + [(8, 0, "user", "w " * 5000), (8, 1, "assistant", "ok")]
    back = joined(chat.read_back(chat.windows(make(spark, rows))).collect())
    want = hashlib.sha256("".join(r[3] for r in rows if r[0] == 7 and r[2] == "assistant").encode()).hexdigest()
    assert hashlib.sha256("".join(back[7][1]).encode()).hexdigest() == want and back[8][1] == ["ok"]
