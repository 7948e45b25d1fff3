import random

from pyspark.sql import types as T

from lectern.llm import urlrules

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def check(spark, urls, rules, default="allow"):
    schema = "page_id long, url string, rule string, rid long, key string, at string, said string, row string"
    df = spark.createDataFrame([(i, u, "x", i, "k", "a", "s", "r") for i, u in enumerate(urls)], schema)
    out = urlrules.judge(df, spark.createDataFrame(rules, RULES), default=default)
    assert out.columns == ["page_id", "url", "rid", "key", "at", "said", "row", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules, default), r


def test_against_brute_force(spark):
    rng = random.Random(5)
    names, ways = ["a", "b", "aa", "a-b", "x.y", "", "é"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/é", "a"]

    def host():
        return ".".join(rng.choice(names) for _ in range(rng.randint(1, 4)))

    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice(ways)) for _ in range(120))}.values())
    urls = [f"{rng.choice(['http', ''])}://{host()}{rng.choice(ways)}{rng.choice(['', '/x', 'b', '?q=/a#', '#/a'])}" for _ in range(1500)]
    check(spark, urls, rules)


def test_many_ranges_and_a_hot_host(spark):
    """A third of all urls are one url; rules stay open over whole ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rules = [("com", "/", "allow"), ("com", "/a", "block"), ("com", "/a/b/c", "allow"), ("z.com", "/q", "block"), ("com", "/zz", "block")]
        urls = [f"http://h{i % 40}.com/a/b/{i}" for i in range(400)] + ["http://hot.com/a/b/c"] * 400 + [f"http://z.com/q{i}" for i in range(300)]
        check(spark, urls, rules, default="block")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_of_urls(spark):
    check(spark, [None, "", "no scheme", "http://", "HTTP://EX.Org", "a://b://c/d", "http://ex.org:80/x", "http://u@ex.org/x", "http://.ex.org/x", "http://ex.org./x",
                  "http://ÄX.org/x\ny?z", "http://ex.org?x/y", "http://ex.org#/y", "http://ex.org/" + "p" * 50_000, "http://" + "l." * 3000 + "ex.org/x"],
          [("ex.org", "", "block"), ("org", "/x\ny", "block"), ("ex.org", "/" + "p" * 40_000, "allow")])


def test_equal_rules_null_rules_and_empty_tables(spark):
    rules = spark.createDataFrame([("EX.org", "/", "allow"), ("ex.org", "/", "block"), (None, "/", "block"), ("ex.org", None, "block"), ("ex.org", "/a", None)], RULES)
    urls = spark.createDataFrame([(1, "http://ex.org/a")], "page_id long, url string")
    assert urlrules.judge(urls, rules).first()["verdict"] == "block"
    assert urlrules.judge(urls, rules.limit(0)).first()["verdict"] == "allow"
    empty = urlrules.judge(urls.limit(0), rules)
    assert empty.count() == 0 and empty.schema["host"].dataType == T.StringType()
