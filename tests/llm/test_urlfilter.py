import random

from leafmill.llm import urlfilter
from pyspark.sql import functions as F


def brute(url, rules=urlfilter.RULES):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for action, key in rules:
        h, p = key.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(key) > len(best[1])):
            best = (action, key)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.org/x", "http://xorg/x", "https://example.org/es/1", "https://example.org/esx", "https://Example.ORG/en/17?x#y", "https://example.org/en/2",
        "http://m.example.org/en/1", "http://badexample.org/en/1", "http://example.com/fr/", "http://example.com/de/9#f", "http://example.com?/de/", "http://example.com#://x.org/", "a://b://c.org/", "http://..org/", "http://example.com:80/de/",
        "http://m.casino-win.example.com/en/1", "http://casino-win.example.org/en/9", "http://É.org/ä?ö", "http://user@org/", "http://a\nb.org/c\nd?e"]


def test_verdicts_equal_brute_force(spark):
    r = random.Random(6)
    urls = URLS + ["http://" + ".".join(r.choice(["org", "com", "example", "m", ""]) for _ in range(r.randint(1, 4))) + "/" + "/".join(r.choice(["es", "en", "1", "fr", "de", ""]) for _ in range(r.randint(0, 4))) for _ in range(300)]
    urls += ["http://hot.example.org/es/"] * 50
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string").withColumn("key", F.lit(1))
    got = {x.page_id: x for x in urlfilter.judge(df, urlfilter.listed_table(spark)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, action = brute(u)
        site = any(host == f"{s}.{d}" or host.endswith(f".{s}.{d}") for s in urlfilter.SITES for d in urlfilter.DOMAINS) and path.startswith("/")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, action or ("block" if site else "allow")), u


def test_long_lists_and_false_positives(spark):
    rules = tuple((("allow", "block")[i % 2], f"h{i}.net/{i % 7}") for i in range(3000))
    listed = urlfilter.listed_table(spark, rules, sites=())
    urls = [f"http://h{i}.net/{j}" for i in range(0, 6000, 5) for j in (i % 7, 8)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = {k: a for a, k in rules}
    tight = urlfilter.MAX_WORDS
    try:
        urlfilter.MAX_WORDS = 64
        got = {x.page_id: x for x in urlfilter.judge(df, listed).collect()}
    finally:
        urlfilter.MAX_WORDS = tight
    for i, u in enumerate(urls):
        key = u.removeprefix("http://")
        assert got[i].rule == (key if key in table else None) and got[i].verdict == table.get(key, "allow")


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, urlfilter.listed_table(spark)).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urlfilter.judge(one, urlfilter.listed_table(spark, (), ())).first().verdict == "allow"


def test_a_long_list_filters_before_anything_moves(spark):
    listed = spark.range(200_000).selectExpr("concat('h', id, '.net/') AS key", "'block' AS action", "false AS is_rule")
    bloom = urlfilter.Filter(listed)
    assert bloom.n_words * 64 >= 16 * 200_000
    other = spark.range(200_000, 220_000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("key"))
    assert other.where(bloom.may_hold(F.col("key"))).count() < 0.02 * 20_000
    own = listed.where(bloom.may_hold(F.col("key")))
    assert own.count() == 200_000
    df = spark.createDataFrame([(i, f"http://h{i}.net/x") for i in range(199_990, 200_010)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, listed).collect()}
    assert got == {i: "block" if i < 200_000 else "allow" for i in range(199_990, 200_010)}


def test_plan_probes_below_every_exchange(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urlfilter.judge(df, urlfilter.listed_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    first = urlfilter.judge(df, urlfilter.listed_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert first.startswith("Union")
