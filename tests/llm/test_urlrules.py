import random

from tidemark.llm.queries import URL_RULES
from tidemark.llm.urlrules import judge_urls, literal_rules

SCHEMA = "page_id bigint, url string, host string, path string, rule string, verdict string, key string, block int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    stop = min((rest.index(c, end) for c in "?#" if c in rest[end:]), default=len(rest))
    return host, rest[end:stop]


def slow(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        host, path = parts(url)
        best = None
        for verdict, h, p in rules:
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (-1,), (len(h + p), len(h), verdict == "block", h + p))
        out.append((page, host, path, best and best[3], ("block" if best[2] else "allow") if best else default))
    return sorted(out, key=repr)


def judged(spark, urls, rules, default="allow"):
    rows = [(i, u, "h", "p", "r", "v", "k", 1) for i, u in urls]
    found = judge_urls(spark.createDataFrame(rows, SCHEMA), literal_rules(spark, rules), default)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_random_rules_and_urls(spark):
    source = random.Random(1)
    labels, steps = ["com", "net", "a", "b", "www", "x-y", ""], ["", "/", "/a", "/a/", "/a/b", "/b?q", "/é"]
    for size in (1, 5, 60):
        rules = list({(source.choice(["allow", "block"]), ".".join(source.choice(labels[:6]) for _ in range(source.randrange(1, 4))),
                       source.choice(steps[:5])) for _ in range(size)})
        urls = [(i, source.choice(["http://", "https://", "", "x://y://"]) + ".".join(
            source.choice(labels).upper() if source.random() < 0.1 else source.choice(labels) for _ in range(source.randrange(1, 5)))
            + source.choice(steps) + source.choice(["", "#f", "?q=/a", "/a\nb"])) for i in range(300)]
        assert judged(spark, urls, rules, "block") == slow(urls, rules, "block")


def test_odd_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://"), (5, "http://Example.COM/en/"), (5, "http://Example.COM/en/"),
            (None, "https://www.example.com/en/x#y"), (6, "http://notexample.com/en/"), (7, "http://a.www.example.com/en/" + "z" * 5000),
            (8, "http://example.com:80/en/"), (9, "ftp://a.net/es/"), (10, "http://net/fr/?x"), (11, "http://..com/en")]
    assert judged(spark, urls, URL_RULES) == slow(urls, URL_RULES)
    assert judged(spark, [], URL_RULES) == []
    nothing = literal_rules(spark, URL_RULES).limit(0)
    rows = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert [tuple(r) for r in judge_urls(rows, nothing).collect()] == [(1, "a.com", "/", None, "allow")]


def test_plan_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = judge_urls(pages, literal_rules(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
