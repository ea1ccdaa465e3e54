import random
import re

from tilewright.llm import url_filter


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def judged(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


def run(spark, urls, rules, ranges=4):
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, key string")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    got = url_filter.judge(df, r, ranges=ranges).collect()
    assert len(got) == len(urls) and all(x.key == "own" for x in got)
    return {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got}


def test_query_is_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op2_url_filter(spark, sf).collect()}
    assert got == {r.page_id: judged(r.url, url_filter.RULES) for r in pages}


def test_nested_rules_at_random(spark):
    rng = random.Random(3)
    labels = ["com", "org", "a", "a-b", "b", "www", "x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/en", "/de", "7", "x"]) for _ in range(rng.randint(0, 4)))
    rules = list({(host(), path()): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http{rng.choice(['', 's'])}://{host()}{path()}{rng.choice(['', '?q=1', '#f', '/?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://A.COM/en", "http://a.com:80/en", "http://u@a.com/", "http://a.com\n/x\ny", "x://y://z.com/q", "http://a.com."] + ["http://hot.a.com/en"] * 300
    got = run(spark, urls, rules, ranges=7)
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_no_rules_no_urls(spark):
    assert run(spark, ["http://a.com/x"], []) == {0: ("a.com", "/x", None, "allow")}
    assert run(spark, [], [("com", "/", "block")]) == {}


def test_equal_rules_of_opposite_action(spark):
    assert run(spark, ["http://a.com/x"], [("com", "/x", "allow"), ("com", "/x", "block")])[0][3] == "block"


def test_clashing_columns_and_long_urls(spark):
    """Columns named like the new ones are replaced, others stay; a url of a megabyte is judged whole."""
    long = "http://deep." + "a." * 200_000 + "com/" + "x" * 500_000 + "/en"
    urls = [long, "http://deep.a.com/en/1", None]
    df = spark.createDataFrame([(i, u, "h", "p", 5, "v", "s", 7) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule int, verdict string, stack string, part long")
    r = spark.createDataFrame([("com", "/", "block"), ("a.com", "/" + "x" * 400_000, "allow")], "host string, path string, action string")
    got = url_filter.judge(df, r)
    assert got.columns == ["page_id", "url", "stack", "part", "host", "path", "rule", "verdict"]
    by = {x.page_id: x for x in got.collect()}
    want = [judged(u, [("com", "/", "block"), ("a.com", "/" + "x" * 400_000, "allow")]) for u in urls]
    assert [(by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in range(3)] == want and by[0].verdict == "allow"
    assert {(x.stack, x.part) for x in by.values()} == {("s", 7)}
