import random
import re

from compare import difference, duck

from tracewright.llm import queries
from tracewright.llm import urlfilter as u


def test_patterns():
    r = lambda p, url: bool(re.search(u.parse(p).regex, url))
    assert r("||ads.", "http://ads.x.com/") and r("||ads.", "https://m.ads.x.com/a") and not r("||ads.", "http://x.com/ads.")
    assert r("/cart^", "http://x/cart") and r("/cart^", "http://x/cart?y") and not r("/cart^", "http://x/carts")
    assert r(".exe|", "http://x/a.exe") and not r(".exe|", "http://x/a.exe?z")
    assert r("|http://*.net/", "http://a.net/") and not r("|http://*.net/", "https://a.net/")


def test_tokens_are_whole_in_any_match():
    assert u.parse("/banners/*.gif|").tokens == ("banners", "gif")
    assert u.parse("spam-*.example.").tokens == ("example",)
    assert u.parse("ads").tokens == ()
    assert u.parse("||ads.").tokens == ("ads",)


def test_against_every_rule_on_every_url(spark, none):
    r = random.Random(5)
    parts = ["ads", "spam", "example", "com", "en", "13x.html", "cart", "login", "track", "pixel", "banners", "a.gif", "a.exe", "x"]
    urls = [(i, f"http{r.choice(['', 's'])}://" + ".".join(r.choice(parts) for _ in range(3)) + "/" + r.choice(["/", "-", "?"]).join(r.choice(parts) for _ in range(3))) for i in range(400)]
    urls += [(None, "http://ads.example.com/"), (900, None), (901, ""), (902, "HTTP://ADS.EXAMPLE.COM/"), (902, "HTTP://ADS.EXAMPLE.COM/")]
    patterns = (*u.RULES, "x", "a", "@@/en/")
    want = sorted((str(i), " ".join(sorted(p for p in dict.fromkeys(patterns) if url and re.search(u.parse(p).regex, url.lower())))) for i, url in urls)
    df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' as rules", "1 as u")
    for size in (u.SLICE_RULES, 10):
        assert sorted((str(r.page_id), r.rules) for r in u.apply(df, patterns, size).collect()) == want
    assert u.apply(df.limit(0)).count() == 0


def test_rule_lists():
    text = """[Adblock Plus 2.0]
! a comment
||ads.example.com^
||ads.example.com^
/banner/*.gif|
example.com##.ad
@@||good.example^
||x.example^$third-party,script
/ad[0-9]+x/
/plain/
"""
    assert u.rules_of(text) == ("||ads.example.com^", "/banner/*.gif|", "@@||good.example^", "/plain/")


def test_very_long_urls_and_odd_columns(spark):
    long = "http://a.example.com/" + "en/" * 100_000 + "login?x"
    df = spark.createDataFrame([("p1", long, 1, 2), ("p2", long + "=", 1, 2)], "page_id string, url string, `a.b` int, URL int")
    assert {(r.page_id, r.rules, r.action) for r in u.apply(df).collect()} == {("p1", "/login^", "block"), ("p2", "/login^", "block")}


def test_rarest_token_is_the_index():
    rules = [u.parse("/en/casino/"), u.parse("x")]
    assert u.index(rules, {"en": 50, "casino": 2}) == ({"casino": [0]}, [1])


def test_sql(spark, sf):
    assert not difference(queries.op5_url_filter(spark, sf), duck(sf), queries.oracle_sql()["op5_url_filter"])
