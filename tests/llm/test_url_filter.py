import random

import duckdb

from veilscan.llm import url_filter as U


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules, **how):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(df, spark.createDataFrame(list(rules), "action string, host string, path string"), **how).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_cases(spark):
    urls = [None, "", "no scheme/x", "http://", "https://WWW.Example.com/en/1?q#f", "http://example.com/en", "http://badexample.com/en/", "x://a.b.net/fr/", "http://net/es/", "http://net?/es/", "http://é.com/", "http://com/a#://net/es/", "http://example.com./en/", "a" * 100_000, "http://" + "a." * 500 + "net/fr/" + "x" * 5000]
    check(spark, urls, U.RULES)
    check(spark, urls, U.RULES, ranges=7)


def test_random_rules_over_many_ranges(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "a-b", "z"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(80))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(1500)] + ["http://a.b/x"] * 600
    check(spark, urls, rules, ranges=9)


def test_empty_tables(spark):
    check(spark, [], U.RULES)
    check(spark, ["http://a.net/es/"], [])


def test_whole_table_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as from '{d}/pages.parquet'")
    got = sorted(map(tuple, U.query(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == sorted(con.execute(U.SQL).fetchall()) and len(got) > 0
