import random

from claimweave.llm import urlfilter

SCHEMA = "page_id long, url string, host string, rule string"


def slow(url, rules, default="allow"):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = "example.com EXAMPLE.com a.example.com badexample.com example.net x.y.net example.org com net .com com. a..net".split()
    paths = ["", "/", "/en/", "/en/7", "/en/77/x", "/de/8", "/de/", "/es/x?q=/en/", "?x=/en/7", "#/es/", "/en/7#a?b", "/EN/7", "/en"]
    urls = [f"{s}{rng.choice(hosts)}{p}" for p in paths for s in ("http://", "https://", "x", "://", "a://b://") for _ in range(4)]
    urls += [None, "", "://", "http://", "é://exämple.com/en/é", "http://com/en/" + "y" * 50_000] + ["http://example.com/en/1"] * 20
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {i: slow(u, urlfilter.RULES) for i, u in enumerate(urls)}


def test_only_native_operators(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "h", "r")], SCHEMA)
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    plan = urlfilter.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_empty_tables(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    assert urlfilter.judge_urls(spark.createDataFrame([], SCHEMA), rules).collect() == []
    page = spark.createDataFrame([(1, "http://a.com/en/", "h", "r")], SCHEMA)
    assert tuple(urlfilter.judge_urls(page, rules.limit(0)).first()) == (1, "a.com", "/en/", None, "allow")
