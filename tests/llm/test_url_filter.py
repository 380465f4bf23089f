from oracle import same_as_sql
from pairshift.llm import url_filter as uf
from pairshift.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_whole_table(spark):
    assert same_as_sql(spark, "op10_url_filter") == 250


def test_odd_urls_and_nested_rules(spark, monkeypatch):
    rules = [*URL_RULES, ("a.example.net", "/", "allow"), ("b.a.example.net", "/en/x", "block"), ("net", "/en/", "allow"), ("éa.org", "", "block")]
    urls = [None, "", "no scheme", "://", "http://", "HTTP://X.NET/", "http://net/", "http://net", "http://net?x/", "http://xnet/", "https://q.b.a.example.net/en/xyz",
            "https://b.a.example.net/en/", "https://a.example.net/de/", "https://zz.example.net/en/1#/de/", "http://example.com/de", "http://example.com/de/?a://b/c",
            "http://w.example.com/de/\n/x", "a://b.org/fr/x://c.net/", "http://éA.org", "http://ÉA.org/fr/", "http://example.net./en/", "http://.net/", "x://a..net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/"), (0, "http://a.net/"), (0, "http://a.net/")]
    df = spark.createDataFrame(rows * 3, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS strip", "2 AS key", "3 AS id").repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(str((i, *brute(u, rules))) for i, u in rows * 3)
    for size in (uf.RANGE_ROWS, 7):
        monkeypatch.setattr(uf, "RANGE_ROWS", size)
        assert sorted(str(tuple(r)) for r in uf.url_verdicts(df, table).collect()) == want


def test_long_rule_list_and_a_hot_host(spark, monkeypatch):
    """Long rule lists cut the keys into ranges all the same, a third of the urls on one host covers several of them."""
    rules = [(f"h{i % 700}.d{i % 13}.org", f"/{'abc'[i % 3]}/", "block" if i % 2 else "allow") for i in range(1500)] + [("org", "/", "block"), ("hot.net", "/x", "allow"), ("net", "/", "block")]
    urls = [f"http://{'hot.net' if i % 3 == 0 else f'w.h{i % 700}.d{i % 13}.org'}/{'abcx'[i % 4]}/{i}" for i in range(3000)] + ["http://" + "a." * 3000 + "net/" + "y" * 50000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    monkeypatch.setattr(uf, "RANGE_ROWS", 200)
    seen = []
    monkeypatch.setattr(uf, "in_ranges", lambda *a, f=uf.in_ranges: seen.append(f(*a)) or seen[0])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_verdicts(df, table).collect()}
    by_pair = {}
    for h, p, v in rules:  # of equal rules block wins
        by_pair[h, p] = max(v, by_pair.get((h, p), v))
    flat = [(h, p, v) for (h, p), v in by_pair.items()]
    assert got == {i: brute(u, flat) for i, u in enumerate(urls)}
    assert seen[0].where("kind = 1").select("range").distinct().count() > 4
    assert seen[0].where("kind = 1 AND host = 'hot.net'").select("range").distinct().count() > 1
    assert seen[0].where("kind = 0").groupBy("key").count().where("count > 1").count() == 0  # no rule is copied


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    some = spark.createDataFrame(URL_RULES, none.schema)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.url_verdicts(empty, some).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], empty.schema)
    assert [tuple(r) for r in uf.url_verdicts(one, none, default="allow").collect()] == [(1, "a.net", "/", None, "allow")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = uf.url_verdicts(df, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
