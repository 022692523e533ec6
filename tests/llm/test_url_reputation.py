from curvecal.llm import queries, url_reputation
from curvecal.llm.queries import URL_RULES


def judged(spark, urls, outcomes=(), **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    known = spark.createDataFrame(list(outcomes), "url string, good int")
    return {r.page_id: r for r in url_reputation.judge_urls(pages, known, URL_RULES, **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("HTTP://Blog.Example.NET/en/1?x=/fr/", "blog.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("http://m.example.com/de/x#top", "m.example.com", "/de/x", "example.com/de/", "block"),
        ("x://y.org/fr/1://z.net/", "y.org", "/fr/1://z.net/", "org/fr/", "allow"),
        ("http://ÄB.org/fr", "Äb.org", "/fr", None, "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"),
        ("http://a.net:80/x", "a.net:80", "/x", None, "allow"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), cases[i]


def test_bad_hosts_are_blocked_and_single_failures_are_not(spark):
    outcomes = [(f"http://good{h}.example.org/{k}", 1) for h in range(20) for k in range(30)]
    outcomes += [(f"http://bad.spam.com/{k}", 0) for k in range(200)] + [("http://good1.example.org/z", 0), ("http://new.example.org/a", 0)]
    outcomes += [("http://good1.example.org/q", None)]
    got = judged(spark, ["http://bad.spam.com/1", "http://good1.example.org/2", "http://new.example.org/b", "http://never.seen.org/"], outcomes)
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert got[0].high < 0.5 < got[1].low and got[1].n_labelled == 31 and got[2].rate < got[1].rate


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_outcomes_come_from_the_path(spark, tmp_path):
    urls = ["http://a.org/en/7", "http://a.org/en/8/", "http://a.org/9.html?page=2&ref=x", "http://a.org/en/10?page=99", "http://a.org/11#top3",
            "http://a.org/12/?q=/55", "http://a.org/", None, "no scheme/13", "http://a.org/x", "http://a.org/99999999999999999999"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.url: r.good for r in queries.page_outcomes(spark, str(tmp_path)).collect()}
    assert got == {urls[k]: n % 2 for k, n in enumerate((7, 8, 9, 10, 11, 12))}


def test_no_outcome_of_the_test_pages_is_lost(spark):
    assert queries.page_outcomes(spark, "/root/testdata/sf0.01").count() == 86
