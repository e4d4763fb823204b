from loomcorpus.llm import url_filter

LOG = "list string, kind string, pattern string, action string, at int"


def test_entries_are_judged_at_fetch_time(spark):
    log = spark.createDataFrame([
        ("l", "domain", "Bad.example", "add", 10), ("l", "domain", "bad.example", "add", 12), ("l", "domain", "bad.example", "remove", 20), ("l", "domain", "bad.example", "remove", 21), ("l", "domain", "bad.example", "add", 30),
        ("p", "prefix", "ok.example/x", "add", 5), ("p", "domain", "same.example", "add", 7), ("p", "domain", "same.example", "remove", 7), (None, "domain", "n.example", "add", 1), ("q", "domain", "n.example", "add", None),
    ], LOG)
    rows = [(1, "http://a.BAD.example/z", 9, 0), (2, "http://a.bad.example:80/z", 10, 0), (3, "http://bad.example", 19, 0), (4, "http://bad.example", 20, 0), (5, "https://u:p@bad.example?q", 99, 1), (6, "http://notbad.example/", 15, 1), (7, "http://ok.example/x/y", 6, 1), (8, "http://ok.example/xx", 6, 1), (9, None, 6, 1), (10, "no url", 6, 1), (11, "http://same.example", 8, 1), (12, "http://bad.example", None, 1), (3, "http://bad.example", 19, 0)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at int, hits int")
    got = sorted((r.page_id, r.blocked, r.hits, r.lists, r.listed_since) for r in url_filter.judged(captures, log).collect())
    blocked = {2: ("l", 10), 3: ("l", 10), 5: ("l", 30), 7: ("p", 5)}
    assert got == sorted((i, i in blocked, int(i in blocked), *blocked.get(i, (None, None))) for i, *_ in rows)
    assert url_filter.judged(captures, log.limit(0)).where("blocked").count() == 0
    assert url_filter.judged(captures.limit(0), log).count() == 0


def test_hosts_and_paths(spark):
    log = spark.createDataFrame([("l", "domain", "bad.example.", "add", 1), ("l", "domain", "[2001:DB8::1]", "add", 1), ("t", "domain", "zip", "add", 1), ("p", "prefix", "ok.example/a/b/", "add", 1)], LOG)
    urls = {1: "http://x.bad.example./", 2: "http://[2001:db8::1]:80/z", 3: "https://some.zip/", 4: "http://ok.example/a/b/c?d", 5: "http://ok.example/a/bc", 6: "http://ok.example/a", 7: "http://[2001:db8::2]/", 8: "http://ok.example//a/b/" + "x/" * 100_000}
    captures = spark.createDataFrame([(i, u, 3) for i, u in urls.items()], "page_id long, url string, fetched_at int")
    assert {r.page_id: r.lists for r in url_filter.judged(captures, log).collect()} == {1: "l", 2: "l", 3: "t", 4: "p", 5: None, 6: None, 7: None, 8: "p"}
