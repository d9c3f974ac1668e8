import random

from periodlens.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"),
         ("a.b", "", "block"), ("a.b", "/x/y", "allow"), ("b", "/x/", "block")]


def brute(host, path, rules):
    fits = [(h.count("."), len(p), v == "allow", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def test_trie_is_longest_match():
    rng, trie = random.Random(1), U.build_trie(RULES)
    hosts = ["com", "example.com", "www.example.com", "x.www.example.com", "net", "q.net", "a.b",
             "z.a.b", "b", "example", "", "xexample.com", "c.b"]
    for _ in range(4000):
        host = rng.choice(hosts)
        path = "".join(rng.choice(["/", "e", "en", "es", "x", "y", "/en/", "/x/y"])
                       for _ in range(rng.randint(0, 4)))
        assert U.longest_match(trie, host, path) == brute(host, path, RULES), (host, path)


def test_both_ways_agree_and_odd_urls(spark):
    urls = ["http://example.com/en/1?q#f", "HTTP://WWW.Example.COM/en/?x", "https://example.com",
            "no scheme", None, "", "://", "http://", "x://y://z/es/", "http://q.net/es/a/",
            "http://q.net?/es/", "http://a.b#/x/y", "http://user@a.b/x/y/z", "http://É.com/\n/x",
            "http://example.com/en/1?q#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.selectExpr("*", "'clash' AS verdict", "1 AS rule")
    want = sorted(U.judge_urls(pages, RULES).collect(), key=lambda r: r.page_id)
    got = sorted((U.judge_urls(pages, RULES, max_bytes=0)
                  .select("page_id", "host", "path", "rule", "verdict").collect()),
                 key=lambda r: r.page_id)
    key = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in want]
    assert key == [tuple(r) for r in got]
    assert len(key) == len(urls)
    by_id = {r[0]: r for r in key}
    assert by_id[1][1:] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by_id[4][1:] == ("", "", None, "allow") and by_id[8][1:3] == ("y:", "//z/es/")
    assert by_id[0][4] == "block" and by_id[2][3] is None
    assert U.judge_urls(pages.limit(0), RULES).count() == 0
