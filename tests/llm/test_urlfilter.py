from rollbook.llm import registry, urlfilter

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?a=/b#c", "https://www.example.com/en/", "http://badexample.com/en/1", "http://a.b.example.com/fr/",
    "ftp://x.net/es/", "ftp://x.net/es", "http://net/fr/a", "http://example.com", "http://example.com?/en/", "x://a://b.com/", "http://www.example.com/en/" + "y" * 30000, "http://...com/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in registry.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)] + [(None, URLS[4], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame(registry.RULES, urlfilter.RULES_SCHEMA)
    got = urlfilter.filter_urls(pages, rules).collect()
    want = [(i, *brute(u)) for i, u in enumerate(URLS * 2)] + [(None, *brute(URLS[4]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
