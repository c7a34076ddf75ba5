import pytest

from narrascope.llm import urlrules

URLS = [
    (1, "http://WWW.Example.COM/en/x?q#f"), (2, "https://example.com/en/"), (3, "https://example.com/de/"), (4, "http://a.example.com"), (5, None), (6, "no scheme/en/"),
    (7, "ftp://x.net/es/1://y.com/"), (8, "http://net/fr/"), (9, "http://notexample.com/en/"), (10, "http://b.org/fr/"), (11, "://com/"), (12, "http://É.COM/\npath"), (13, "http://h?x/y"), (13, "http://h?x/y"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p) for _, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, good long")
    got = sorted(tuple(r)[:4] for r in urlrules.judge_urls(df, labels).collect())
    assert [(a, b or "", c, d) for a, b, c, d in got] == sorted((i, *plain(u)) for i, u in URLS)
    verdicts = {r.page_id: r.verdict for r in urlrules.judge_urls(df, labels).collect()}
    assert verdicts[1] == "allow" and verdicts[2] == "block" and verdicts[10] == "allow"


def test_bad_hosts_are_blocked_and_little_evidence_is_not(spark):
    pages, labels = [], []
    for i in range(400):
        host = "spam.bad.org" if i % 4 == 0 else f"h{i % 20}.good.org"
        pages.append((i, f"http://{host}/{i}"))
        labels.append((i, 0 if i % 4 == 0 else 1))
    pages += [(1000, "http://new.good.org/"), (1001, "http://other.bad.org/"), (1002, "http://once.org/")]
    labels.append((1002, 0))
    labels.append((1000, None))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge_urls(df, spark.createDataFrame(labels, "page_id long, good long")).collect()}
    assert got[0] == "block" and got[1] == "allow" and got[1000] == "allow" and got[1002] == "allow"


def test_no_pages(spark):
    assert urlrules.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, 1)], "page_id long, good long")).count() == 0


@pytest.mark.parametrize("host,domain,suffix", [("a.b.c", "b.c", "c"), ("c", "c", "c"), ("", "", ""), ("b.c", "b.c", "c"), ("www.shop.co.uk", "shop.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.com.au", "a.com.au", "com.au"), ("co.info", "co.info", "info"), ("xco.uk", "xco.uk", "uk")])
def test_levels(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(urlrules.domain_of(urlrules.F.col("h")), urlrules.suffix_of(urlrules.F.col("h"))).first()
    assert tuple(row) == (domain, suffix)
