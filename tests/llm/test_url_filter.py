import pytest
from pyspark.sql import functions as F

from quillfold.llm import url_filter
from quillfold.llm.url_filter import BITS_PER_KEY, BLOCK_BITS, CELLS, _fits, bloom_blocks, judge_urls


def judged(spark, urls, listed=None):
    pages = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(urls)], "page_id long, url string, entry string, k string")
    listed = None if listed is None else spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: r for r in judge_urls(spark, pages, listed).collect()}


def test_rules_and_hosts(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f",
        "http://a.example.net/fr/",
        "http://a.example.net",
        "https://example.com/de/1",
        "https://xexample.com/de/1",
        "http://b.org/fr/x",
        "http://b.org/de/x",
        None,
        "no scheme.net/",
        "http://x.net?y=/en/",
        "a://b://net/",
    ]
    got = judged(spark, urls)
    assert [got[i].rule for i in range(11)] == ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "allow", "block", "allow", "allow"]
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/x")
    assert (got[7].host, got[7].path) == (got[8].host, got[8].path) == ("", "")
    assert (got[9].host, got[9].path) == ("x.net", "")


def test_list_lookups(spark):
    listed = ["http://www.Bad.com/", "shop.com/deals", "exact.com/a?id=1", None, ""]
    urls = ["https://bad.com/x", "http://m.bad.com:80/#f", "http://notbad.com/", "http://shop.com/deals/1", "http://shop.com/dealsx", "http://exact.com/a?utm_x=2&id=1", "http://exact.com/a", "http://shop.com/deals/1"]
    got = judged(spark, urls, listed)
    assert [got[i].verdict for i in range(8)] == ["block", "block", "allow", "block", "allow", "block", "allow", "block"]
    assert got[5].listed_url == "exact.com/a?id=1"


def test_empty_list_and_no_rows(spark):
    assert judged(spark, ["http://a.com/"], [])[0].verdict == "allow"
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(spark, pages).count() == 0


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_lists_of_any_size_and_depth(spark, monkeypatch, limit):
    """With the filter sent along, and as a table; against plain loops over hosts and paths."""
    monkeypatch.setattr(url_filter, "FILTER_BYTES", limit)
    listed = ["h.com/a/b/c", "deep.org/1/2/3/4/5/", "site.com", "q.com/x?id=1", *[f"s{i}.com/p{i}" for i in range(300)]]
    urls = ["http://h.com/a/b/c/d.html", "http://h.com/a/b/cd", "http://h.com/a/b", "https://u@x.deep.org:8443/1/2/3/4/5/6", "http://deep.org/1/2/3/4", "http://site.com:8080/", "http://a.b.site.com", "http://q.com/x/y", "http://q.com/x?id=1"]
    urls += [f"http://s{i}.com/p{i}/z" for i in range(0, 300, 7)] + [f"http://s{i}.com/q" for i in range(0, 300, 7)] + ["http://" + "a." * 300 + "site.com/" + "x/" * 20_000, "http://[::1]/"]
    got = judged(spark, urls, listed)

    def covered(url):
        rest = url.split("://", 1)[1]
        host, _, path = rest.partition("/")
        host = host.split("@")[-1].split(":")[0] if not host.startswith("[") else host
        path = path.split("?")[0].rstrip("/")
        for x in listed:
            if "?" in x:
                if rest == x:
                    return True
                continue
            h, _, p = x.rstrip("/").partition("/")
            if (host == h or host.endswith("." + h)) and (p == "" or path == p or path.startswith(p + "/")):
                return True
        return False

    assert [got[i].verdict == "block" for i in range(len(urls))] == [covered(u) for u in urls]


def test_null_and_repeated_ids(spark):
    rows = [(None, "http://bad.com/1"), (None, "http://bad.com/1"), (1, "http://bad.com/2"), (1, "http://ok.com/"), (2, "http://bad.com/2"), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("bad.com",)], "url string")
    got = judge_urls(spark, pages, listed).select("page_id", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "block"), (None, "block"), (1, "block"), (1, "allow"), (2, "block"), (3, "allow")]))


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    n = 20_000
    blocks = -(-n * BITS_PER_KEY // BLOCK_BITS)
    keys = spark.range(n).select(F.xxhash64("id").alias("k"))
    table = bloom_blocks(keys, blocks).select("block", F.array(*[f"w{c}" for c in range(CELLS)]).alias("words"))
    others = spark.range(n, 6 * n).select(F.xxhash64("id").alias("k"))
    passing = lambda df: df.withColumn("block", F.pmod("k", F.lit(blocks))).join(table, "block").where(_fits(F.col("words"))).count()
    assert passing(keys) == n
    assert passing(others) < 0.01 * 5 * n
