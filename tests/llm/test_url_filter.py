from llm_compare import assert_same
from pyspark.sql import functions as F

import quillstream.llm.url_filter as m
from quillstream.llm.queries import ORACLES, QUERIES


def test_matches_sql(spark):
    assert assert_same(spark, QUERIES["op1_url_filter"], ORACLES["op1_url_filter"], "/root/testdata/sf0.1") == 2500


def test_rules_lists_and_edges(spark):
    urls = [
        "http://a.example.net/en/1?q#f", "https://EXAMPLE.net/de/", "ftp://notexample.net/en/", "http://x.org/fr/2", "http://x.org/en/", "http://www.bad.io/p/", "http://bad.io/p",
        "http://bad.io/p/q", "no scheme example.net/en/", None, "", "http://", "http://net", "http://a..net/", "x://b.net?u=http://c/", "http://example.com:80/de/", "http://example.com/de/" + "z" * 50_000,
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v")], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("=bad.io/p",), ("=bad.io/p",), (None,)], "key string")
    got = {r.page.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in m.judge_urls(pages, m.standard_rules(spark), listed).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "/de/", "net/", "block"), 2: ("notexample.net", "/en/", "net/", "block"),
        3: ("x.org", "/fr/2", "org/fr/", "allow"), 4: ("x.org", "/en/", None, "allow"), 5: ("www.bad.io", "/p/", None, "block"), 6: ("bad.io", "/p", None, "block"),
        7: ("bad.io", "/p/q", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("net", "", None, "allow"), 13: ("a..net", "/", "net/", "block"), 14: ("b.net", "", None, "allow"), 15: ("example.com:80", "/de/", None, "allow"),
        16: ("example.com", "/de/zzzz", "example.com/de/", "block"),
    }
    assert m.judge_urls(pages, m.standard_rules(spark), listed).count() == len(urls) + 1
    assert m.judge_urls(pages.limit(0), m.standard_rules(spark), listed).count() == 0
    assert {r.verdict for r in m.judge_urls(pages, m.standard_rules(spark).limit(0), listed.limit(0)).collect()} == {"allow"}


def test_hosts_of_many_labels(spark):
    deep = "a." * 20_000 + "example.net"
    pages = spark.createDataFrame([(1, f"http://{deep}/en/x"), (2, f"http://{deep}/de/x"), (3, "http://" + "." * 5000 + "/")], "page_id long, url string").withColumn("a.b", F.lit(1))
    got = {r.page.page_id: (r.rule, r.verdict) for r in m.judge_urls(pages, m.standard_rules(spark), spark.createDataFrame([], "key string")).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow")}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("=k"), "id").alias("key"))
    asked = spark.range(40_000).select(F.concat(F.lit("=k"), "id").alias("key"), "id")
    passed = m.possible(asked, keys, 20_000)
    assert passed.filter("id < 20000").count() == 20_000
    assert passed.filter("id >= 20000").count() < 400


def test_many_rules(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    rules = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".io")).alias("host"), F.expr("repeat('/a', cast(id % 5 as int))").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://s.h"), "id", F.lit(".io/a/a")).alias("url"))
    blocked = {r.page.id for r in m.judge_urls(pages, rules, spark.createDataFrame([], "key string")).filter("verdict = 'block'").collect()}
    assert blocked == {i for i in range(3000) if i % 5 <= 2}
