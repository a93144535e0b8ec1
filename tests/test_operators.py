"""Small cases of single operators: boundaries, precedence, missing values."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import lang, schedule, text, trust, urls
from quillstream.operators import comments, feedq, feeds, graph, links, pages, report, store
from quillstream.plans import batch
from quillstream.sources import files, http, seeds

BASE = "https://a.example.org/blog/"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} {'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string")
    return row.select(column.alias("v")).first()["v"]


def page(spark, column, html, url=BASE):
    return one(spark, column, html=html, url=url)




@pytest.fixture(autouse=True)
def _column(spark):
    global H
    H = F.col("html")


def test_page_languages(spark):
    detect = lang.page_languages(H, F.col("url"), lang.densities(lang.strip_tags(H)))
    cases = [
        ('<html lang="zh-CN"><p>x</p>', BASE, ["zh"]), ('<html lang="en-US">', BASE, ["en"]), ("", "https://x.cn/", ["zh"]), ("", "https://x.tw", ["zh"]), ("", "https://x.jp/a", ["ja"]),
        ("<p>" + "这是一个中文博客的内容" * 5, BASE, ["zh"]), ("<p>" + "plain english words here " * 5, BASE, ["en"]), ("<p>" + "中文内容很多" * 6 + "english words too" * 2, BASE, ["zh", "en"]),
        ("<p>" + "これはひらがなです" * 5, BASE, ["ja"]), ("<p>" + "한국어블로그입니다" * 5, BASE, ["ko"]), ("<p>short", BASE, ["en"]), ('<html lang="en"><p>x', "https://x.cn/", ["en", "zh"]),
        ('<HTML class="a" LANG="jp">', BASE, ["ja"]),
    ]
    for html, url, wanted in cases:
        assert page(spark, detect, html, url) == wanted, html


def test_article_language(spark):
    language = lang.article_language(lang.densities(lang.strip_tags(F.concat_ws(" ", "title", "body"))))
    for title, body, wanted in [("标题中文内容", "更多的中文内容在这里", "zh"), ("An English title", "more words", "en"), ("日本語のタイトル", "ひらがなとカタカナ", "ja"), ("한국어 제목", "한국어 내용입니다", "ko"), ("短", "", "en"), ("<b>" * 9 + "中文标题内容文字内容", "", "zh")]:
        assert one(spark, language, title=title, body=body) == wanted


def test_ascii_word_boundaries(spark):
    assert page(spark, pages.theme(H, F.lit("hexo")), "<div class='a next b'>")["theme"] == "next"
    assert page(spark, pages.theme(H, F.lit("hexo")), "<div class='中next中'>")["confidence"] == pytest.approx(0.9)  # the case-insensitive second pattern
    assert page(spark, pages.theme(H, F.lit("hugo")), "<div class='butterfly'>")["theme"] is None
    assert page(spark, pages.theme(H, F.lit(None).cast("string")), "<div class='butterfly'>")["theme"] is None


def test_generators(spark):
    meta = lambda x: f'<meta name="generator" content="{x}">'
    cases = [(meta("Hexo 6"), "hexo", 0.95), (meta("WordPress 6"), "wordpress", 0.95), ("<!-- generator: Hugo -->", "hugo", 0.9), ("<!-- hexo-inject:begin -->", "hexo", 0.9), ('<link href="/wp-content/x">', "wordpress", 0.9), (meta("Typecho 1"), "typecho", 0.95), ("<p>none", None, 0.0)]
    for html, ssg, confidence in cases:
        g = page(spark, pages.generator(H), html)
        assert (g["ssg"], g["confidence"]) == (ssg, confidence)
    assert page(spark, pages.generator(H), "/wp-content/ /wp-includes/")["signals"] == ["path:wordpress", "path:wordpress"]
    f = page(spark, pages.fingerprint(H), meta("Hexo") + "<div class='icarus'><script src='https://giscus.app'>")
    assert (f["ssg"], f["theme"], f["comment_system"], f["confidence"]) == ("hexo", "icarus", "giscus", 0.95)


def test_comment_systems_and_counts(spark):
    for sign, name in [("giscus.app", "giscus"), ("disqus_thread", "disqus"), ("utteranc.es", "utterances"), ("cusdis", "cusdis"), ("@waline/client", "waline"), ("twikoo", "twikoo"), ("x", None)]:
        assert page(spark, pages.comment_system(H), sign) == name
    cases = [
        ("giscus", '<div data-discussion-count="5">', 5), ("giscus", "giscus has 12 comments", 12), ("giscus", "<div data-giscus>", 0), ("giscus", "x", None), ("disqus", "<a class='disqus-comment-count'>3 comments", 3),
        ("disqus", "<a href='#disqus_thread'>5", 5), ("disqus", "disqus_thread", 0), ("disqus", "x", None), ("utterances", "utteranc.es", 0), ("utterances", "x", None), ("wordpress", "<a class='comments-link'>7 Comments", 7),
        ("wordpress", "4 thoughts on x", 4), ("wordpress", "<li class='comment'><li class='comment even'><li class=\"a comment\">", 3), ("wordpress", "x", None), ("giscus", '<div data-discussion-count="99999999999999">', None),
    ]
    for system, html, n in cases:
        assert page(spark, comments.count(H, system), html) == n, html
    both = "<div data-discussion-count='9' data-giscus></div> disqus_thread"
    assert tuple(page(spark, comments.scrape(H, F.lit("disqus")), both)) == (0, "disqus")
    assert tuple(page(spark, comments.scrape(H, F.lit(None).cast("string")), both)) == (9, "giscus")
    assert page(spark, comments.scrape(H, F.lit(None).cast("string")), "<p>") is None


def test_protocols(spark):
    p = lambda html: page(spark, pages.protocols(H, F.col("url")), html)
    a = p('<link rel="blogroll" type="text/x-opml" href="/b.opml"><a href="https://c.example.org/z.opml">z</a><link rel="webmention" href="wm"><a rel="webmention" href="/no">')
    assert (a["opml"]["url"], a["webmention"]["url"]) == ("https://a.example.org/b.opml", "https://a.example.org/blog/wm")
    assert p('<a href="l.opml">x</a>')["opml"]["url"] == BASE + "l.opml" and not p("<p>")["opml"]["supported"]
    m = p('<div class="x h-card y"><a rel="me nofollow" href="https://m.example.org"><a href="https://n.example.org" rel="me">')["microformats"]
    assert (m["h_card"], m["h_feed"], m["rel_me"]) == (True, False, ["https://m.example.org", "https://n.example.org"])
    x = p('<a href="https://f.example.org" rel="friend nofollow met">F</a><a rel="contact" href="https://g.example.org">G</a><a rel="friend" href="https://f.example.org">again</a><a href="/x" rel="nofollow">')["xfn"]
    assert [(r["url"], r["rel"]) for r in x] == [("https://f.example.org", ["friend", "met"]), ("https://g.example.org", ["contact"])]
    assert p('<link rel="alternate" type="application/atom+xml" href="https://h.example.org">')["rss"]["url"] == "https://h.example.org/"
    find = lambda html: page(spark, pages.discovered_feed(H, F.col("url")), html)
    assert find('<link type="application/rss+xml" href="/f.xml">') == "https://a.example.org/f.xml" and find('<link href="https://x/y" type="application/atom+xml">') == "https://x/y"
    assert find('<link type="application/rss+xml" href="rel.xml">') is None and find("<p>") is None


def test_friend_links(spark):
    rows = [
        (1, '<a href="https://a.io" rel="friend">A</a><a href="https://b.io" rel="nofollow">B</a><a rel="friend" href="https://b.io">B2</a><a rel="following" href="https://a.io">A</a><a rel="following" href="https://c.io">C</a>'),
        (2, '<ul class="my friend-links"><a href="https://d.io"> D </a><a href="/rel">x</a><a href="https://www.github.com/x">g</a></ul><h2>友情链接</h2><p><a href="https://e.io">E</a><h2>next</h2><a href="https://no.io">N</a>'),
        (3, "<h3>Cool blogs</h3><a href='https://g.io'>G</a>"), (4, "<h3>Friends</h3>" + "x" * 2100 + "<a href='https://h.io'>H</a>"), (5, None),
    ]
    found = {(r.site_id, r.url): (r["name"], r.method, r.confidence) for r in links.friend_links(spark.createDataFrame(rows, "site_id long, html string")).collect()}
    assert found == {
        (1, "https://a.io"): ("A", "xfn", 0.9), (1, "https://c.io"): ("C", "microformat", 0.85), (2, "https://d.io"): ("D", "heuristic", 0.6), (2, "https://e.io"): ("E", "heuristic", 0.6), (3, "https://g.io"): ("G", "heuristic", 0.6),
    }


def test_urls(spark):
    valid = lambda u: one(spark, urls.valid_site(F.col("u")), u=u)
    assert all(map(valid, ["https://x.io", "http://b.example.org/p", "https://notx.com/"])) and not any(map(valid, ["https://x.com/a", "https://m.weibo.com", "#", "javascript:x", "/p", "mailto:a@b.c"]))
    assert one(spark, urls.valid_site(F.col("u"), urls.DIRECTORY_EXCLUDED), u="https://me.substack.com") is False
    for given, wanted in [("HTTP://U:p@A.io:80/B/?q#f", "http://a.io/B"), ("https://a.io", "https://a.io"), ("https://a.io/", "https://a.io"), ("ftp://a.io", None), ("https://a_b.io/x//", "https://a_b.io/x/")]:
        assert one(spark, urls.normalize_url(F.col("u")), u=given) == wanted
    for path, yes in [("/friends", True), ("/LINKS/", True), ("/友链", True), ("/links/x", False), ("/linksy", False), ("/friends\n", False)]:
        assert one(spark, urls.friend_page(F.col("p")), p=path) is yes
    resolve = lambda u, b: spark.createDataFrame([(u, b)], "u string, b string").select(urls.resolve_feed_url("u", "b")).first()[0]
    assert [resolve(*x) for x in [("/p", BASE), ("p", BASE), ("//c.io/x", BASE), ("https://c.io", BASE), ("p", None), (None, BASE)]] == ["https://a.example.org/p", BASE + "p", "https://c.io/x", "https://c.io", "p", None]
    assert one(spark, urls.resolve_page_url("u", "b"), u="x y", b=BASE) == BASE + "x%20y" and one(spark, urls.resolve_page_url("u", "b"), u="https://c.io", b=BASE) == "https://c.io/"
    assert one(spark, urls.feed_link(F.lit("/"), F.col("l")), l="zh") == "/?lang=zh"


def test_text(spark):
    s = lambda c, **v: one(spark, c, **v)
    assert s(text.decode_entities(F.col("t")), t="&lt;b&gt; &amp;quot; &#65;&#x4e2d;&#128512; &#9999999999;") == '<b> " A中\uf600 \ue3ff'
    for given, wanted in [("Mon, 13 Jan 2025 10:00:00 GMT", "2025-01-13"), ("Mon, 13 Jan 2025 01:00:00 +0800", "2025-01-12"), ("2025-01-13T02:00:00+08:00", "2025-01-12"), ("2025-01-13", "2025-01-13"), ("nonsense", None), ("", None)]:
        assert s(text.parse_date(F.col("t")), t=given) == wanted
    assert s(text.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert s(text.truncate(F.col("t"), 5), t="abcd efg") == "abcd..." and s(text.truncate(F.col("t"), 5), t="abc") == "abc"
    assert s(text.progress_label(F.col("d"), F.col("n"), F.lit("B")), d=1, n=8) == "13% (1/8) · B" and s(text.percent(F.col("d"), F.col("n")), d=1, n=0) == 0
    assert s(text.parse_languages(F.col("t")), t='["en","zh"]') == ["en", "zh"] and s(text.parse_languages(F.lit(None).cast("string"))) == ["zh"]
    assert s(text.new_york_day(F.to_timestamp(F.col("t"))), t="2025-01-13 03:00:00") == "2025-01-12" and s(text.display_date(F.to_date(F.col("t"))), t="2025-01-03") == "2025/1/3"
    assert s(http.normalize_etag(F.col("t")), t='W/"x"') == "x" and s(http.normalize_etag(F.col("t")), t='"y"') == "y"


def test_schedule(spark):
    now = 10**13
    for age, wanted in [(7 * schedule.DAY, "active"), (7 * schedule.DAY + 1, "normal"), (30 * schedule.DAY, "normal"), (90 * schedule.DAY, "normal"), (90 * schedule.DAY + 1, "dormant")]:
        assert one(spark, schedule.tier(F.lit(now), F.col("t")), t=now - age) == wanted
    assert one(spark, schedule.tier(F.lit(now), F.lit(None).cast("long"))) == "dormant"
    assert one(spark, schedule.next_crawl_at(F.lit(now), F.lit(5).cast("long"), F.lit("normal"))) == 5 + 6 * schedule.HOUR and one(spark, schedule.next_crawl_at(F.lit(now), F.lit(None).cast("long"), F.lit("normal"))) == now
    assert one(spark, schedule.should_crawl(F.lit(now), F.lit(None).cast("long"))) is True


def test_quality(spark):
    q = lambda ppd, author, dates: one(spark, trust.content_quality(F.lit(ppd), F.lit(author), F.lit(dates)))
    assert q(1.0, True, False) == 1 and q(15.0, True, True) < 1 and q(500.0, False, False) == 0.3 and q(0.0, True, True) == pytest.approx(1.02)
    assert one(spark, trust.final_trust(F.lit(0.9), F.lit(1.2))) == 1
    assert one(spark, trust.promotes(F.lit(0.8), F.lit(True), F.lit(10))) is True and one(spark, trust.promotes(F.lit(0.8), F.lit(True), F.lit(9))) is False


def test_trust_chain(spark):
    sites = spark.createDataFrame([(1, "r", 0.5, None), (2, "s1", 0.5, None), (3, "s2", 0.5, None), (4, "far", 0.5, None)], "id long, url string, trust_score double, hop_count int")
    edges = spark.createDataFrame([(1, 2, "opml", 0.9), (2, 3, "heuristic", 0.7), (3, 1, "xfn", 1.0), (3, None, "xfn", 1.0)], "source_site_id long, target_site_id long, discovery_method string, confidence double")
    found = {r.id: (round(r.trust_score, 6), r.hop_count) for r in graph.build_trust(sites, edges, spark.createDataFrame([("r",)], "url string")).collect()}
    assert found == {1: (1.0, 0), 2: (0.8, 1), 3: (0.448, 2), 4: (0.5, None)}
    again = graph.build_trust(sites.withColumn("hop_count", F.lit(7)), edges, spark.createDataFrame([("r",)], "url string"), reset=True)
    assert {r.hop_count for r in again.collect()} == {0, 1, 2, None}


FEED = """<?xml version="1.0"?><rss><channel><title>no</title><item><title><![CDATA[ T & t ]]></title><link>/p1</link><links>z</links><description>d</description><pubDate>Mon, 13 Jan 2025 00:00:00 GMT</pubDate>
<media:thumbnail url="https://i/t.png"/><enclosure url="https://i/e.png" type="image/png"/></item><item><guid>x</guid><enclosure url="/a.mp3" type="audio/mpeg"/></item><item><title>C</title><content:encoded>&lt;p> <img src="i.png"></content:encoded></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="edit" href="/e"/><link rel="alternate" href="/a"/><summary></summary><content>body</content><updated>2025-01-13T00:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    rows = feeds.parse_feeds(spark.createDataFrame([(1, BASE, FEED), (2, BASE, ATOM), (3, BASE, "<rss></rss>"), (4, BASE, None)], "feed_id long, base_url string, xml string")).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.title, r.url, r.description, r.cover_image, r.published_at) for r in rows] == [
        (1, "T & t", "https://a.example.org/p1", "d", "https://i/t.png", "2025-01-13"), (1, "", "", "", None, None), (1, "C", "", "", BASE + "i.png", None), (2, "A", "https://a.example.org/a", "body", None, "2025-01-13"),
    ]
    blogs = spark.createDataFrame([(1, "https://x.io/", "hexo"), (2, "https://y.io", None)], "id long, url string, ssg string")
    tried = feeds.probes(blogs)
    assert [r.feed_url for r in tried.filter("blog_id = 1").orderBy("pos").collect()] == ["https://x.io/atom.xml", "https://x.io/rss.xml", "https://x.io/rss2.xml", "https://x.io/feed.xml"]
    responses = spark.createDataFrame([("https://x.io/atom.xml", 200, "<html>"), ("https://x.io/rss.xml", 404, FEED), ("https://x.io/rss2.xml", 200, FEED), ("https://x.io/feed.xml", 200, ATOM), ("https://y.io/feed.xml", 500, None)], "feed_url string, status int, body string")
    assert [(r.blog_id, r.feed_url) for r in feeds.first_feed(tried, responses).collect()] == [(1, "https://x.io/rss2.xml")]


# by the URL standard
JOINS = [
    ("//cdn.x", "https://cdn.x/"), ("/a b?q=é", "https://a.example.org/a%20b?q=%C3%A9"), ("https://Ex.ORG:443/a/../b", "https://ex.org/b"), ("\\foo", "https://a.example.org/foo"), ("../../x", "https://a.example.org/x"),
    ("a/./b/..", "https://a.example.org/a/"), ("?q#f", "https://a.example.org/?q#f"), ("#x", "https://a.example.org/#x"), ("", "https://a.example.org/"), ("http://u:p@h:80/%2e%2E/x", "http://u:p@h/x"),
    ("https:g", "https://a.example.org/g"), ("http:g", "http://g/"), ("mailto:A@b", "mailto:A@b"), ("http://münchen.de/ü?ü#ü", "http://xn--mnchen-3ya.de/%C3%BC?%C3%BC#%C3%BC"), (" /x\n", "https://a.example.org/x"),
    ("http://0x7f.1/", "http://127.0.0.1/"), ("http://[::1]:8080/", "http://[::1]:8080/"), ("http://a b/", None), ("http://h:99999/", None), ("http://1.2.3.4.5/", None), ("//", None), ("http://h/?a'b", "http://h/?a%27b"), ("/a{b}", "https://a.example.org/a%7Bb%7D"),
]


def test_joins_follow_the_standard(spark):
    base = "https://a.example.org/"
    rows = spark.createDataFrame([(u, base) for u, _ in JOINS], "u string, b string")
    got = {r.u: r.j for r in rows.select("u", urls.resolve_page_url("u", "b").alias("j")).collect()}
    assert got == {u: u if j is None else j for u, j in JOINS}


def test_numeric_entities(spark):
    for given, wanted in [("&#55357;&#56832;", "😀"), ("&#x1F600;", "\uf600"), ("&#65601;", "A"), ("&#55357;", "�"), ("&#39;&#x27;&#X27;", "''&#X27;"), ("&amp;#65;", "A"), ("plain &lt;", "plain <"), (None, None), ("&#" + "9" * 400 + ";", "\0")]:
        assert one(spark, text.decode_entities(F.col("t")), t=given) == wanted


def test_ids_are_stable(spark):
    old = spark.createDataFrame([(5, "a")], "id long, url string")
    given = spark.createDataFrame([(i, f"u{i % 40}") for i in range(200, 0, -1)], "seq long, url string").repartition(7)
    grown = store.insert_if_new(old, given, ["url"], "seq")
    assert sorted((r.id, r.url) for r in grown.collect()) == [(5, "a"), *((6 + i, f"u{(i + 1) % 40}") for i in range(40))]
    assert grown.join(grown.select("id", F.col("url").alias("again")), "id").filter("url <> again").isEmpty()
    kept = store.fill_empty(spark.createDataFrame([(1, None), (2, "x"), (3, ""), (4, None)], "id long, c string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, c string"), "id", ["c"])
    assert {r.id: r.c for r in kept.collect()} == {1: "a", 2: "x", 3: "c", 4: None}
    blogs = spark.createDataFrame([(1, 5, 0, None)], "id long, last_scraped_at long, error_count int, last_error string")
    failed = spark.createDataFrame([(1, False, "m")], "id long, ok boolean, message string")
    assert [store.crawl_outcomes(blogs, failed, F.lit(9), sets).first().last_scraped_at for sets in (True, False)] == [9, 5]


def test_hooks_and_progress(spark, tmp_path):
    from quillstream.streaming.events import progress_updates, with_hooks

    spark.createDataFrame([("new_article", True, 2), ("error", False, 0)], "type string, ok boolean, new_articles int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, ok boolean, new_articles int").parquet(str(tmp_path / "in"))
    seen = {}

    def fails(batch, number):
        raise ValueError

    with_hooks(stream, {"error": fails, "new_article": lambda b, n: seen.setdefault("articles", b.count()), "*": lambda b, n: seen.setdefault("all", b.count())}).awaitTermination()
    assert seen == {"articles": 1, "all": 2}
    out = progress_updates(stream).writeStream.format("memory").queryName("progress_rows").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert [tuple(r) for r in spark.table("progress_rows").collect()] == [(2, 1, 1, 2)]


def test_store(spark):
    old = spark.createDataFrame([(5, "a")], "id long, url string")
    given = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, ""), (5, None)], "seq long, url string")
    assert sorted((r.seq, r.is_new) for r in store.with_is_new(old, given, ["url"], "seq").collect()) == [(1, False), (2, True), (3, False), (4, False), (5, False)]
    grown = store.insert_if_new(old, given, ["url"], "seq").collect()
    assert sorted(r.url for r in grown) == ["a", "b"] and len({r.id for r in grown}) == 2 and min(r.id for r in grown) == 5
    assert {(r.seq, r.status) for r in store.strict_insert_status(old, given).collect()} == {(1, 409), (2, 201), (3, 409), (4, 400), (5, 400)}
    ids = {r.url: r.id for r in store.get_or_create(old, spark.createDataFrame([("a",), ("n",), ("n",)], "url string")).collect()}
    assert ids["a"] == 5 and ids["n"] > 5 and len(ids) == 2
    early = spark.createDataFrame([(1, "https://x")], "id long, url string")
    full = store.with_missing_columns(early, "blogs").first()
    assert (full.languages, full.error_count, full.crawl_tier, full.trust_score, full.has_opml, full.hop_count) == (["zh"], 0, "normal", 0.5, False, None)
    assert {(r.rule, r.detail) for r in store.violations(spark.createDataFrame([(1, "u"), (2, "u"), (3, None)], "id long, url string"), "blogs").collect()} == {("unique", "url"), ("not null", "url")}
    assert store.violations(early, "blogs").isEmpty()
    kept = store.replace_columns(spark.createDataFrame([(1, "hexo"), (2, "hugo")], "id long, ssg string"), spark.createDataFrame([(1, None)], "id long, ssg string"), "id", ["ssg"])
    assert {r.id: r.ssg for r in kept.collect()} == {1: None, 2: "hugo"}


def test_repeated_keys_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, None, 0), (2, "hugo", 2), (3, "", 1)], "id long, ssg string, error_count int")
    given = spark.createDataFrame([(1, "jekyll"), (1, "astro"), (1, None), (2, None), (2, "zola"), (2, "zola"), (9, "x")], "id long, ssg string")
    shown = lambda df: sorted((r.id, r.ssg) for r in df.collect())
    assert shown(store.replace_columns(old, given, "id", ["ssg"])) == [(1, "astro"), (2, "zola"), (3, "")]
    assert shown(store.fill_empty(old, given, "id", ["ssg"])) == [(1, "astro"), (2, "hugo"), (3, "")]
    rows = old.withColumns({"last_error": F.lit("old"), "last_scraped_at": F.lit(0)})
    outcomes = spark.createDataFrame([(1, False, "b"), (1, False, "a"), (2, False, "z"), (2, True, None), (2, False, None)], "id long, ok boolean, message string")
    done = store.crawl_outcomes(rows, outcomes, F.lit(7)).select("id", "last_scraped_at", "error_count", "last_error")
    assert sorted(map(tuple, done.collect())) == [(1, 7, 1, "a"), (2, 7, 0, None), (3, 0, 1, "old")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"url":"https://h","name":"H","ssg":"hexo","circles":["c"]}\n\n{"url":"https://g","ssg":"","comment_system":{"type":"giscus"}}\n{"url":"https://u"}\n')
    rows = {r.url: (r["name"], r.ssg, r.comment_system) for r in files.read_blogs_jsonl(spark, str(path)).collect()}
    assert rows == {"https://h": ("H", "hexo", None), "https://g": (None, None, "giscus"), "https://u": (None, None, None)}
    with pytest.raises(Exception):
        files.read_blogs_jsonl(spark, str(tmp_path / "none.jsonl")).collect()


def test_seeds_and_http(spark):
    assert [seeds.seed_sources(spark, x).count() for x in (None, "en", "zh")] == [11, 6, 5] and [r.language for r in seeds.seed_languages(spark).collect()] == ["en", "zh"]
    assert seeds.by_name(seeds.seed_sources(spark), "WEBRING").count() == 2
    rows = http.classify(spark.createDataFrame([(200, "b"), (304, "x"), (404, "x"), (0, None)], "status int, body string")).collect()
    assert [(r.ok, r.unchanged, r.fetch_error, r.body) for r in rows] == [(True, False, None, "b"), (True, True, None, None), (False, False, "HTTP 404", None), (False, False, "Request timeout", None)]
    assert one(spark, http.request_headers(F.col("e"), F.lit(None).cast("string")), e="x") == {"If-None-Match": "x"}


def test_fetching(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.headers.get("If-None-Match") == '"v1"'
            self.send_response(404 if self.path == "/none" else 304 if known else 200)
            self.send_header("ETag", 'W/"v1"')
            self.end_headers()
            if not known and self.path != "/none":
                self.wfile.write(("x" * 100 if self.path == "/long" else self.headers["User-Agent"]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(http.PageSource)
    asked = [(f"{at}/a", None, None), (f"{at}/b", '"v1"', None), (f"{at}/none", None, None), (f"{at}/long", None, None), ("http://127.0.0.1:1/", None, None), ("no url", None, None)]
    rows = spark.read.format("pages").option("urls", http.fetch_list(asked)).option("mostbytes", "60").option("pertask", "2").option("useragent", "tester").load()
    got = {r.url.removeprefix(at): (r.status, r.body) for r in rows.collect()}
    assert got == {"/a": (200, "tester"), "/b": (304, None), "/none": (404, None), "/long": (413, None), "http://127.0.0.1:1/": (0, None), "no url": (0, None)}
    assert {r.e for r in http.classify(rows).select(http.normalize_etag(F.col("etag")).alias("e")).collect()} == {"v1", None}
    server.shutdown()


def test_report(spark):
    rows = spark.createDataFrame([(True, "hexo", None, None, True, 3, 100), (True, None, None, "giscus", False, None, 0), (False, None, None, None, None, None, None)], "ok boolean, ssg string, theme string, comment_system string, has_rss boolean, friend_links int, response_ms int")
    r = report.verdicts(report.crawl_metrics(rows), 60).first()
    assert (r.total, r.succeeded, r.failed, r.with_ssg, r.links, r.mean_ms, float(r.ssg_percent), float(r.per_minute), r.throughput, r.coverage) == (3, 2, 1, 1, 3, 100, 50.0, 3.0, "FAIL", "FAIL")
    assert report.verdicts(report.crawl_metrics(rows.limit(0)), 60).first().ssg_percent is None


def test_plans(spark):
    sites = store.with_missing_columns(spark.createDataFrame([(1, "https://s.io")], "id long, url string"), "blogs")
    none = spark.createDataFrame([], "source_site_id long, target_site_id long, target_url string, relationship_type string, discovery_method string, confidence double, discovered_at int, last_seen_at int")
    html = '<meta name="generator" content="Hexo"><link rel="webmention" href="/w"><a href="https://t.io/" rel="friend">T</a>'
    grown, rel = batch.process_sites(sites, none, spark.createDataFrame([(1, "https://s.io", html)], "site_id long, url string, html string"), F.lit(9))
    assert {(r.url, r.ssg, r.has_webmention) for r in grown.collect()} == {("https://s.io", "hexo", True), ("https://t.io/", None, None)}
    assert [(r.target_url, r.discovery_method, r.discovered_at) for r in rel.collect()] == [("https://t.io/", "xfn", 9)]
    blogs = store.with_missing_columns(spark.createDataFrame([(1, "https://x.io", "X", "hexo"), (2, "https://y.io", "Y", None)], "id long, url string, name string, ssg string"), "blogs")
    articles = store.with_missing_columns(spark.createDataFrame([(7, 1, "https://x.io/old")], "id long, blog_id long, url string"), "articles")
    snaps = spark.createDataFrame([], "id long, article_id long, comment_count int, snapshot_at timestamp")
    responses = spark.createDataFrame([("https://x.io/atom.xml", 200, FEED.replace("<guid>x</guid>", "<link>/old</link>"))], "feed_url string, status int, body string")
    out = batch.batch_index(blogs, articles, snaps, responses, spark.createDataFrame([("https://x.io/p1", "4 thoughts on wp-comments")], "url string, html string"), F.to_timestamp(F.lit("2025-01-14")))
    assert sorted(r.url for r in out["articles"].collect()) == ["https://x.io/old", "https://x.io/p1"]
    assert [r.comment_count for r in out["snapshots"].collect()] == [4] and sorted(r.type for r in out["events"].collect()) == ["new_article", "new_comment"]
    assert {r.id: r.feed_found for r in out["outcomes"].collect()} == {1: True, 2: False}
    found, totals = batch.discover(blogs, seeds.seed_sources(spark), spark.createDataFrame([("https://blogwe.com", '<a href="https://x.io/">X</a><a href="https://N.io/">N</a><a href="https://n.io">N2</a>')], "url string, html string"))
    assert "https://n.io" in {r.url for r in found.collect()} and {(r.discovered, r.added, r.errors) for r in totals.filter("discovered > 0").collect()} == {(2, 1, 0)}
    changed = batch.detect_blog_languages(blogs, spark.createDataFrame([("https://x.io", '<html lang="en">')], "url string, html string")).collect()
    assert [(r.id, r.languages, r.changed) for r in changed] == [(1, ["en"], True)]
    r = batch.slice_report(spark.createDataFrame([(1, "https://s.io", html, 80), (2, "https://q.io", None, None)], "site_id long, url string, html string, response_ms int"), 6.0).first()
    assert (r.total, r.succeeded, r.with_ssg, r.links, r.throughput, r.detection) == (2, 1, 1, 1, "PASS", "PASS")


def test_feeds_take_one_python_worker_a_task(spark):
    found = feeds.parse_feeds(spark.createDataFrame([(1, BASE, FEED), (2, BASE, ATOM)], "feed_id long, base_url string, xml string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    links = ["", None, "/p/1", "a&#x2F;b", "&#47;p?q=1&amp;#38;", "&#104;ttp://x.org/&#233;", "//c.org/&#65;", "../x&amp;y", "http://x.org/&lt;", "&amp;#47;r", "&#", "mailto:a&#64;b.c", "http&#58;//[bad", "/a b", "&#55357;&#56832;"]
    rows = spark.createDataFrame([(u, b) for u in links for b in (None, "", "https://b.example.net", "http://b.example.net/d/e", "nonsense")], "u string, b string")
    both = rows.select(urls.resolve_encoded_feed_url(F.col("u"), F.col("b")).alias("one"), urls.resolve_feed_url(text.decode_entities(F.col("u")), F.col("b")).alias("two"))
    assert all(r.one == r.two for r in both.collect())


def test_feed_queries(spark):
    blogs = spark.createDataFrame([(1, "u1", "B", ["zh"]), (2, "u2", None, ["en"])], "id long, url string, name string, languages array<string>")
    day = dt.date(2025, 1, 13)
    articles = spark.createDataFrame([(1, 1, "t1", day), (2, 1, "t2", day), (3, 2, "t3", dt.date(2025, 1, 12)), (4, 9, "orphan", day)], "id long, blog_id long, title string, published_at date")
    snaps = spark.createDataFrame([(1, 2, 5, dt.datetime(2025, 1, 12)), (2, 2, 7, dt.datetime(2025, 1, 13))], "id long, article_id long, comment_count int, snapshot_at timestamp")
    assert [r.id for r in feedq.feed("latest", articles, blogs, snaps).collect()] == [2, 1, 3] and [r.id for r in feedq.feed("?", articles, blogs, snaps, "en").collect()] == [3]
    assert [(r.id, r.comment_count) for r in feedq.feed("comments", articles, blogs, snaps).collect()] == [(2, 7)]
    assert [r.id for r in feedq.blog_list(blogs).collect()] == [2, 1]
    assert feedq.random_sample(blogs, 1, 3).count() == 1 and feedq.top_counts(articles, "blog_id", 1).first()["count"] == 2


def test_api(spark):
    from quillstream.plans import api

    blogs = spark.createDataFrame([(1, "u1", "B", ["zh"])], "id long, url string, name string, languages array<string>")
    articles = spark.createDataFrame([(1, 1, "https://x/?a=1&b", "<T>", None, dt.date(2025, 1, 3))], "id long, blog_id long, url string, title string, description string, published_at date")
    snaps = spark.createDataFrame([], "id long, article_id long, comment_count int, snapshot_at timestamp")
    assert '"title":"<T>"' in api.articles("latest", articles, blogs, snaps).first().json and api.blog_list(blogs).count() == 1
    given = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "seq long, url string")
    assert {r.seq: r.status for r in api.add_blogs(blogs, given).collect()} == {1: 409, 2: 201, 3: 400}
    state = spark.createDataFrame([(1, None, None, None)], "id int, current_blog_id long, last_crawl_at timestamp, is_running boolean")
    assert api.indexer_status(state).first().json == '{"isRunning":false,"currentBlogId":null,"lastCrawlAt":null}'
    moved = store.move_cursor(state, F.lit(4).cast("long"), F.lit(True), F.to_timestamp(F.lit("2025-01-01"))).first()
    assert (moved.current_blog_id, moved.is_running) == (4, True)
    assert tuple(one(spark, api.batch_status(F.lit(False), F.lit(2), F.lit(3), F.lit(0), F.lit(1500)))) == (True, 2)
    card = api.cards(feedq.latest_feed(articles, blogs)).first().html
    assert "&lt;T&gt;" in card and "?a=1&amp;b" in card and "2025/1/3" in card
    assert report.unique_urls(blogs, articles).first().urls == 2


def test_events(spark):
    from quillstream.streaming.events import batch_frame, fan_out, frame

    events = spark.createDataFrame([("new_article", "a", ["zh"]), ("new_article", "b", []), ("error", "c", ["zh"]), ("new_comment", "d", None)], "type string, data string, languages array<string>")
    clients = spark.createDataFrame([(1, "zh"), (2, "en"), (3, None)], "client_id int, lang string")
    assert sorted((r.client_id, r.data) for r in fan_out(events, clients).collect()) == [(1, "a"), (1, "c"), (1, "d"), (2, "c"), (2, "d"), (3, "a"), (3, "b"), (3, "c"), (3, "d")]
    assert one(spark, frame(F.lit("t"), F.lit("{}"))) == "event: t\ndata: {}\n\n" and one(spark, batch_frame([F.lit("start").alias("type"), F.lit(3).alias("total")])) == 'data: {"type":"start","total":3}\n\n'


def test_fan_out_totals(spark):
    from quillstream.streaming.events import fan_out, fan_out_counts, fan_out_totals

    kinds, langs = ["error", "new_article", "new_comment", None], [None, [], ["zh"], ["zh", "en", "zh"], [None, "ja"], ["all"], ["any"]]
    events = spark.createDataFrame([(kinds[i % 4], i, langs[i % 7]) for i in range(60)] + [("new_article", None, ["zh"])], "type string, id long, languages array<string>")
    clients = spark.createDataFrame([(1, "zh"), (2, "en"), (3, None), (4, "any"), (4, "ja"), (None, "all"), (5, "")], "client_id int, lang string")
    plain = fan_out(events, clients, ("type", "id")).groupBy("client_id", "type").agg(F.count("*").alias("n"), F.sum("id").alias("id"))
    totals = fan_out_totals(events, clients, ("id",))
    assert sorted(map(str, totals.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, fan_out_counts(events, clients).collect())) == sorted(map(str, plain.drop("id").collect()))


def test_fan_out_query_grows_with_its_tables(spark, tmp_path):
    from quillstream import registry

    spark.range(20_000).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.sse_fanout_lang(spark, str(tmp_path))
    made = found.groupBy().agg(F.count("*").alias("rows"), F.sum("n").alias("delivered")).first()
    assert made["rows"] == 6_000 and made["delivered"] > 20_000_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join ") :]  # events are totalled before they meet clients


def test_delivery_isolates_clients(spark, tmp_path):
    from quillstream.streaming import sink
    from quillstream.streaming.events import deliver

    schema = "type string, data string, languages array<string>, key string"
    spark.createDataFrame([("new_article", "a", ["zh"], "k1")], schema).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "sent")

    def send(client, key, text):
        if client == "1":
            raise OSError("gone")
        with open(f"{out}-{client}", "a") as f:
            f.write(text)

    clients = spark.createDataFrame([(1, "zh"), (2, "zh"), (3, "en")], "client_id int, lang string")
    deliver(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), clients, str(tmp_path / "out"), send, checkpoint=str(tmp_path / "state")).awaitTermination()
    assert {p.name: p.read_text() for p in tmp_path.glob("sent-*")} == {"sent-2": "event: new_article\ndata: a\n\n"}
    assert [(r.client_id, r.key, r.error) for r in sink.failures(spark, str(tmp_path / "out")).collect()] == [("1", "k1", "OSError: gone")]


def test_xfn_keeps_repeated_anchors_with_href_first(spark):
    html = '<a href="u" rel="friend">1</a><a rel="met" href="u">2</a><a href="u" rel="met x">3</a><a rel="kin" href="v">4</a><a rel="date" href="v">5</a><a href="w" rel="none">6</a><a rel="muse" href="w">7</a>'
    assert [(x.url, x.rel) for x in one(spark, pages.xfn(F.lit(html)))] == [("u", ["friend"]), ("u", ["met"]), ("v", ["kin"]), ("w", ["muse"])]


def test_ten_thousand_links_of_a_page(spark):
    html = "".join(f'<a href="https://h{i % 6000}.org/" rel="friend">n{i}</a>' for i in range(10_000))
    page = spark.createDataFrame([("s", 1, html)], "source string, site_id long, html string")
    found = links.directory_links(page).collect()
    assert len(found) == 6000 and {(r.url, r["name"]) for r in found} == {(f"https://h{i}.org", f"n{i}") for i in range(6000)}
    assert links.friend_links(page).count() == 6000 and [r.pos for r in found] == sorted(r.pos for r in found)


def test_comment_system_is_filled_by_counts_above_zero_only(spark):
    blogs = store.with_missing_columns(spark.createDataFrame([(1, "https://x.io", "X", "hexo"), (2, "https://y.io", "Y", "hexo")], "id long, url string, name string, ssg string"), "blogs")
    articles = store.with_missing_columns(spark.createDataFrame([], "id long, blog_id long, url string"), "articles")
    snaps = spark.createDataFrame([], "id long, article_id long, comment_count int, snapshot_at timestamp")
    responses = spark.createDataFrame([(f"https://{b}.io/atom.xml", 200, FEED.replace("<guid>x</guid>", "<link>/old</link>")) for b in "xy"], "feed_url string, status int, body string")
    found = spark.createDataFrame([("https://x.io/p1", '<div id="disqus_thread">'), ("https://y.io/p1", "4 thoughts on wp-comments")], "url string, html string")
    out = batch.batch_index(blogs, articles, snaps, responses, found, F.to_timestamp(F.lit("2025-01-14")))
    assert {r.id: r.comment_system for r in out["blogs"].collect()} == {1: None, 2: "wordpress"}
    told = {r.type: json.loads(r.data) for r in out["events"].filter("type = 'new_comment' or data like '%y.io/p1%'").collect()}
    assert told["new_comment"]["article"]["comment_count"] == 4 and told["new_comment"]["blog"] == {"id": 2, "name": "Y", "url": "https://y.io"}
    assert told["new_article"]["article"]["url"] == "https://y.io/p1" and set(articles.columns) <= set(told["new_article"]["article"])


def slow_friend_links(html):
    """Friend links of a page by plain regular expressions."""
    a = lambda p, u, n, r=None: [(m[u], m[n].strip(), m[r] if r else "") for m in re.finditer(p, html, re.I)]
    href, rel, end = "href=[\"']([^\"']+)[\"']", "rel=[\"']([^\"']+)[\"']", "[^>]*>([^<]*)</a>"
    out = {}
    seen = set()
    for url, name, words in a(f"<a[^>]+{href}[^>]*{rel}{end}", 1, 3, 2) + a(f"<a[^>]+{rel}[^>]*{href}{end}", 2, 3, 1):
        known = [w for w in re.split(r"\s+", words.lower()) if w in links.XFN_CONFIDENCE]
        if url not in seen and known:
            out[url] = (name, "xfn", links.XFN_CONFIDENCE[known[0]])
        seen.add(url)
    follows = "rel=[\"'][^\"']*(?<![A-Za-z0-9_])following(?![A-Za-z0-9_])[^\"']*[\"']"
    for url, name, _ in a(f"<a[^>]+{follows}[^>]*{href}{end}", 1, 2) + a(f"<a[^>]+{href}[^>]*{follows}{end}", 1, 2):
        out.setdefault(url, (name, "microformat", 0.85))
    parts = [m[2] for k in links.CONTAINERS for m in re.finditer(links.BOX.replace("NAME", k), html, re.I)]
    parts += [m[1] for h in links.HEADINGS if (m := re.search(links.UNDER.replace("NAME", h).replace(r"\z", r"\Z"), html))]
    for part in parts:
        for m in re.finditer(f"<a[^>]+{href}{end}", part, re.I):
            out.setdefault(m[1], (m[2].strip(), "heuristic", 0.6))
    host = lambda u: (re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", u) or [None, ""])[1].lower()
    return {u: v for u, v in out.items() if host(u) and not any(host(u) == d or host(u).endswith("." + d) for d in urls.LINK_EXCLUDED)}


def test_friend_links_query_matches_brute_force(spark):
    from quillstream import registry

    sf = "/root/testdata/sf0.001"
    wanted = {(r.site_id, u): v for r in registry._sites(spark, sf).collect() for u, v in slow_friend_links(r.html or "").items()}
    got = {(r.site_id, r.url): (r["name"] or "", r.method, r.confidence) for r in registry.QUERIES["friend_links"](spark, sf).collect()}
    assert got == wanted and len(got) > 20


def test_pages_are_searched_once(spark):
    pages_ = spark.createDataFrame([(1, "https://a.io/", '<meta name="generator" content="Hexo"><a href="https://f.io/" rel="friend">F</a>')], "site_id long, url string, html string")
    sites = store.with_missing_columns(spark.createDataFrame([(1, "https://a.io/")], "id long, url string"), "blogs")
    none = spark.createDataFrame([], "source_site_id long, target_site_id long, target_url string, relationship_type string, discovery_method string, confidence double, discovered_at long, last_seen_at long")
    grown, related = batch.process_sites(sites, none, pages_, F.lit(5).cast("long"))
    assert all("html" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (grown, related))
    assert sorted((r.url, r.ssg) for r in grown.collect()) == [("https://a.io/", "hexo"), ("https://f.io/", None)]
    assert [(r.source_site_id, r.target_url, r.confidence) for r in related.collect()] == [(1, "https://f.io/", 0.9)]
