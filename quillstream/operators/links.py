"""Links of a page to other sites: directories and friend links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.urls import DIRECTORY_EXCLUDED, normalize_url, valid_site
from quillstream.operators.pages import attr, every, once, word

# fixed values: confidence of XFN relations, of following links and of heuristics
XFN_CONFIDENCE = {"friend": 0.9, "acquaintance": 0.7, "contact": 0.6, "met": 0.8, "colleague": 0.7, "co-worker": 0.7}
FOLLOWING_CONFIDENCE, HEURISTIC_CONFIDENCE = 0.85, 0.6
# fixed values: class names of link containers and headings of link sections, and the patterns around them
CONTAINERS = ["friend-links", "friend-link", "blogroll", "links-list", "link-card", "friend-card"]
HEADINGS = ["友[情]?链", "朋友.*博客", "推荐博客", "友情链接", "博客朋友", "blogroll", "friends", "reads", r"cool\s*(?:people|blogs)", "following"]
SEED_TYPES = ["webring", "directory", "blogroll", "circle"]
ANCHOR = f"<a[^>]+{attr('href')}[^>]*>([^<]*)</a>"
SECTION = 2000
BOX = r"<(div|ul|section|nav)[^>]*class=[\"'][^\"']*NAME[^\"']*[\"'][^>]*>([\s\S]*?)</\1>"
UNDER = rf"(?i)<h[1-6][^>]*>[^<]*NAME[^<]*</h[1-6]>([\s\S]{{0,{SECTION}}}?)(?=<h[1-6]|\z)"


def zipped(html: Column, pattern: str, url: int, name: int, rel: int | None = None) -> Column:
    parts = [every(html, pattern, url).alias("url"), every(html, pattern, name).alias("name")]
    parts.append(every(html, pattern, rel).alias("rel") if rel else F.transform(every(html, pattern, url), lambda _: F.lit("")).alias("rel"))
    return F.arrays_zip(*parts)


def directory_links(pages: DataFrame) -> DataFrame:
    """``source, pos, url, name``: a page's (``source, html``) links to sites, normalised, the first of each URL."""
    link = lambda a, i: F.struct(i.alias("pos"), normalize_url(a["url"]).alias("url"), F.nullif(F.trim(a["name"]), F.lit("")).alias("name"))
    found = F.filter(F.transform(zipped(F.col("html"), ANCHOR, 1, 2), link), lambda a: a["url"].isNotNull() & valid_site(a["url"], DIRECTORY_EXCLUDED))
    return pages.select("source", found.alias("a")).select("source", F.explode(once(F.col("a"))).alias("a")).select("source", "a.pos", "a.url", "a.name")


def scrape_seeds(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Directory links of the seed pages (``url, html``) whose source has a known type."""
    known = seeds.filter(F.col("type").isin(SEED_TYPES)).select(F.col("name").alias("source"), "url")
    return directory_links(known.join(pages.filter("html is not null"), "url").select("source", "html"))


def _kept(links: Column, method: str, confidence) -> Column:
    return F.transform(links, lambda a: F.struct(a["url"].alias("url"), F.trim(a["name"]).alias("name"), F.lit(method).alias("method"), confidence(a).cast("double").alias("confidence")))


def xfn_anchors(html: Column) -> Column:
    """Anchors with href and rel, href first and then rel first."""
    href, rel = attr("href"), attr("rel")
    return F.concat(zipped(html, f"<a[^>]+{href}[^>]*{rel}[^>]*>([^<]*)</a>", 1, 3, 2), zipped(html, f"<a[^>]+{rel}[^>]*{href}[^>]*>([^<]*)</a>", 2, 3, 1))


def xfn_confidence(rel: Column) -> Column:
    """Confidence of the first known relation, or null."""
    known = F.get(F.filter(F.split(F.lower(rel), r"\s+"), lambda w: w.isin(list(XFN_CONFIDENCE))), F.lit(0))
    return F.element_at(F.create_map(*(F.lit(x) for pair in XFN_CONFIDENCE.items() for x in pair)), known)


def following_anchors(html: Column) -> Column:
    href, rel = attr("href"), attr("rel", f"[^\"']*{word('following')}[^\"']*")
    return F.concat(zipped(html, f"<a[^>]+{rel}[^>]*{href}[^>]*>([^<]*)</a>", 1, 2), zipped(html, f"<a[^>]+{href}[^>]*{rel}[^>]*>([^<]*)</a>", 1, 2))


def sections(html: Column) -> Column:
    """Contents of link containers, then of the first section under each link heading (if it ends within SECTION characters)."""
    boxes = [every(html, BOX.replace("NAME", k), 2) for k in CONTAINERS]
    under = [F.array(F.regexp_extract(html, UNDER.replace("NAME", h), 1)) for h in HEADINGS]
    return F.concat(*boxes, *under)


def friend_links(pages: DataFrame) -> DataFrame:
    """``site_id, url, name, method, confidence`` of pages (``site_id, html``): valid links, the surest method's of each URL.

    By XFN relation the first anchor of a URL decides, whether it has a relation or not. All work is inside
    the page's row.
    """
    html = F.col("html")
    parts = pages.select("site_id", xfn_anchors(html).alias("x"), following_anchors(html).alias("f"), F.flatten(F.transform(sections(html), lambda s: zipped(s, ANCHOR, 1, 2))).alias("h"))
    parts = parts.select("site_id", once(F.col("x")).alias("x"), "f", "h")
    by_xfn = F.filter(_kept(F.col("x"), "xfn", lambda a: xfn_confidence(a["rel"])), lambda a: a["confidence"].isNotNull())
    rest = [_kept(F.col("f"), "microformat", lambda _: F.lit(FOLLOWING_CONFIDENCE)), _kept(F.col("h"), "heuristic", lambda _: F.lit(HEURISTIC_CONFIDENCE))]
    none = F.array().cast("array<struct<url:string,name:string,method:string,confidence:double>>")
    all_of = F.filter(F.concat(*(F.coalesce(c, none) for c in (by_xfn, *rest))), lambda a: valid_site(a["url"]))
    spread = parts.select("site_id", all_of.alias("a")).select("site_id", F.explode(once(F.col("a"))).alias("a"))
    return spread.select("site_id", "a.url", F.nullif("a.name", F.lit("")).alias("name"), "a.method", "a.confidence")
