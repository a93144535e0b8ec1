"""RSS and Atom feeds: probing, splitting and reading entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import decode_entities, parse_date
from quillstream.functions.urls import feed_url, resolve_encoded_feed_url, resolve_feed_url
from quillstream.operators.pages import attr, first

# fixed values: paths that sites by each generator serve their feed on, and those of unknown ones
FEED_PATHS = {
    "hexo": ["/atom.xml", "/rss.xml", "/rss2.xml", "/feed.xml"], "hugo": ["/index.xml", "/feed.xml", "/rss.xml"], "wordpress": ["/feed/", "/rss/", "/feed/rss2/", "/feed/atom/"],
    "typecho": ["/feed/", "/feed/atom/"], "jekyll": ["/feed.xml", "/atom.xml", "/rss.xml"], "ghost": ["/rss/", "/feed/"], "astro": ["/rss.xml", "/feed.xml", "/atom.xml"],
    "nextjs": ["/feed.xml", "/rss.xml", "/api/rss"], "11ty": ["/feed.xml", "/feed/feed.xml", "/rss.xml"], "vitepress": ["/feed.xml", "/rss.xml"], "gatsby": ["/rss.xml", "/feed.xml"],
}
DEFAULT_PATHS = ["/feed.xml", "/rss.xml", "/atom.xml", "/index.xml", "/feed/", "/rss/"]


def feed_paths(ssg: Column) -> Column:
    out = F.array(*map(F.lit, DEFAULT_PATHS))
    for name, paths in FEED_PATHS.items():
        out = F.when(ssg == name, F.array(*map(F.lit, paths))).otherwise(out)
    return out


def probes(blogs: DataFrame) -> DataFrame:
    """``blog_id, url, pos, feed_url`` to try in order, for blogs (``id, url, ssg``)."""
    spread = blogs.select(F.col("id").alias("blog_id"), "url", F.posexplode(feed_paths(F.col("ssg"))).alias("pos", "path"))
    return spread.select("blog_id", "url", "pos", feed_url(F.col("url"), F.col("path")).alias("feed_url"))


def is_feed(body: Column) -> Column:
    return F.coalesce(body.contains("<?xml") | body.contains("<rss") | body.contains("<feed"), F.lit(False))


def first_feed(tried: DataFrame, responses: DataFrame) -> DataFrame:
    """Of each blog's probes the first whose response (``feed_url, status, body``) is a feed; blogs without one are left out."""
    met = tried.join(responses, "feed_url").filter((F.col("status") >= 200) & (F.col("status") < 300) & is_feed(F.col("body")))
    best = Window.partitionBy("blog_id").orderBy("pos")
    return met.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def is_atom(xml: Column) -> Column:
    return xml.contains("<feed") & xml.contains("xmlns")


def entries(xml: Column) -> Column:
    """Bodies of a feed's items or entries, empty ones left out."""
    body = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.when(is_atom(xml), body("entry")).otherwise(body("item")), lambda x: x != "")


def there(low: Column, tag: str) -> Column:
    """Whether a lower-cased text may have the tag; a plain search, which spares most texts the pattern."""
    return low.contains(f"<{tag}")


def raw_tag(xml: Column, tag: str, low: Column | None = None) -> Column:
    """A tag's trimmed content, CDATA first; null without the tag. ``low``: the text lower-cased, where it is at hand."""
    opened, close, cdata, end = rf"(?is)<{tag}(?:\s[^>]*)?>", f"</{tag}>", "<![CDATA[", "]]>"
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a match is found once and cut by places
    start = lambda m, mark: F.instr(m, mark) + len(mark)
    plain = let(F.regexp_substr(xml, F.lit(rf"{opened}.*?{close}")), lambda m: F.substring(m, start(m, ">"), F.length(m) - F.lit(len(close)) - start(m, ">") + 1))
    inside = F.regexp_substr(xml, F.lit(rf"{opened}\s*<!\[CDATA\[.*?\]\]>\s*{close}"))
    inside = let(inside, lambda m: F.substring(m, start(m, cdata), F.length(m) - F.length(F.substring_index(m, end, -1)) - len(end) - start(m, cdata) + 1))
    found = F.btrim(F.coalesce(F.when(xml.contains(cdata), inside), plain), F.lit(" \t\n\x0b\f\r"))
    return found if low is None else F.when(there(low, tag.lower()), found)


def filled(*options: Column) -> Column:
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options))


# fixed values: where an Atom entry has its link, and where an item has its picture, in order of preference, each with the tag that it needs
IMAGE_TYPE = attr("type", "image/[^\"']+")
LINKS = [("link", f"<link[^>]+{attr('rel', 'alternate')}[^>]+{attr('href')}"), ("link", f"<link[^>]+{attr('href')}")]
PICTURES = [
    ("media:thumbnail", f"<media:thumbnail[^>]+{attr('url')}"), ("enclosure", f"<enclosure[^>]+{attr('url')}[^>]+{IMAGE_TYPE}"), ("enclosure", f"<enclosure[^>]+{IMAGE_TYPE}[^>]+{attr('url')}"),
    ("img", f"<img[^>]+{attr('src')}"),
]


def _first_of(entry: Column, patterns: list[tuple[str, str]], low: Column | None) -> Column:
    return F.coalesce(*(first(entry, p) if low is None else F.when(there(low, tag), first(entry, p)) for tag, p in patterns))


def atom_link(entry: Column, low: Column | None = None) -> Column:
    return _first_of(entry, LINKS, low)


def cover_image(entry: Column, low: Column | None = None) -> Column:
    """Thumbnail, else image enclosure, else the first image of the content."""
    return _first_of(entry, PICTURES, low)


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Entries of feeds (``feed_id, base_url, xml``): ``feed_id, pos, title, url, description, cover_image, language, published_at``."""
    spread = feeds.select("feed_id", "base_url", is_atom(F.col("xml")).alias("atom"), F.posexplode(entries(F.col("xml"))).alias("pos", "e"))
    spread = spread.withColumn("low", F.lower("e"))
    e, low, atom = F.col("e"), F.col("low"), F.col("atom")
    # each tag of the feed's kind is read once, into a column; which one counts is decided over columns
    tag = lambda name, when=None: (raw_tag(e, name, low) if when is None else F.when(when, raw_tag(e, name, low)))
    tags = spread.select(
        "feed_id", "base_url", "pos", "atom", tag("title").alias("title"), F.when(atom, atom_link(e, low)).otherwise(tag("link")).alias("link"), tag("summary").alias("summary"), tag("content", atom).alias("content"),
        tag("description", ~atom).alias("description"), tag("published", atom).alias("published"), tag("updated", atom).alias("updated"), tag("pubDate", ~atom).alias("pub"), tag("dc:date", ~atom).alias("dc"),
        cover_image(e, low).alias("cover"),
    )
    text = F.when(atom, filled(F.col("summary"), F.col("content"))).otherwise(filled(F.col("description"), F.col("summary")))
    date = F.when(atom, filled(F.col("published"), F.col("updated"))).otherwise(filled(F.col("pub"), F.col("dc")))
    raw = tags.select("feed_id", "base_url", "pos", "title", "link", text.alias("text"), date.alias("date"), "cover")
    return raw.select(
        "feed_id", "pos", F.coalesce(decode_entities(F.col("title")), F.lit("")).alias("title"), F.coalesce(resolve_encoded_feed_url(F.col("link"), F.col("base_url")), F.lit("")).alias("url"),
        F.coalesce(decode_entities(F.col("text")), F.lit("")).alias("description"), resolve_feed_url(F.col("cover"), F.col("base_url")).alias("cover_image"),
        F.lit(None).cast("string").alias("language"), parse_date(F.col("date")).alias("published_at"),
    )
