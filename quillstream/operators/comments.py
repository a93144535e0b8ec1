"""Comment systems and counts of a page, as a comment scraper needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: plain signs of each system, in order of detection
MARKERS = {"giscus": ["giscus"], "disqus": ["disqus"], "utterances": ["utterances", "utteranc.es"], "cusdis": ["cusdis"], "wordpress": ["wp-comments", "comment-respond"]}
# fixed values: signs that a widget is there although its count is not
PRESENT = {
    "giscus": ["data-giscus", "giscus.app", 'class="giscus"', "class='giscus'"], "disqus": ["disqus_thread", "disqus.com"], "utterances": ["utterances", "utteranc.es"],
    "cusdis": ["cusdis"], "wordpress": [],
}
# fixed values: patterns of counts
COUNTS = {
    "giscus": [r"(?i)data-discussion-count=[\"']?(\d+)[\"']?", r"(?i)giscus.*?(\d+)\s*(?:comment|reaction)"],
    "disqus": [r"(?i)disqus-comment-count[^>]*>.*?(\d+)\s*comment", r"(?i)#disqus_thread[^>]*>.*?(\d+)"],
    "wordpress": [r"(?i)comments-link[^>]*>.*?(\d+)\s*comment", r"(?i)(\d+)\s*(?:thought|comment|response)s?\s*(?:on|to)"],
}
COMMENT_ITEM = r"(?i)<li[^>]*class=[\"'][^\"']*comment[^\"']*[\"'][^>]*>"
#: Order in which the systems are asked when none is known.
ORDER = ["giscus", "disqus", "utterances", "wordpress", "cusdis"]


def _any(html: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | html.contains(s)
    return out


def detect(html: Column) -> Column:
    return F.coalesce(*(F.when(_any(html, signs), name) for name, signs in MARKERS.items()))


def number(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")).try_cast("int")


def count(html: Column, system: str) -> Column:
    """Comments by one system's parser: a number it prints, 0 where only the widget shows, else null."""
    found = [number(html, p) for p in COUNTS.get(system, [])]
    if system == "wordpress":
        items = F.regexp_count(html, F.lit(COMMENT_ITEM))
        found.append(F.when(items > 0, items))
    return F.coalesce(*found, F.when(_any(html, PRESENT[system]), 0)).cast("int")


PARSERS = {name: (lambda html, name=name: count(html, name)) for name in ORDER}


def scrape(html: Column, known: Column) -> Column:
    """``count, system`` by the known system's parser, else the detected one's, else the first with comments; or null."""

    def by(system: Column) -> Column:
        n = F.lit(None).cast("int")
        for name, parse in PARSERS.items():
            n = F.when(system == name, parse(html)).otherwise(n)
        return F.when(n.isNotNull(), F.struct(n.alias("count"), system.alias("system")))

    rest = [F.when(parse(html) > 0, F.struct(parse(html).alias("count"), F.lit(name).alias("system"))) for name, parse in PARSERS.items()]
    return F.coalesce(by(known), by(detect(html)), *rest)


def scrape_articles(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """``article_id, count, system`` of articles (``id, url, comment_system``) whose page (``url, html``) was fetched."""
    met = articles.join(pages.filter("html is not null"), "url")
    found = met.select(F.col("id").alias("article_id"), scrape(F.col("html"), F.col("comment_system")).alias("c")).filter("c is not null")
    return found.select("article_id", "c.count", "c.system")
