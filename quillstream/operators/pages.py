"""Facts that a page's HTML shows: feeds, protocols, generator, theme, comment system.

Each builder takes Columns and returns a Column, so that all facts of a page come from one
projection. Patterns are data: they are compiled into one expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.urls import resolve_page_url

Q = "[\"']"
VALUE = "([^\"']+)"
ASCII_WORD = "[A-Za-z0-9_]"


def attr(name: str, value: str = VALUE) -> str:
    return f"{name}={Q}{value}{Q}"


def word(text: str) -> str:
    """``text`` as a whole ASCII word."""
    return f"(?<!{ASCII_WORD}){text}(?!{ASCII_WORD})"


def first(html: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null; case doesn't matter."""
    return F.nullif(F.regexp_extract(html, f"(?i){pattern}", group), F.lit(""))


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(group))


def once(rows: Column, always=None) -> Column:
    """An array of structs with each ``url`` once, where it comes first, and all that ``always`` (a function of the struct) names; by two sorts of the array."""
    keyed = F.transform(rows, lambda x, i: F.struct(x["url"].alias("url"), i.alias("i"), x.alias("x")))
    stays = lambda s, x, i: (i == 0) | ~F.get(s, i - 1)["url"].eqNullSafe(x["url"]) | (always(x["x"]) if always else F.lit(False))
    kept = once_of(F.array_sort(keyed), lambda s: F.filter(s, lambda x, i: stays(s, x, i)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def support(found: Column, base: Column) -> Column:
    return F.struct(found.isNotNull().alias("supported"), resolve_page_url(found, base).alias("url"))


# fixed values: where pages announce an OPML list, in order of preference
OPML_TYPE = attr("type", "text/x-opml")
OPML_REL = attr("rel", "(?:blogroll|alternate)")
OPML_FILE = "([^\"']+[.]opml)"
OPML = [
    f"<link[^>]+(?:{OPML_REL}[^>]*{OPML_TYPE}|{OPML_TYPE}[^>]*{OPML_REL})[^>]*{attr('href')}",
    f"<link[^>]+{OPML_TYPE}[^>]*{attr('href')}",
    f"<a[^>]+{attr('href', OPML_FILE)}[^>]*{OPML_TYPE}[^>]*>",
    f"<a[^>]+{OPML_TYPE}[^>]*{attr('href')}[^>]*>",
    f"<a[^>]+{attr('href', OPML_FILE)}[^>]*>",
]
WEBMENTION = [f"<{tag}[^>]+{attr('rel', 'webmention')}[^>]*{attr('href')}" for tag in ("link", "a")]
FEED_TYPE = attr("type", "application/(?:rss|atom)[+]xml")
FEED = [
    f"<link[^>]+{attr('rel', 'alternate')}[^>]+{FEED_TYPE}[^>]*{attr('href')}[^>]*>",
    f"<link[^>]+{FEED_TYPE}[^>]*{attr('href')}[^>]*>",
    f"<link[^>]+{attr('href')}[^>]*{FEED_TYPE}[^>]*>",
]
# fixed values: relation words of XFN
XFN = [
    "friend", "acquaintance", "contact", "met", "co-worker", "colleague", "co-resident", "neighbor", "child", "parent", "sibling", "spouse", "kin", "muse", "crush", "date", "sweetheart",
]


def opml_url(html: Column) -> Column:
    return F.coalesce(*(first(html, p) for p in OPML))


def webmention_url(html: Column) -> Column:
    return F.coalesce(*(first(html, p) for p in WEBMENTION))


def feed_href(html: Column) -> Column:
    return F.coalesce(*(first(html, p) for p in FEED))


def discovered_feed(html: Column, base: Column) -> Column:
    """Feed URL of a page: rooted paths get the site's origin, absolute URLs stay, all else is null."""
    href = F.coalesce(*(first(html, p) for p in (f"<link[^>]+{FEED_TYPE}[^>]+{attr('href')}", f"<link[^>]+{attr('href')}[^>]+{FEED_TYPE}")))
    origin = F.regexp_extract(base, r"(?i)^https?://[^/?#]+", 0)
    return F.when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("http"), href)


def has_class(html: Column, name: str) -> Column:
    return html.rlike(f"(?i)class={Q}[^\"']*{word(name)}[^\"']*{Q}")


def rel_links(html: Column, relation: str) -> Column:
    rel = attr("rel", f"[^\"']*{word(relation)}[^\"']*")
    return F.array_union(every(html, f"<a[^>]+{rel}[^>]*{attr('href')}"), every(html, f"<a[^>]+{attr('href')}[^>]*{rel}"))


def microformats(html: Column) -> Column:
    return F.struct(has_class(html, "h-card").alias("h_card"), has_class(html, "h-feed").alias("h_feed"), rel_links(html, "me").alias("rel_me"), rel_links(html, "following").alias("rel_following"))


def rel_pairs(html: Column) -> Column:
    """``url, rel, ahead`` of all anchors with both: href-first matches in their order, then rel-first ones."""
    ahead, behind = f"<a[^>]+{attr('href')}[^>]*{attr('rel')}[^>]*>", f"<a[^>]+{attr('rel')}[^>]*{attr('href')}[^>]*>"
    pairs = lambda p, u, r, first: F.transform(F.arrays_zip(every(html, p, u).alias("url"), every(html, p, r).alias("rel")), lambda x: F.struct(x["url"].alias("url"), x["rel"].alias("rel"), F.lit(first).alias("ahead")))
    return F.concat(pairs(ahead, 1, 2, True), pairs(behind, 2, 1, False))


def words_of(rel: Column) -> Column:
    return F.filter(F.split(F.lower(rel), r"\s+"), lambda w: w.isin(XFN))


def xfn(html: Column) -> Column:
    """Array of ``url, rel`` (relation words only) of the anchors with one; a rel-first match of a URL already there is left out."""
    kept = F.filter(F.transform(rel_pairs(html), lambda p: F.struct(p["url"].alias("url"), words_of(p["rel"]).alias("rel"), p["ahead"].alias("ahead"))), lambda p: F.size(p["rel"]) > 0)
    return F.transform(once(kept, lambda p: p["ahead"]), lambda p: F.struct(p["url"].alias("url"), p["rel"].alias("rel")))


def protocols(html: Column, base: Column) -> Column:
    """All protocols of a page in one struct."""
    return F.struct(
        support(opml_url(html), base).alias("opml"), support(webmention_url(html), base).alias("webmention"), microformats(html).alias("microformats"),
        xfn(html).alias("xfn"), support(feed_href(html), base).alias("rss"),
    )


GENERATOR = f"<meta[^>]+{attr('name', 'generator')}[^>]+{attr('content')}"
COMMENT = r"<!--[\s\S]*?-->"
CLASS = f"class={Q}[^\"']*"
# fixed values: signals of site generators (name: kind, pattern, confidence)
GENERATORS = {
    "hexo": [("generator", "hexo", 0.95), ("comment", "hexo-inject", 0.9), ("path", "/hexo/", 0.7)],
    "hugo": [("generator", "hugo", 0.95), ("comment", r"generator:\s*hugo", 0.9), ("path", "/hugo/", 0.6)],
    "wordpress": [("generator", "wordpress", 0.95), ("path", "/wp-content/", 0.9), ("path", "/wp-includes/", 0.9)],
    "jekyll": [("generator", "jekyll", 0.95), ("comment", "jekyll", 0.7)],
    "ghost": [("generator", "ghost", 0.95), ("class", CLASS + "ghost-", 0.8)],
    "typecho": [("generator", "typecho", 0.95), ("path", "/usr/themes/", 0.8)],
    "astro": [("generator", "astro", 0.95), ("comment", "astro", 0.7)],
    "nextjs": [("script", "_next/static", 0.85), ("path", "/_next/", 0.85)],
    "gatsby": [("generator", "gatsby", 0.95), ("path", "/gatsby/", 0.7)],
    "vitepress": [("generator", "vitepress", 0.95), ("class", CLASS + "VPDoc", 0.8)],
    "11ty": [("generator", "eleventy", 0.95), ("comment", "11ty", 0.7)],
}
# fixed values: signals of Hexo themes
THEMES = {
    "butterfly": [("class", CLASS + "butterfly", 0.9), ("id", f"id={Q}page-header{Q}", 0.7)],
    "next": [("class", CLASS + word("next"), 0.85), ("class", CLASS + "NexT", 0.9)],
    "fluid": [("id", f"id={Q}fluid-container{Q}", 0.9), ("class", CLASS + "fluid-container", 0.9)],
    "icarus": [("class", CLASS + "icarus", 0.9), ("class", "is-3-column", 0.6)],
    "volantis": [("class", CLASS + "volantis", 0.9)],
    "matery": [("class", CLASS + "materialize", 0.7), ("path", "matery", 0.8)],
}
# fixed values: signals of comment systems, in order
COMMENT_SYSTEMS = {
    "giscus": r"giscus\.app|data-giscus|class=[\"']giscus[\"']",
    "disqus": r"disqus_thread|disqus\.com|disqus_config",
    "utterances": r"utteranc\.es|utterances",
    "cusdis": "cusdis",
    "waline": r"@waline/client|waline\.js|id=[\"']waline[\"']",
    "twikoo": "twikoo|tcomment",
    "artalk": "artalk",
    "wordpress": "wp-comments|comment-respond",
}


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def has(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text has a signal, case aside. Plain alternatives are searched for as they are; a pattern is tried only where its last plain part is."""
    out = F.lit(False)
    for part in pattern.lower().split("|"):
        plain = part.replace("\\.", "\0")
        if re.fullmatch(r"[\w/@ \0-]+", plain):
            out = out | low.contains(plain.replace("\0", "."))
        else:
            needed = re.findall(r"[a-z0-9_-]{3,}", re.sub(r"\(\?[<!=:]*[^()]*\)|\[[^\]]*\]|\\.", " ", part))
            out = out | ((low.contains(needed[-1]) & low.rlike(part)) if needed else low.rlike(part))
    return out


def once_of(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, as it is a variable there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signals(rules: dict, where) -> Column:
    """Array of what matches, in order: ``confidence``, ``order`` (negative: the first wins a tie), ``name``, ``kind``."""
    out, n = [], 0
    for name, patterns in rules.items():
        for kind, pattern, confidence in patterns:
            n += 1
            out.append(F.when(has(where(kind), pattern), F.struct(F.lit(confidence).alias("confidence"), F.lit(-n).alias("order"), F.lit(name).alias("name"), F.lit(kind).alias("kind"))))
    return F.array_compact(F.array(*out))


def generator_signals(html: Column) -> Column:
    low = lowered(html)
    meta = F.coalesce(F.when(low.contains("generator"), lowered(first(html, GENERATOR))), F.lit(""))
    comments = F.coalesce(F.when(html.contains("<!--"), lowered(F.array_join(every(html, COMMENT, 0), "\n"))), F.lit(""))
    places = F.struct(low.alias("low"), meta.alias("generator"), comments.alias("comment"))
    return once_of(places, lambda s: _signals(GENERATORS, lambda kind: s[kind] if kind in ("generator", "comment") else s["low"]))


def generator(html: Column) -> Column:
    """``ssg, confidence, signals`` (kind:name of all that matches, in order); the surest wins, then the first."""

    def told(found: Column) -> Column:
        best = F.array_max(found)
        return F.struct(
            best["name"].alias("ssg"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), F.transform(found, lambda s: F.concat(s["kind"], F.lit(":"), s["name"])).alias("signals")
        )

    return once_of(generator_signals(html), told)


def theme(html: Column, ssg: Column) -> Column:
    """``theme, confidence`` of a Hexo site; null for all others."""
    best = F.when(ssg == "hexo", once_of(lowered(html), lambda low: F.array_max(_signals(THEMES, lambda _: low))))
    return once_of(best, lambda b: F.struct(b["name"].alias("theme"), b["confidence"].alias("confidence")))


def comment_system(html: Column) -> Column:
    return once_of(lowered(html), lambda low: F.coalesce(*(F.when(has(low, p), name) for name, p in COMMENT_SYSTEMS.items())))


def fingerprint(html: Column) -> Column:
    """``ssg, theme, comment_system, confidence`` (the larger of generator's and theme's), ``signals``."""

    def told(p: Column) -> Column:
        g, t = p["g"], p["t"]
        surest = F.greatest(g["confidence"], F.coalesce(t["confidence"], F.lit(0.0)))
        return F.struct(g["ssg"].alias("ssg"), t["theme"].alias("theme"), comment_system(html).alias("comment_system"), surest.alias("confidence"), g["signals"].alias("signals"))

    both = once_of(generator(html), lambda g: F.struct(g.alias("g"), theme(html, g["ssg"]).alias("t")))
    return once_of(both, told)
