"""Languages from Unicode ranges, html attributes and top-level domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes (U+3000 is white space, so the symbols start at 3001)
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}\x{3001}-\x{303f}\x{ff00}-\x{ffef}]"
JAPANESE = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}]"
KOREAN = r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}]"
LATIN = r"[A-Za-z\x{00c0}-\x{024f}]"
SKIPPED = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}.,!?;:'\"()\[\]{}]"
TAG = r"<[^>]+>"
HTML_LANG = r"(?i)<html[^>]*lang=[\"']([^\"']+)[\"']"
HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)"
ALIASES = {"cn": "zh", "jp": "ja", "kr": "ko"}
TLD_LANGUAGE = {"cn": "zh", "tw": "zh", "hk": "zh", "jp": "ja", "kr": "ko", "de": "de", "fr": "fr"}


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def count(text: Column, pattern: str) -> Column:
    """Characters of a class: what the text loses without them."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def densities(text: Column) -> Column:
    """Struct of counts: ``total`` (without skipped characters), ``cjk`` (Japanese included), ``ja``, ``ko``, ``latin``."""
    ja = count(text, JAPANESE)
    return F.struct(
        (F.length(text) - count(text, SKIPPED)).alias("total"), (count(text, CJK) + ja).alias("cjk"), ja.alias("ja"), count(text, KOREAN).alias("ko"), count(text, LATIN).alias("latin")
    )


def html_language(html: Column) -> Column:
    """Base code of the html tag's lang attribute, lower-cased; null where there is none."""
    code = F.lower(F.substring_index(F.regexp_extract(html, HTML_LANG, 1), "-", 1))
    known = F.nullif(F.trim(code), F.lit(""))
    out = known
    for alias, real in ALIASES.items():
        out = F.when(known == alias, real).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def tld_language(url: Column) -> Column:
    """Language of a URL's top-level domain, or null."""
    tld, out = F.substring_index(host(url), ".", -1), F.lit(None).cast("string")
    for code, language in TLD_LANGUAGE.items():
        out = F.when(tld == code, language).otherwise(out)
    return out


def over(part: Column, total: Column, percent: int) -> Column:
    return part * 100 > total * percent


def content_languages(d: Column) -> Column:
    """Languages that a text's densities show; none for under 20 characters."""
    main = F.when(over(d["ja"], d["total"], 1), "ja").when(over(d["ko"], d["total"], 1), "ko").when(over(d["cjk"], d["total"], 20), "zh")
    english = F.when(over(d["latin"], d["total"], 20), "en")
    return F.when(d["total"] < 20, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(main, english)))


def page_languages(html: Column, url: Column, d: Column) -> Column:
    """Languages of a page: html attribute, top-level domain and content in this order; ``[en]`` if none. ``d``: densities of its text."""
    found = F.array_distinct(F.array_compact(F.concat(F.array(html_language(html), tld_language(url)), content_languages(d))))
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def article_language(d: Column) -> Column:
    """Language of an article from its densities; ``en`` for short texts and where nothing else stands out."""
    long = d["total"] >= 10
    return F.when(long & over(d["ja"], d["total"], 5), "ja").when(long & over(d["ko"], d["total"], 5), "ko").when(long & over(d["cjk"], d["total"], 30), "zh").otherwise("en")
