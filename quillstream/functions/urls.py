"""URL resolution, normalisation and validity."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions.lang import host
from quillstream.functions.text import decode_named, numeric_entities

# fixed values: domains that are no independent sites, as the friend-link extractor has them
LINK_EXCLUDED = [
    "twitter.com", "x.com", "github.com", "facebook.com", "instagram.com", "youtube.com", "linkedin.com", "weibo.com", "zhihu.com", "douban.com", "bilibili.com", "t.me",
    "telegram.org", "discord.com", "discord.gg", "reddit.com", "medium.com", "dev.to",
]
# fixed values: and as the directory scraper has them
DIRECTORY_EXCLUDED = [
    "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "github.com", "gitlab.com", "bitbucket.org", "youtube.com", "tiktok.com", "reddit.com",
    "discord.com", "discord.gg", "twitch.tv", "pinterest.com", "tumblr.com", "medium.com", "substack.com", "dev.to", "hashnode.dev", "blogger.com", "wordpress.com",
]
# fixed values: paths of friend-link pages
FRIEND_PAGES = ["friends", "links", "友链", "link", "blogroll", "reads", "roll", "following"]
PARTS = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)"


def normalize_url(url: Column) -> Column:
    """Scheme, lower-cased host and path without one trailing slash; null for anything but http(s)."""
    part = lambda i: F.regexp_extract(url, PARTS, i)
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), r"/\z", "")))


def valid_site(url: Column, excluded: list[str] = LINK_EXCLUDED) -> Column:
    """Whether an http(s) URL leads to none of the excluded domains nor their subdomains."""
    name = host(url)
    pattern = r"^(?:.*\.)?(?:" + "|".join(re.escape(d) for d in excluded) + r")\z"
    return F.coalesce(~name.rlike(pattern), F.lit(False))


def friend_page(path: Column) -> Column:
    return path.rlike(r"(?i)^/(?:" + "|".join(FRIEND_PAGES) + r")/?\z")


def feed_url(base: Column, path: Column) -> Column:
    """A site's base without one trailing slash, and a path."""
    return F.concat(F.regexp_replace(base, r"/\z", ""), path)


def feed_link(path: Column, lang: Column) -> Column:
    """A feed page's link, with the language if there is one."""
    return F.when(lang.isNull() | (lang == ""), path).otherwise(F.concat(path, F.lit("?lang="), lang))


# fixed values: what the URL standard percent-encodes in a path, a query and a fragment of http(s) URLs, beside controls and all beyond ASCII
PATH_ENCODED, QUERY_ENCODED, FRAGMENT_ENCODED, USER_ENCODED = ' "<>?`{}#', ' "#<>\'', ' "<>`', ' "#<>?`{}/:;=@[\\]^|'
HOST_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
PORTS = {"http": "80", "https": "443"}
AUTHORITY = re.compile(r"[/\\]*([^/\\?#]*)(.*)", re.S)


def _encode(text: str, special: str) -> str:
    return "".join(c if "\x20" < c < "\x7f" and c not in special or c == " " and " " not in special else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str:
    """A host whose last label is a number, as a dotted address; ValueError where it is none."""
    labels = host.removesuffix(".").split(".")
    if not re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]):
        return host
    numbers = [int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels]
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(text: str) -> str:
    if text.startswith("["):
        return f"[{ipaddress.IPv6Address(text[1:].removesuffix(']')).compressed}]"
    name = unquote(text, errors="strict").lower()
    name = name if name.isascii() else name.encode("idna").decode("ascii").lower()
    if not name or HOST_FORBIDDEN.search(name):
        raise ValueError(text)
    return _ipv4(name)


def _path(text: str) -> str:
    out: list[str] = []
    segments = text.replace("\\", "/").removeprefix("/").split("/")
    for i, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots == "..":
            out[-1:] = []
        elif dots != ".":
            out.append(_encode(s, PATH_ENCODED))
            continue
        if i == len(segments) - 1:
            out.append("")
    return "/" + "/".join(out)


def _parts(rest: str) -> tuple[str, str | None, str | None]:
    """Path, query and fragment (None where there is none)."""
    rest, mark, fragment = rest.partition("#")
    path, question, query = rest.partition("?")
    return path, query if question else None, fragment if mark else None


def _href(scheme: str, authority: str, path: str, query: str | None, fragment: str | None) -> str:
    query, fragment = (None if x is None else m + _encode(x, e) for x, m, e in ((query, "?", QUERY_ENCODED), (fragment, "#", FRAGMENT_ENCODED)))
    return f"{scheme}://{authority}{path}{query or ''}{fragment or ''}"


def _authority(scheme: str, text: str) -> str:
    user, at, place = text.rpartition("@")
    host, port = (re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place) or re.fullmatch("()()", "x")).groups()  # type: ignore[union-attr]
    if port and int(port) > 65535:
        raise ValueError(text)
    name, colon, word = user.partition(":")
    held = _encode(name, USER_ENCODED) + (":" + _encode(word, USER_ENCODED) if word else "")
    port = str(int(port)) if port else ""
    return f"{held + '@' if held else ''}{_host(host)}{':' + port if port and port != PORTS[scheme] else ''}"


def join_url(url: str, base: str | None = None) -> str:
    """The URL standard's join for http(s) bases; ValueError where it fails. A URL of another scheme stays, its scheme in small letters."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    name, rest = (scheme[1].lower(), url[scheme.end() :]) if scheme else ("", url)
    if scheme and name not in PORTS:
        return f"{name}:{_encode(rest, '')}"
    if scheme and (base is None or rest[:1] in ("/", "\\") or not base.lower().startswith(f"{name}:")):
        authority, tail = AUTHORITY.fullmatch(rest).groups()  # type: ignore[union-attr]
        path, query, fragment = _parts(tail)
        return _href(name, _authority(name, authority), _path(path), query, fragment)
    if base is None:
        raise ValueError(url)
    whole = join_url(base)
    own, tail = re.fullmatch(r"(https?)://(.*)", whole, re.S).groups() if re.match("https?:", whole) else ("", "")  # type: ignore[union-attr]
    if not own:
        raise ValueError(base)
    if re.match(r"[/\\]{2}", rest):
        return join_url(f"{own}:{rest}")
    authority, tail = re.fullmatch(r"([^/]*)(.*)", tail, re.S).groups()  # type: ignore[union-attr]
    (old_path, old_query, _), (path, query, fragment) = _parts(tail), _parts(rest)
    if not path:
        return _href(own, authority, old_path, old_query if query is None else query, fragment)
    path = path if path[0] in "/\\" else old_path.rpartition("/")[0] + "/" + path
    return _href(own, authority, _path(path), query, fragment)


def _or_same(url: str, base: str | None) -> str:
    try:
        return join_url(url, base)
    except (ValueError, AttributeError):
        return url


@F.pandas_udf(T.StringType())
def _joined(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else _or_same(u, b) for u, b in zip(url, base)], dtype=object)


#: URLs that the join leaves as they are: small letters in scheme and host, a path without dot segments, and nothing to encode.
PLAIN_PAGE = r"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*/)*(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*)?\z"
ROOTED = r"^/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*/)*(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*)?\z"
ORIGIN = r"^(https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+)(?:[/?#]|\z)"


def _join(url: Column, base: Column, plain: Column) -> Column:
    """``plain`` is what needs no join, null elsewhere; a rooted plain path is put to a plain base's origin, and only what is left goes to Python."""
    known = F.coalesce(plain, _rooted(url, base))
    return F.coalesce(known, _joined(F.when(known.isNull(), url), base))


def _rooted(url: Column, base: Column) -> Column:
    return F.when(url.rlike(ROOTED) & base.rlike(ORIGIN), F.concat(F.regexp_extract(base, ORIGIN, 1), url))


def _plain_feed_url(url: Column, base: Column) -> Column:
    stays = (url == "") | base.isNull() | (base == "") | url.startswith("http://") | url.startswith("https://")
    scheme = F.when(base.startswith("https"), "https:").otherwise("http:")
    return F.when(stays, url).when(url.startswith("//"), F.concat(scheme, url))


def _known_feed_url(url: Column, base: Column) -> Column:
    return F.coalesce(_plain_feed_url(url, base), _rooted(url, base))


def resolve_feed_url(url: Column | str, base: Column | str) -> Column:
    """A feed's URL: absolute ones stay as they are, as does everything without a base; ``//`` takes the base's scheme; all else is joined."""
    url, base = (F.col(c) if isinstance(c, str) else c for c in (url, base))
    return _join(url, base, _plain_feed_url(url, base))


def _decoded_link(url: str, base: str | None) -> str:
    """``resolve_feed_url`` of a URL after its numeric entities, for one value."""
    url = numeric_entities(url)
    if not url or not base or url.startswith(("http://", "https://")):
        return url
    if url.startswith("//"):
        return ("https:" if base.startswith("https") else "http:") + url
    return _or_same(url, base)


@F.pandas_udf(T.StringType())
def _decoded_links(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else _decoded_link(u, b) for u, b in zip(url, base)], dtype=object)


def resolve_encoded_feed_url(url: Column, base: Column) -> Column:
    """``resolve_feed_url(decode_entities(url), base)`` with both in one call of Python for what needs it, so that a task has one Python worker for them and not one each."""
    named = decode_named(url)
    known = F.when(~named.contains("&#"), _known_feed_url(named, base))
    return F.coalesce(known, _decoded_links(F.when(known.isNull(), named), base))


def resolve_page_url(url: Column | str, base: Column | str) -> Column:
    """A page's URL: always joined and normalised; one that can't be stays as it is."""
    url, base = (F.col(c) if isinstance(c, str) else c for c in (url, base))
    return _join(url, base, F.when(url.rlike(PLAIN_PAGE), url))
