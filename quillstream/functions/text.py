"""Entities, dates, display text and small conversions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]
DATE_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy"]


def _unit(digits: str, base: int) -> str:
    """A UTF-16 code unit; numbers wrap, and those too large for a double are 0."""
    n = int(digits, base) if len(digits) < 15 else float(int(digits, base)) if len(digits) < 250 else 0
    return chr(int(n) % 65536)


def numeric_entities(t: str) -> str:
    """Decimal, then hexadecimal entities; two that are a surrogate pair become one character, half a pair U+FFFD."""
    t = re.sub(r"&#([0-9]+);", lambda m: _unit(m[1], 10), t)
    t = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: _unit(m[1], 16), t)
    return t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@F.pandas_udf(T.StringType())
def _numeric_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else numeric_entities(t), na_action=None)


def decode_named(text: Column) -> Column:
    """Named XML entities in this order, so that ``&amp;quot;`` decodes twice."""
    for entity, char in NAMED:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_entities(text: Column) -> Column:
    """Named, then numeric entities; only texts with ``&#`` leave the JVM."""
    named = decode_named(text)
    numeric = named.contains("&#")
    return F.when(numeric, _numeric_entities(F.when(numeric, named))).otherwise(named)


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` in the session's zone of an RFC 822 or ISO date, else null."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS), F.try_to_timestamp(plain)), "yyyy-MM-dd")


def new_york_day(as_of: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(as_of, "America/New_York"), "yyyy-MM-dd")


def escape_html(text: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def truncate(text: Column, n: int = 150) -> Column:
    return F.when(F.length(text) > n, F.concat(F.trim(F.substring(text, 1, n)), F.lit("..."))).otherwise(text)


def display_date(day: Column, lang: str = "zh") -> Column:
    """Year, month and day without leading zeros, as Chinese pages show them, or month first."""
    return F.date_format(day, "yyyy/M/d" if lang == "zh" else "M/d/yyyy")


def empty_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parse_languages(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array(F.lit("zh")))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor((done * 200 + total) / (total * 2))).cast("int")


def progress_label(done: Column, total: Column, name: Column) -> Column:
    return F.format_string("%d%% (%d/%d) · %s", percent(done, total), done, total, name)
