"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Two lists are looked up at once: rules (a host with its subdomains, and a path prefix) and exact
canonical URLs. Every distinct URL asks for each suffix of its host with each prefix of its path
that is as long as some rule's, and for itself. The Bloom filter is a table of 512-bit blocks, so
each question reads one block; what passes is joined with the lists, which removes the filter's
false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import LOWER, UPPER, row_of, save, table

LANES = 8
BITS_PER_KEY = 16
#: Blocks of 64 bytes that are broadcast at most (32 MB), and list rows; beyond them Spark shuffles.
BROADCAST_BLOCKS = 1 << 19
BROADCAST_ROWS = 100_000

# fixed values: the rules (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def after_scheme(url: str) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def canonical(host: Column, path: Column) -> Column:
    """The key of one URL: the host without a leading ``www.``, the path without trailing slashes."""
    return F.concat(F.lit("="), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("~"), host, F.lit(" "), path)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")


def _masks() -> list[Column]:
    second = F.xxhash64("key", F.lit(1))
    lane = lambda i: F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), lane(i)).alias(f"m{i}") for i in range(LANES)]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of ``n`` keys as a table ``block, m0..m7``, and its number of blocks."""
    blocks = max(1, math.ceil(n * BITS_PER_KEY / (64 * LANES)))
    built = keys.select(_block(blocks), *_masks()).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"b{i}") for i in range(LANES)))
    return save(built), blocks


def possible(asked: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``asked`` (column ``key``) that the Bloom filter of ``keys`` lets pass."""
    built, blocks = bloom(keys, n)
    met = asked.select("*", _block(blocks), *_masks()).join(F.broadcast(built) if blocks <= BROADCAST_BLOCKS else built, "block")
    return met.filter(" AND ".join(f"b{i} & m{i} = m{i}" for i in range(LANES))).select(*asked.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Every row of ``pages`` with its verdict: ``page`` (the row as a struct), ``host``, ``path``, ``rule``, ``listed``, ``verdict``.

    ``rules``: ``host, path, verdict``; a rule fits its host and all subdomains where the URL's path
    starts with its own; the longest (host and path together) wins, of two alike ``allow``.
    ``listed``: ``key`` (canonical URLs). A URL that no rule fits is blocked if it is listed, else
    allowed. Null URLs and those without ``://`` have empty parts and are allowed; repeated rows
    return alike; each table may be empty; list entries may repeat.
    """
    rows = with_parts(pages.select(row_of(pages).alias("page")).withColumn("url", F.col(f"page.`{url_col}`"))).drop("url")
    by_rule = rules.select(rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    exact = listed.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    lists = save(by_rule.unionByName(exact).filter("key is not null").groupBy("key", "rule").agg(F.min("verdict").alias("verdict")))
    n = lists.count()
    # path lengths and numbers of host labels of rules: small sets of small numbers, whatever the length of the lists
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    urls = rows.select("host", "path").filter("host <> ''").distinct()
    n_labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    counts = sorted(r[0] for r in rules.select(n_labels(F.col("host"))).distinct().collect() if r[0] is not None)
    labels = n_labels(F.col("host"))
    hosts = F.array_compact(F.array(*(F.when(labels >= k, F.substring_index("host", ".", -k)) for k in counts)).cast("array<string>"))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    questions = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: rule_key(h, p))))
    asked = urls.select("host", "path", F.explode(F.concat(questions, F.array(canonical(F.col("host"), F.col("path"))))).alias("key"))
    hits = possible(asked, lists.select("key"), n).join(F.broadcast(lists) if n <= BROADCAST_ROWS else lists, "key")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict"))
    best = save(hits.groupBy("host", "path").agg(F.max(rank).alias("best"), F.max(F.col("rule").isNull()).alias("listed")))  # written: a frequent URL's join can then be split
    met = rows.join(best, ["host", "path"], "left")
    in_list = F.coalesce("listed", F.lit(False))
    return met.select("page", "host", "path", F.col("best.rule").alias("rule"), in_list.alias("listed"), F.coalesce("best.verdict", F.when(in_list, "block").otherwise("allow")).alias("verdict"))


def mirrored(pages: DataFrame) -> DataFrame:
    """``key``: canonical URLs of pages whose html a page with a smaller id has too, but for the URLs of those first pages."""
    rows = with_parts(pages.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("sha"))).filter("sha is not null and host <> '' and page_id is not null")
    rows = rows.select("page_id", "sha", canonical(F.col("host"), F.col("path")).alias("key"))
    first = save(rows.groupBy("sha").agg(F.min("page_id").alias("first")))  # written: a frequent page's join can then be split
    told = rows.join(first, "sha").groupBy("key").agg(F.max(F.col("page_id") > F.col("first")).alias("copy"), F.max(F.col("page_id") == F.col("first")).alias("kept"))
    return told.filter("copy and not kept").select("key")


def standard_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def judge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = judge_urls(pages.select("page_id", "url"), standard_rules(spark), mirrored(pages))
    return found.select("page.page_id", "host", "path", "rule", "verdict")


def judge_sql() -> str:
    """DuckDB SQL of ``judge_pages``."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    key = "regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""WITH raw AS (SELECT page_id, html, coalesce({rest}, '') AS rest FROM pages),
        parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
        keyed AS (SELECT *, {key} AS key, CASE WHEN host <> '' THEN min(page_id) OVER (PARTITION BY html) END AS first FROM parts WHERE html IS NOT NULL AND host <> ''),
        mirror AS (SELECT key FROM keyed GROUP BY key HAVING bool_or(page_id > first) AND NOT bool_or(page_id = first)),
        rules(h, p, v) AS (VALUES {rules}),
        fit AS (SELECT page_id, host, path, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
        best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fit GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host <> '' AND ({key}) IN (SELECT key FROM mirror) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN best USING (host, path)"""
