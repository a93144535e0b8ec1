"""Write-side operators as functions of old rows and input rows to new rows. Clocks are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.operators.cuts import numbered


def first_rows(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def new_rows(old: DataFrame, given: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-if-new: the first input row of each key that isn't stored; rows whose key is empty are left out."""
    usable = given
    for k in keys:
        usable = usable.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return first_rows(usable, keys, order).join(old.select(*keys), keys, "left_anti")


def insert_if_new(old: DataFrame, given: DataFrame, keys: list[str], order: str, id_col: str = "id") -> DataFrame:
    """``old`` with the new rows of ``given`` under ids that follow the largest, in their order. All uses of the result see the same ids."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    fresh = numbered(new_rows(old, given, keys, order), "__i", order, *keys).join(F.broadcast(top))
    fresh = fresh.withColumn(id_col, F.col("__top") + F.col("__i")).drop("__i", "__top")
    return old.unionByName(fresh, allowMissingColumns=True).select(*old.columns)


def with_is_new(old: DataFrame, given: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every input row with ``is_new``: stored by this input rather than before it or by an earlier row of it."""
    ranked = given.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    known = old.select(*keys).distinct().withColumn("__old", F.lit(True))
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return ranked.join(known, keys, "left").withColumn("is_new", (F.col("__n") == 1) & F.col("__old").isNull() & F.coalesce(usable, F.lit(False))).drop("__n", "__old")


def strict_insert_status(old: DataFrame, given: DataFrame) -> DataFrame:
    """HTTP-like status of inserting each row by url: 400 without one, 409 where it is stored or repeated, else 201."""
    flagged = with_is_new(old, given, ["url"], "seq")
    missing = F.col("url").isNull() | (F.col("url") == "")
    return flagged.withColumn("status", F.when(missing, 400).when(F.col("is_new"), 201).otherwise(409)).drop("is_new")


def upsert_relationships(old: DataFrame, given: DataFrame, as_of: Column) -> DataFrame:
    """Last write wins per (source, target url, type) but for ``discovered_at``; ``last_seen_at`` is ``as_of`` where touched. ``given`` has an order ``seq``."""
    keys = schemas.UNIQUE["site_relationships"]
    last = first_rows(given, keys, F.desc("seq")).select(*keys, *(F.col(c).alias(f"new_{c}") for c in ("target_site_id", "discovery_method", "confidence")), F.lit(True).alias("touched"))
    met = old.join(last, keys, "full")
    pick = lambda c: F.when(F.col("touched"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return met.select(
        *keys, pick("target_site_id"), pick("discovery_method"), pick("confidence"), F.coalesce("discovered_at", as_of).alias("discovered_at"),
        F.when(F.col("touched"), as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each article (the larger id of two at once)."""
    best = F.max_by(F.struct("id", "comment_count", "snapshot_at"), F.struct("snapshot_at", "id"))
    return snapshots.groupBy("article_id").agg(best.alias("s")).select("article_id", "s.*")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before them, and each article's first."""
    before = F.lag("comment_count").over(Window.partitionBy("article_id").orderBy("snapshot_at", "id"))
    seen = F.row_number().over(Window.partitionBy("article_id").orderBy("snapshot_at", "id"))
    return snapshots.withColumn("before", before).withColumn("n", seen).filter("n = 1 or not (before <=> comment_count)").drop("n")


def append_changed(old: DataFrame, given: DataFrame, as_of: Column) -> DataFrame:
    """New snapshots for counts (``article_id, comment_count``) above 0 that differ from the article's latest."""
    last = latest_snapshots(old).select("article_id", F.col("comment_count").alias("before"))
    fresh = given.filter("comment_count > 0").join(last, "article_id", "left").filter("before is null or before <> comment_count")
    return fresh.select("article_id", "comment_count", as_of.alias("snapshot_at"))


def _one_each(new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return first_rows(new.select(key, *columns), [key], *(F.asc_nulls_last(c) for c in columns))


def replace_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str], keep_old_if_null: bool = False) -> DataFrame:
    """``columns`` of the rows that ``new`` has by ``key`` take its values, nulls too unless told otherwise.

    Of rows of ``new`` that repeat a key the one with the least values counts (nulls last); none multiplies a stored row.
    """
    given = _one_each(new, key, columns).select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    value = lambda c: F.coalesce(f"__{c}", c) if keep_old_if_null else F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c))
    met = old.join(given, key, "left")
    return met.select(*(value(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def fill_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` that are null (or empty text) take the values that ``new`` has by ``key``; others stay. Repeated keys of ``new`` as in ``replace_columns``."""
    given = _one_each(new, key, columns).select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    value = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), f"__{c}", c)
    return old.join(given, key, "left").select(*(value(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def crawl_outcomes(blogs: DataFrame, outcomes: DataFrame, as_of: Column, failure_sets_time: bool = True) -> DataFrame:
    """Success clears errors; failure counts one more and keeps its message; both set the time (a poller's failure doesn't). ``outcomes``: ``id, ok, message``.

    Several outcomes of a blog are one crawl: a success if any was, else the failure with the least message.
    """
    one = first_rows(outcomes.select("id", "ok", "message"), ["id"], F.desc_nulls_last("ok"), F.asc_nulls_last("message"))
    met = blogs.join(one.withColumn("__hit", F.lit(True)), "id", "left")
    ok, hit = F.coalesce("ok", F.lit(False)), F.coalesce("__hit", F.lit(False))
    new = {
        "last_scraped_at": F.when(hit & (ok | F.lit(failure_sets_time)), as_of).otherwise(F.col("last_scraped_at")),
        "error_count": F.when(hit & ok, 0).when(hit, F.col("error_count") + 1).otherwise(F.col("error_count")),
        "last_error": F.when(hit & ok, F.lit(None)).when(hit, F.col("message")).otherwise(F.col("last_error")),
    }
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in blogs.columns))


def get_or_create(sites: DataFrame, urls: DataFrame) -> DataFrame:
    """``url, id`` of every distinct url, stored ones by their id and new ones after the largest."""
    wanted = urls.select("url").filter("url is not null").distinct()
    grown = insert_if_new(sites.select("id", "url"), wanted.select("url"), ["url"], "url")
    return grown.join(wanted, "url", "left_semi").select("url", "id")


def mark_roots(sites: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sites whose url is a seed's get trust 1 and hop 0."""
    roots = seeds.select("url").distinct().withColumn("__root", F.lit(True))
    met = sites.join(roots, "url", "left")
    new = {"trust_score": F.when(F.col("__root"), 1.0).otherwise(F.col("trust_score")), "hop_count": F.when(F.col("__root"), 0).otherwise(F.col("hop_count"))}
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in sites.columns))


def move_cursor(state: DataFrame, blog_id: Column, running: Column, as_of: Column) -> DataFrame:
    """The one row of crawl state after a step; no blog leaves the old one."""
    return state.select("id", F.coalesce(blog_id, "current_blog_id").alias("current_blog_id"), as_of.alias("last_crawl_at"), running.alias("is_running"))


def with_missing_columns(rows: DataFrame, table: str) -> DataFrame:
    """Columns of the table's schema, those that are missing with their default (or null)."""
    defaults = schemas.DEFAULTS.get(table, {})
    fields = {f.name: f.dataType for f in schemas.schema(table)}
    added = {n: F.expr(defaults.get(n, "null")).cast(t) for n, t in fields.items() if n not in rows.columns}
    return rows.select(*(added[n].alias(n) if n in added else F.col(n).cast(t).alias(n) for n, t in fields.items()), *(c for c in rows.columns if c not in fields))


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    out = rows
    for c, default in schemas.DEFAULTS.get(table, {}).items():
        if c in rows.columns:
            out = out.withColumn(c, F.coalesce(c, F.expr(default)))
    return out


def violations(rows: DataFrame, table: str) -> DataFrame:
    """``rule, detail, n`` for each broken key or missing value; empty if all hold."""
    keys = schemas.UNIQUE.get(table, [])
    parts = [rows.filter(F.col(c).isNull()).agg(F.lit("not null").alias("rule"), F.lit(c).alias("detail"), F.count("*").alias("n")) for c in schemas.NOT_NULL.get(table, [])]
    if keys:
        parts.append(rows.groupBy(*keys).count().filter("count > 1").agg(F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("detail"), F.count("*").alias("n")))
    if table == "crawl_state":
        parts.append(rows.filter("id <> 1").agg(F.lit("check").alias("rule"), F.lit("id = 1").alias("detail"), F.count("*").alias("n")))
    if not parts:
        return rows.sparkSession.createDataFrame([], "rule string, detail string, n bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def fill_article_languages(articles: DataFrame, detected: Column) -> DataFrame:
    return articles.withColumn("language", F.coalesce("language", detected))


def refreshed_languages(blogs: DataFrame, detected: DataFrame, only_from: str = "zh") -> DataFrame:
    """``id, languages`` of scraped blogs that still have the single language ``only_from`` and turn out otherwise. ``detected``: ``id, found``."""
    candidates = blogs.filter(F.col("last_scraped_at").isNotNull() & (F.to_json("languages") == f'["{only_from}"]'))
    return candidates.join(detected, "id").filter(~F.col("languages").eqNullSafe(F.col("found"))).select("id", F.col("found").alias("languages"))
