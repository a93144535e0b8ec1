"""Stored tables in buckets of a key: Parquet folders partitioned by ``bucket``, so that an update reads and rewrites only the buckets that its rows fall in.

One writer at a time. An update whose merge gives the same rows when it is done again can be repeated after any failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators import store
from quillstream.operators.cuts import cut, numbered

#: Buckets of a table. An update plans with their numbers, so this bounds what the driver holds.
BUCKETS = 64


def bucket_of(keys: list[str], n: int = BUCKETS) -> Column:
    """The bucket of a key; a null key has one, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, keys: list[str], n: int, mode: str) -> None:
    dealt = rows.withColumn("bucket", bucket_of(keys, n)).repartition(n, "bucket").sortWithinPartitions("bucket", *keys)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], n: int = BUCKETS) -> None:
    """A new table of ``rows``; an error if there is one. An empty file in the first bucket keeps the columns of a table without rows."""
    rows.limit(0).coalesce(1).write.parquet(f"{path}/bucket=0")
    _write(rows, path, keys, n, "append")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, without ``bucket``."""
    return spark.read.parquet(path).drop("bucket")


def update(spark: SparkSession, path: str, given: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], n: int = BUCKETS) -> None:
    """Rewrite the buckets of ``given`` with ``merge(old, given)``: ``old`` has their stored rows, and all that merge returns has to belong to them.

    A row that merge leaves out is gone, unless its bucket comes out empty (then nothing is written there).
    """
    held = cut(given)
    touched = [r[0] for r in held.select(bucket_of(keys, n)).distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    _write(merge(old, held).select(old.columns), path, keys, n, "overwrite")


def replace_rows(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge in which given rows take the place of stored ones with their key."""
    return lambda old, given: old.join(given.select(*keys).distinct(), keys, "left_anti").unionByName(given, allowMissingColumns=True)


def new_rows_with_ids(spark: SparkSession, path: str, given: DataFrame, keys: list[str], order: str, n: int = BUCKETS, id_col: str = "id") -> DataFrame:
    """The rows of ``given`` that an insert-if-new adds, under ids that follow the largest stored one. Reads the touched buckets' keys, and of all others the ids alone."""
    touched = [r[0] for r in given.select(bucket_of(keys, n)).distinct().collect()]
    stored = spark.read.parquet(path)
    fresh = store.new_rows(stored.filter(F.col("bucket").isin(touched)).select(*keys), given, keys, order)
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    ranked = numbered(fresh, "__i", order, *keys).join(F.broadcast(top))
    return ranked.withColumn(id_col, F.col("__top") + F.col("__i")).drop("__i", "__top")


def insert_if_new(spark: SparkSession, path: str, given: DataFrame, keys: list[str], order: str, n: int = BUCKETS) -> DataFrame:
    """Insert-if-new into a stored table; returns the rows that came in."""
    fresh = cut(new_rows_with_ids(spark, path, given, keys, order, n))
    update(spark, path, fresh, keys, replace_rows(keys), n)
    return fresh


def upsert_relationships(spark: SparkSession, path: str, given: DataFrame, as_of: Column, n: int = BUCKETS) -> None:
    """Last write wins per (source, target url, type), in the touched buckets."""
    from quillstream.schemas import UNIQUE

    update(spark, path, given, UNIQUE["site_relationships"], lambda old, new: store.upsert_relationships(old, new, as_of), n)


def append_changed(spark: SparkSession, path: str, given: DataFrame, as_of: Column, n: int = BUCKETS) -> None:
    """New snapshots for counts that differ from the latest, in a table of snapshots in buckets of ``article_id``."""
    update(spark, path, given, ["article_id"], lambda old, new: old.unionByName(store.append_changed(old, new, as_of), allowMissingColumns=True), n)


def crawl_outcomes(spark: SparkSession, path: str, outcomes: DataFrame, as_of: Column, n: int = BUCKETS) -> None:
    """Outcomes of crawls, in a table of blogs in buckets of ``id``."""
    update(spark, path, outcomes, ["id"], lambda old, new: store.crawl_outcomes(old, new, as_of), n)


def merge_latest(spark: SparkSession, path: str, snapshots: DataFrame, n: int = BUCKETS) -> None:
    """Keep a table of each article's latest snapshot (``article_id, id, comment_count, snapshot_at``, in buckets of ``article_id``) up to date with new snapshots.

    The larger id of two at one time is the later, whichever came first; so a repeated batch changes nothing.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        best = Window.partitionBy("article_id").orderBy(F.desc("snapshot_at"), F.desc("id"))
        return old.unionByName(new.select(old.columns)).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")

    update(spark, path, snapshots, ["article_id"], merge, n)
