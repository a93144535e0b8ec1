"""Reading tables and JSON lines, and looking at what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import empty_to_null

JSONL = "url string, name string, ssg string, comment_system struct<type:string>, circles array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_blogs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blogs of a JSON-lines file: ``url, name, ssg, comment_system``; a broken line or missing file is an error, blank lines are skipped."""
    rows = spark.read.schema(JSONL).option("mode", "FAILFAST").json(path)
    return rows.select(*(empty_to_null(F.col(c)).alias(c) for c in ("url", "name", "ssg")), empty_to_null(F.col("comment_system.type")).alias("comment_system"))


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def columns(spark: SparkSession, name: str) -> list[str]:
    return spark.table(name).columns
