"""Shared helpers: reading tables, tables written between steps, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regex class body (space and \t \n \v \f \r).
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path under the session's shared checkpoint folder.

    Only where the session names no such folder (single-machine tests) a temporary one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillstream-{uuid.uuid4().hex}"


def save(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_of(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as one struct, so that no name clashes; names may hold dots."""
    return F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), "")


def row_key(id_: Column, text: Column) -> Column:
    """A 128-bit key of a row's id and text. Rows that repeat both share the key, and the results."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\\N"))
    return F.unhex(F.md5(F.concat_ws(" ", F.md5(part(text).cast("binary")), part(id_))))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
