"""Tables cut off from their plan in the shared folder, and numbers in a stable order over them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The session's checkpoint folder; a temporary one only on a single machine whose session names none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quillstream-')}")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _ordered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in ranges of the order: ``__p`` numbers the ranges."""
    return cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def _before(sizes: DataFrame, *sums: str) -> DataFrame:
    """Of each range (a row for each partition): the sums of those before it."""
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__p", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__b_{c}") for c in sums))


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order (which should leave no ties). No task sees all rows, and all uses of the result agree."""
    held = _ordered(rows, *order)
    before = _before(held.groupBy("__p").agg(F.count("*").alias("n")), "n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return held.join(F.broadcast(before), "__p").withColumn(name, own + F.col("__b_n")).drop("__p", "__b_n")


def running_sums(rows: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over it and all rows before it in the order."""
    held = _ordered(rows.select("*", *(c.cast("long").alias(f"__v_{n}") for n, c in sums.items())), order)
    before = _before(held.groupBy("__p").agg(*(F.sum(f"__v_{n}").alias(n) for n in sums)), *sums)
    run = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = held.join(F.broadcast(before), "__p")
    for n in sums:
        met = met.withColumn(n, F.coalesce(F.sum(f"__v_{n}").over(run), F.lit(0)) + F.col(f"__b_{n}"))
    return met.drop("__p", *(f"__v_{n}" for n in sums), *(f"__b_{n}" for n in sums))
