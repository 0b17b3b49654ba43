"""Helpers shared by the operators: shared-folder tables, ordering without a single task, batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch, delete, materialize, release, scratch, shared_dir

__all__ = ["SPACE", "WORD", "bounded_batches", "delete", "hashed_sample", "lower_ascii", "materialize", "release", "row_numbers", "Scratch", "scratch", "shared_dir", "with_range_block", "word_count"]

#: White space of the corpus contract, as a Java character class and its complement.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows and bytes of an Arrow batch, as one text may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 2_048, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes.

    Bounds that are lower already stay. They are read when a plan runs, which may be long after this call, so they
    are not put back; results never depend on them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
        if now is None or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= most:
            spark.conf.set(key, str(most))


def hashed_sample(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """The ``most`` rows, of about ``total``, with the smallest hash of ``key``.

    Rows far above the expected bound go first, so that no task gathers ``most`` rows of every partition.
    """
    draw = F.pmod(F.xxhash64(key), F.lit(1_000_000_007))
    near = df if total <= 2 * most else df.where(draw < int(1_000_000_007 * 1.5 * most / total))
    return near.orderBy(draw, key).limit(most)


def with_range_block(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition's number as ``block``; written once.

    Blocks follow the order, and their number is Spark's shuffle partition count, whatever the rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    return materialize(ranged, "ranged")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space of ``SPACE`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_numbers(ranged: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``position`` (0-based over the whole order) to the result of ``with_range_block``.

    Rows are numbered inside their block; the blocks' offsets come from a table with one row a block.
    """
    offsets = (
        ranged.groupBy("block").count()
        .withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("block", "offset")
    )
    inside = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    return (
        ranged.withColumn("inside", inside)
        .join(offsets, "block")
        .withColumn("position", (F.col("offset") + F.col("inside")).cast("long"))
        .drop("inside", "offset")
    )
