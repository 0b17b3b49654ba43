"""A memo table: (key, value, created, ttl), keyed by the SHA-256 of a signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(signature: Column) -> Column:
    return F.sha2(signature.cast("string"), 256)


def signature(namespace: str, key: Column) -> Column:
    return F.concat(F.lit(f"{namespace}|"), key.cast("string"))


def expired(now: Column) -> Column:
    """A null time to live never expires."""
    return F.coalesce(now > F.col("created") + F.col("ttl"), F.lit(False))


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Per key the newest row wins; of equally new ones the added row, then the greater value. One aggregate, no window."""
    both = table.withColumn("added", F.lit(0)).unionByName(rows.withColumn("added", F.lit(1)))
    best = F.max(F.struct("created", "added", "value", F.col("ttl"))).alias("b")
    return both.groupBy("key").agg(best).select("key", "b.value", "b.created", "b.ttl")


def live(table: DataFrame, now: Column) -> DataFrame:
    """The table without what has expired, which is also what a purge writes back."""
    return table.where(~expired(now))


def lookup(requests: DataFrame, table: DataFrame, now: Column) -> DataFrame:
    """``requests`` (signature) with value, null for a miss; a stored null counts as one."""
    asked = requests.withColumn("key", key_of(F.col("signature")))
    return asked.join(live(table, now).select("key", "value"), "key", "left")


def misses(requests: DataFrame, table: DataFrame, now: Column) -> DataFrame:
    asked = requests.withColumn("key", key_of(F.col("signature")))
    return asked.join(live(table, now).where("value is not null"), "key", "left_anti")


def cached(requests: DataFrame, table: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column) -> tuple[DataFrame, DataFrame]:
    """(results, new table): ``compute`` turns missing (signature, key) into (key, value json) and runs once per key."""
    missing = compute(misses(requests, table, now).dropDuplicates(["key"]))
    fresh = missing.select("key", "value", now.cast("double").alias("created"), F.lit(None).cast("double").alias("ttl"))
    new = upsert(table, fresh)
    return lookup(requests, new, now), new
