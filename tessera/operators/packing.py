"""Packing of scored chunks into a token budget, per group, by window sums instead of a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized, split_words, word_count

SEPARATOR = "\n---\n"


def _words(text: Column) -> Column:
    return F.greatest(F.lit(1), word_count(text))


def order_chunks(chunks: DataFrame, strategy: str = "priority") -> DataFrame:
    """``chunks`` (group_id, pos, text, score) with ``turn``: by score, or dealt in turn from three score bands."""
    if strategy not in ("priority", "round_robin"):
        raise ValueError(f"unknown strategy {strategy}")
    group = Window.partitionBy("group_id")
    ranked = chunks.withColumn("turn", F.row_number().over(group.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "pos")) - 1)
    if strategy == "priority":
        return ranked
    third = F.greatest(F.lit(1), F.floor(F.count("*").over(group) / 3)).cast("int")
    banded = ranked.withColumn("third", third).withColumn("band", F.least(F.floor(F.col("turn") / F.col("third")), F.lit(2)).cast("int"))
    dealt = F.row_number().over(group.orderBy(F.col("turn") - F.col("band") * F.col("third"), "band")) - 1
    return banded.withColumn("turn", dealt).drop("third", "band")


def drop_repeats(ordered: DataFrame) -> DataFrame:
    """The first chunk of each normal form."""
    first = Window.partitionBy("group_id", normalized("text")).orderBy("turn")
    return ordered.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def fill(ordered: DataFrame, max_tokens: int = 1024, separator: str = SEPARATOR, count_tokens=None) -> DataFrame:
    """(group_id, turn, text, cost): the longest prefix that fits; a chunk after the first also pays for the separator.

    Without ``count_tokens`` (a function of a text column) words are counted and the first chunk that does
    not fit is cut to what is left. Costs are 1 or more, so the running sum rises and the prefix is a filter.
    """
    count = count_tokens or _words
    group = Window.partitionBy("group_id").orderBy("turn")
    costed = ordered.withColumn("n", F.row_number().over(group)).withColumn("cost", F.when(F.col("n") == 1, count(F.col("text"))).otherwise(count(F.concat(F.col("text"), F.lit(separator)))))
    summed = costed.withColumn("total", F.sum("cost").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("total") <= max_tokens
    if count_tokens is not None:
        return summed.where(fits).select("group_id", "turn", "text", "cost")
    first_out = F.min(F.when(~fits, F.col("n"))).over(Window.partitionBy("group_id"))
    # the last one in pays no separator of its own beyond its cost; the cut one pays it out of what is left
    left = F.lit(max_tokens) - (F.col("total") - F.col("cost")) - F.when(F.col("n") == 1, 0).otherwise(count(F.lit(separator)))
    cut = F.array_join(F.slice(split_words("text"), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), " ")
    marked = summed.withColumn("first_out", first_out).where(fits | (F.col("n") == F.col("first_out")))
    taken = marked.withColumn("text", F.when(fits, F.col("text")).otherwise(cut)).where(fits | ((left > 0) & (word_count(F.col("text")) > 0)))
    return taken.select("group_id", "turn", "text", "cost")


def pack(chunks: DataFrame, max_tokens: int = 1024, strategy: str = "priority", dedup: bool = True, separator: str = SEPARATOR, count_tokens=None) -> DataFrame:
    """(group_id, context): the packed chunks joined by the separator."""
    ordered = order_chunks(chunks, strategy)
    taken = fill(drop_repeats(ordered) if dedup else ordered, max_tokens, separator, count_tokens)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), separator)
    return taken.groupBy("group_id").agg(joined.alias("context"))
