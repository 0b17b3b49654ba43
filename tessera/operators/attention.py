"""Scaled dot-product attention over rows (b, h, t, q, k, v), as a join and two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles


def weights(rows: DataFrame, mask: str | None = "causal", past: int = 0) -> DataFrame:
    """(b, h, tq, tk, w): softmax over the keys that ``mask`` allows.

    "causal" lets a query at t see keys up to t. With a cache of ``past`` keys before the queries,
    "cached" counts keys from the cache's start, so the queries see only the first of them; "shifted"
    counts from its end, which is causal. None masks nothing.
    """
    q = rows.select("b", "h", F.col("t").alias("tq"), doubles("q").alias("q")).where(F.col("tq") >= past)
    k = rows.select("b", "h", F.col("t").alias("tk"), doubles("k").alias("k"))
    pairs = q.join(k, ["b", "h"])
    if mask in ("causal", "shifted"):
        pairs = pairs.where("tk <= tq")
    elif mask == "cached":
        pairs = pairs.where(F.col("tk") <= F.col("tq") - past)
    scored = pairs.withColumn("s", dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q")))
    group = Window.partitionBy("b", "h", "tq")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(group)))
    return e.select("b", "h", "tq", "tk", (F.col("e") / F.sum("e").over(group)).alias("w"))


def attend(rows: DataFrame, mask: str | None = "causal", past: int = 0) -> DataFrame:
    """(b, h, t, d, value): the output, one row per component."""
    v = rows.select("b", "h", F.col("t").alias("tk"), F.posexplode(doubles("v")).alias("d", "x"))
    out = weights(rows, mask, past).join(v, ["b", "h", "tk"]).groupBy("b", "h", F.col("tq").alias("t"), "d")
    return out.agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def project(x: DataFrame, matrix: DataFrame) -> DataFrame:
    """(b, t, o, value) = x (b, t, i, value) times the transpose of matrix (o, i, w); no bias."""
    return x.join(matrix, "i").groupBy("b", "t", "o").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def heads(x: DataFrame, n_heads: int, d_model: int) -> DataFrame:
    """(b, h, t, vec) from (b, t, o, value)."""
    if d_model % n_heads:
        raise ValueError("d_model must be divisible by n_heads")
    size = d_model // n_heads
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda p: p["value"])
    return x.groupBy("b", F.floor(F.col("o") / size).cast("int").alias("h"), "t").agg(ordered.alias("vec"))


def multi_head(x: DataFrame, wq: DataFrame, wk: DataFrame, wv: DataFrame, wo: DataFrame, n_heads: int, d_model: int, mask: str | None = "causal") -> DataFrame:
    """(b, t, o, value): multi-head attention of x (b, t, i, value) with weight tables (o, i, w)."""
    parts = [heads(project(x, m), n_heads, d_model).withColumnRenamed("vec", n) for m, n in ((wq, "q"), (wk, "k"), (wv, "v"))]
    rows = parts[0].join(parts[1], ["b", "h", "t"]).join(parts[2], ["b", "h", "t"])
    joined = attend(rows, mask).select("b", "t", (F.col("h") * (d_model // n_heads) + F.col("d")).alias("i"), "value")
    return project(joined, wo)


