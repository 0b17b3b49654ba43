"""Retrieval methods over a vector store and a lexical index: top-k, maximal marginal relevance, rank fusion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles

from . import dense, lexical

#: Rank constant of reciprocal rank fusion. Fixed value.
FUSION_RANK = 60


def pool_size(k: int) -> int:
    return max(10, 5 * k)


def mmr(vectors: DataFrame, queries: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """(query_id, rank, id, score): greedy relevance less similarity to what is chosen, over a dense pool.

    The pool is found with the normalised query; relevance and the returned score use the query as given.
    Only pools, of max(10, 5k) rows a query, reach the Python function.
    """
    pool = dense.search(vectors, queries, pool_size(k)).withColumnRenamed("rank", "pool_rank").drop("score")
    loaded = pool.join(vectors.select("id", "vec"), "id").join(queries.select("query_id", doubles("qvec").alias("qvec")), "query_id")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pool_rank")
        v, q = np.stack(group["vec"]).astype(float), np.asarray(group["qvec"].iloc[0], float)
        relevance, likeness = v @ q, v @ v.T
        chosen: list[int] = []
        nearest = np.zeros(len(v))
        left = np.ones(len(v), bool)
        while len(chosen) < min(k, len(v)):
            gain = np.where(left, np.round(weight * relevance - (1 - weight) * nearest, 12), -np.inf)
            best = int(gain.argmax())  # the first of equals is the one with the better pool rank
            nearest = likeness[best] if not chosen else np.maximum(nearest, likeness[best])
            chosen.append(best)
            left[best] = False
        return pd.DataFrame({"query_id": group["query_id"].iloc[:1].repeat(len(chosen)).to_numpy(), "rank": range(1, len(chosen) + 1), "id": group["id"].to_numpy()[chosen], "score": relevance[chosen]})

    kind = dict(queries.dtypes)["query_id"]
    return loaded.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, rank int, id string, score double")


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """(query_id, id, rrf_score, rank) from ranked lists (query_id, id, rank), of which the first k ranks count."""
    parts = [x.where(F.col("rank") <= k).select("query_id", "id", (F.lit(1.0) / (F.lit(FUSION_RANK) + F.col("rank"))).alias("part")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    fused = both.groupBy("query_id", "id").agg(F.sum("part").alias("rrf_score"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score, rrf_score) for queries (query_id, qvec, text); documents and vectors share ids.

    The order is that of the fusion, the score the dense product with the query as given.
    """
    ranked = dense.search(vectors, queries, k)
    words = lexical.search(docs, queries, k).select("query_id", "rank", F.col("doc_id").cast("string").alias("id"))
    fused = fuse([ranked, words], k)
    loaded = fused.join(vectors.select("id", "vec"), "id").join(queries.select("query_id", doubles("qvec").alias("qvec")), "query_id")
    return loaded.select("query_id", "rank", "id", dot(F.col("vec"), F.col("qvec")).alias("score"), "rrf_score")


@dataclass(frozen=True)
class Retriever:
    """A configuration: attach what the method needs, then search (query_id, text)."""

    method: str = "topk"
    k: int = 5
    mmr_weight: float = 0.5
    vectors: DataFrame | None = None
    docs: DataFrame | None = None
    embed: Callable[[str], np.ndarray] | None = None

    def __post_init__(self):
        if self.method not in ("topk", "mmr", "rrf"):
            raise ValueError(f"unknown method {self.method}")

    def attach_vectors(self, vectors: DataFrame, embed: Callable[[str], np.ndarray]) -> Retriever:
        return replace(self, vectors=vectors, embed=embed)

    def attach_docs(self, docs: DataFrame) -> Retriever:
        return replace(self, docs=docs)

    def search(self, queries: DataFrame) -> DataFrame:
        if self.vectors is None or (self.method == "rrf" and self.docs is None):
            raise ValueError("attach what the method searches first")
        embedded = dense.embed_texts(queries, self.embed).withColumnRenamed("vec", "qvec")
        if self.method == "topk":
            return dense.search(self.vectors, embedded, self.k)
        if self.method == "mmr":
            return mmr(self.vectors, embedded, self.k, self.mmr_weight)
        return rrf(self.vectors, self.docs, embedded, self.k)
