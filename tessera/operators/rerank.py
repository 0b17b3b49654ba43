"""Reordering of each query's candidates (query_id, cand_id, pos, score, text, vec) by dense, lexical or both ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_added_eps, doubles

from .lexical import search_groups


def _ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def with_cosine(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", doubles("qvec").alias("qvec"))
    return candidates.join(q, "query_id").withColumn("cosine", cosine_added_eps(doubles("vec"), F.col("qvec")))


def rerank_dense(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, cand_id, score): by cosine, which is the new score."""
    ranked = _ranked(with_cosine(candidates, queries), F.round("cosine", 9).desc(), "pos")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "cand_id", F.col("cosine").alias("score"))


def with_lexical_rank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``candidates`` with lex_rank (from 0), null where no query term occurs."""
    hits = search_groups(candidates, queries).join(candidates.select("query_id", "cand_id", F.col("pos").alias("at")), ["query_id", "cand_id"])
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "pos", "at")
    ranks = hits.select("query_id", "cand_id", (F.row_number().over(order) - 1).alias("lex_rank"), F.col("score").alias("lex_score"))
    return candidates.join(ranks, ["query_id", "cand_id"], "left")


def rerank_lexical(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, cand_id, score, lex_score): unmatched candidates follow in input order; scores are the original ones."""
    ranked = _ranked(with_lexical_rank(candidates, queries), F.col("lex_rank").asc_nulls_last(), "pos")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "cand_id", "score", "lex_score")


def rerank_hybrid(candidates: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """(query_id, rank, cand_id, score, fused): ranks of both kinds, scaled by n - 1; no match counts as last."""
    lexical = with_cosine(with_lexical_rank(candidates, queries), queries)
    whole = Window.partitionBy("query_id")
    ranks = lexical.withColumn("n", F.count("*").over(whole)).withColumn("dense_rank", F.row_number().over(whole.orderBy(F.round("cosine", 9).desc(), "pos")) - 1)
    last = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    fused = -(F.lit(alpha) * F.col("dense_rank") / last + F.lit(1 - alpha) * F.coalesce(F.col("lex_rank"), F.col("n") - 1) / last)
    ranked = _ranked(ranks.withColumn("fused", fused), F.round("fused", 12).desc(), "pos")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "cand_id", "score", "fused")
