"""Judging answers by embeddings or by a scoring callback, with mean or median over repeats."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles

RUBRIC = "Return a score [0,1]."  # fixed value


def heuristic_score(question: Column, answer: Column, references: Column) -> Column:
    """From vectors: the best (similarity + 1) / 2 with a reference; without any, with the question, kept in [0, 1]."""
    half = lambda a, b: (dot(a, b) + 1.0) / 2.0
    alone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), half(question, answer)))
    return F.when(F.size(references) > 0, F.array_max(F.transform(references, lambda r: half(r, answer)))).otherwise(alone)


def aggregated(scores: Column, how: str) -> Column:
    """Mean or median of an array of scores, 0 if there are none."""
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregation {how}")
    n = F.size(scores)
    if how == "mean":
        value = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    else:
        ordered = F.array_sort(scores)
        value = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n == 0, 0.0).otherwise(value)


def judge(samples: DataFrame, n: int = 3, how: str = "mean") -> DataFrame:
    """``samples`` (sample_id, qvec, avec, rvecs) with scores and score; the heuristic is deterministic, so repeats agree."""
    one = heuristic_score(doubles("qvec"), doubles("avec"), F.col("rvecs").cast("array<array<double>>"))
    return samples.select("sample_id", F.array_repeat(one, n).alias("scores")).withColumn("score", aggregated(F.col("scores"), how))


def prompt(question: Column, answer: Column, references: Column, rubric: str = RUBRIC) -> Column:
    listed = F.array_join(F.transform(references, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat(F.lit(f"{rubric}\nQuestion:"), question, F.lit("\nAnswer:"), answer, F.lit("\nReferences:\n"), listed, F.lit("\nScore:"))


def judge_with(samples: DataFrame, score: Callable[[str], float], n: int = 3, how: str = "mean", rubric: str = RUBRIC) -> DataFrame:
    """As ``judge``, asking a callback n times for each (sample_id, question, answer, refs); scores are kept in [0, 1]."""

    @F.pandas_udf("array<double>")
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series([[max(0.0, min(1.0, float(score(p)))) for _ in range(n)] for p in prompts])

    asked = samples.select("sample_id", ask(prompt(F.col("question"), F.col("answer"), F.col("refs"), rubric)).alias("scores"))
    return asked.withColumn("score", aggregated(F.col("scores"), how))
