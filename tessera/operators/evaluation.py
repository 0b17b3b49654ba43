"""Question-answering evaluation: one projection per measure, one aggregate for the means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics


def evaluate(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``samples`` (sample_id, pred, answers, contexts, gold_citations nullable) with the measures.

    Context measures are null where there are no gold citations to compare with.
    """
    pred = F.coalesce(F.col("pred"), F.lit(" "))
    answers = F.coalesce(F.col("answers"), F.array().cast("array<string>"))
    contexts = F.coalesce(F.col("contexts"), F.array().cast("array<string>"))
    gold = F.col("gold_citations")
    return samples.select(
        "sample_id",
        metrics.exact_match(pred, answers).alias("em"),
        metrics.max_f1(pred, answers).alias("f1"),
        metrics.faithfulness(pred, contexts, threshold).alias("faithfulness"),
        F.when(gold.isNotNull(), metrics.context_precision(contexts, gold, threshold)).alias("context_precision"),
        F.when(gold.isNotNull(), metrics.context_recall(contexts, gold, threshold)).alias("context_recall"),
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """Means over samples; context measures over those that have them; 0 without samples."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return evaluated.agg(mean("em"), mean("f1"), mean("faithfulness"), F.avg("context_precision").alias("context_precision"), F.avg("context_recall").alias("context_recall"))
