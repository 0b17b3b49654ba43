"""Choosing a model endpoint for each request under context, tag and budget constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Objective weights of quality, latency and cost by priority, and defaults.
OBJECTIVES = {"quality": (1.0, -0.1, -0.01), "speed": (0.5, -1.0, -0.01), "cost": (0.3, -0.1, -1.0), "balance": (0.5, -0.2, -0.3)}
DEFAULT_LATENCY, DEFAULT_QUALITY = 1.0, 0.5
#: An endpoint list is a hand-made catalogue; beyond this many rows it is not broadcast.
BROADCAST_ENDPOINTS = 10_000


def cost(prompt_len: Column, output_len: Column, price_in: Column, price_out: Column) -> Column:
    return prompt_len / F.lit(1000.0) * price_in + output_len / F.lit(1000.0) * price_out


def _objective(priority: Column) -> Column:
    quality, latency = F.coalesce("quality", F.lit(DEFAULT_QUALITY)), F.coalesce("latency", F.lit(DEFAULT_LATENCY))
    out = F.lit(None).cast("double")
    for name, (q, t, c) in OBJECTIVES.items():
        out = F.when(priority == name, F.lit(q) * quality + F.lit(t) * latency + F.lit(c) * F.col("est_cost")).otherwise(out)
    return out


def route(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(request_id, endpoint, est_cost, reason, status) for each request.

    ``requests``: request_id, prompt_len, max_output_tokens, budget_usd (nullable), priority, required_tags.
    ``endpoints``: ordinal, name, price_in, price_out, latency, quality, max_tokens, tags. The first of equal
    endpoints wins. Status is "ok", or says that no endpoint fits the constraints or the budget.
    """
    few = endpoints.limit(BROADCAST_ENDPOINTS + 1).count() <= BROADCAST_ENDPOINTS
    tags, wanted = F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("required_tags", F.array().cast("array<string>"))
    pairs = requests.crossJoin(F.broadcast(endpoints) if few else endpoints)
    fits = pairs.where((F.col("max_tokens") >= F.col("prompt_len") + F.col("max_output_tokens")) & (F.size(F.array_except(wanted, tags)) == 0))
    priced = fits.withColumn("est_cost", cost(F.col("prompt_len"), F.col("max_output_tokens"), F.col("price_in"), F.col("price_out")))
    payable = F.coalesce(F.col("est_cost") <= F.col("budget_usd"), F.lit(True))
    scored = priced.withColumn("value", F.when(payable, F.round(_objective(F.col("priority")), 12)))
    best = scored.groupBy("request_id").agg(
        F.max(F.when(F.col("value").isNotNull(), F.struct("value", (-F.col("ordinal")).alias("first"), F.col("name").alias("endpoint"), "est_cost"))).alias("best")
    )
    status = F.when(F.col("best").isNotNull(), "ok").when(F.col("seen").isNull(), "no endpoint satisfies the constraints").otherwise("no endpoint satisfies the budget")
    return requests.select("request_id", "priority").join(best.withColumn("seen", F.lit(True)), "request_id", "left").select(
        "request_id", F.col("best.endpoint").alias("endpoint"), F.col("best.est_cost").alias("est_cost"), F.col("priority").alias("reason"), status.alias("status")
    )
