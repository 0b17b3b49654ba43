"""Answer-quality measures as expressions over strings and arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, normalized, sentences, tokens


def exact_match(pred: Column, golds: Column) -> Column:
    return bind(normalized(pred), lambda p: F.exists(F.transform(golds, normalized), lambda g: g == p)).cast("int")


def _count(tokens_: Column, t: Column) -> Column:
    return F.size(F.filter(tokens_, lambda x: x == t))


def token_f1(pred_tokens: Column, gold_tokens: Column) -> Column:
    """Multiset F1 of two token arrays; both empty 1, one empty 0. The arrays should be bound: they are used many times."""

    def measure(overlap: Column) -> Column:
        precision, recall = overlap / F.size(pred_tokens), overlap / F.size(gold_tokens)
        return (
            F.when((F.size(pred_tokens) == 0) & (F.size(gold_tokens) == 0), 1.0)
            .when((F.size(pred_tokens) == 0) | (F.size(gold_tokens) == 0), 0.0)
            .when(overlap == 0, 0.0)
            .otherwise(2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-9)))
        )

    common = F.array_intersect(pred_tokens, gold_tokens)
    return bind(F.aggregate(common, F.lit(0), lambda s, t: s + F.least(_count(pred_tokens, t), _count(gold_tokens, t))), measure)


def f1(pred: Column, gold: Column) -> Column:
    return bind(tokens(pred), lambda p: bind(tokens(gold), lambda g: token_f1(p, g)))


def max_f1(pred: Column, golds: Column) -> Column:
    """The best F1 against any of ``golds``; the predicted text is split once."""
    best = lambda p: F.array_max(F.transform(golds, lambda g: bind(tokens(g), lambda t: token_f1(p, t))))
    return F.coalesce(bind(tokens(pred), best), F.lit(0.0))


def jaccard_tokens(a: Column, b: Column) -> Column:
    share = lambda union: F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)
    return bind(F.size(F.array_union(a, b)), share)


def jaccard(a: Column, b: Column) -> Column:
    return bind(tokens(a), lambda x: bind(tokens(b), lambda y: jaccard_tokens(x, y)))


def faithfulness(answer: Column, contexts: Column, threshold: float = 0.5) -> Column:
    """Share of the answer's sentences that resemble some whole context; 1 without sentences."""

    def share(parts: Column, held: Column) -> Column:
        return F.when(F.size(parts) == 0, 1.0).otherwise(F.size(held).cast("double") / F.size(parts))

    def resembling(parts: Column, known: Column) -> Column:
        near = lambda s: bind(tokens(s), lambda t: F.exists(known, lambda c: jaccard_tokens(t, c) >= threshold))
        return share(parts, F.filter(parts, near))

    return bind(sentences(answer), lambda parts: bind(F.transform(contexts, tokens), lambda known: resembling(parts, known)))


def context_matches(selected: Column, gold: Column, threshold: float = 0.5) -> Column:
    """Size of the greedy one-to-one matching: each selected text takes the first free gold text it resembles."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("used"))

    def greedy(golds: Column) -> Column:
        def take(state: Column, text: Column) -> Column:
            resembles = lambda t: F.filter(F.sequence(F.lit(0), F.size(golds) - 1), lambda i: ~F.array_contains(state["used"], i) & (jaccard_tokens(t, F.get(golds, i)) >= threshold))
            keep = lambda first: F.struct(
                (state["n"] + F.when(first.isNull(), 0).otherwise(1)).alias("n"),
                F.when(first.isNull(), state["used"]).otherwise(F.array_append(state["used"], first)).alias("used"),
            )
            return bind(F.get(bind(tokens(text), resembles), F.lit(0)), keep)

        return F.aggregate(selected, start, take)["n"]

    return F.when((F.size(selected) == 0) | (F.size(gold) == 0), 0).otherwise(bind(F.transform(gold, tokens), greedy))


def context_precision(selected: Column, gold: Column, threshold: float = 0.5) -> Column:
    none_selected, none_gold = F.size(selected) == 0, F.size(gold) == 0
    return F.when(none_selected & none_gold, 1.0).when(none_selected | none_gold, 0.0).otherwise(context_matches(selected, gold, threshold).cast("double") / F.greatest(F.size(selected), F.lit(1)))


def context_recall(selected: Column, gold: Column, threshold: float = 0.5) -> Column:
    none_selected, none_gold = F.size(selected) == 0, F.size(gold) == 0
    return F.when(none_gold, 1.0).when(none_selected, 0.0).otherwise(context_matches(selected, gold, threshold).cast("double") / F.greatest(F.size(gold), F.lit(1)))
