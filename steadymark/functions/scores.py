"""Scores of a linear predictor: logits, prediction and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadymark.functions.arrays import dot, let


def linear_logits(vector: Column, weights: Column, bias: Column) -> Column:
    """``bias[k] + weights[k] . vector`` for every class k."""
    return let(vector, lambda x: F.transform(weights, lambda w, k: F.get(bias, k) + dot(x, w)))


def argmax(logits: Column) -> Column:
    """0-based index of the largest logit, the first one on ties."""
    return let(logits, lambda xs: (F.array_position(xs, F.array_max(xs)) - 1).cast("int"))


def softmax_at(logits: Column, target: Column) -> Column:
    """Softmax probability of class ``target`` (0-based)."""

    def probability(xs: Column) -> Column:
        return let(
            F.array_max(xs),
            lambda top: F.exp(F.get(xs, target) - top)
            / F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)),
        )

    return let(logits, probability)
