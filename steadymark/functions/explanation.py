"""Metrics of an attention heatmap: normalisation, entropy, Gini sparsity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadymark.functions.arrays import let, total

# Fixed value: guards the logarithm and the normalising division.
EPSILON = 1e-10


def normalise(values: Column) -> Column:
    """Scale to a unit sum."""
    return let(values, lambda xs: let(total(xs) + EPSILON, lambda s: F.transform(xs, lambda v: v / s)))


def attention_heatmap(cls_rows: Column) -> Column:
    """Heatmap from one class-token attention row per head (``heads x (1 + patches)``).

    Averages the heads, drops the class token's attention to itself and normalises.
    """

    def averaged(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        summed = F.aggregate(
            rows,
            F.array_repeat(F.lit(0.0), width),
            lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b),
        )
        return F.transform(summed, lambda v: v / F.size(rows))

    return normalise(let(let(cls_rows, averaged), lambda row: F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))))


def attention_entropy(heatmap: Column) -> Column:
    """Shannon entropy in units of its maximum: about 1 when uniform, near 0 when one patch dominates."""

    def entropy(h: Column) -> Column:
        bits = F.aggregate(h, F.lit(0.0), lambda acc, v: acc + (v + EPSILON) * F.log2(v + EPSILON))
        return F.try_divide(-bits, F.log2(F.size(h).cast("double")))

    return let(heatmap, entropy)


def gini_sparsity(heatmap: Column) -> Column:
    """Gini coefficient: 0 when uniform, ``1 - 1/N`` when one patch holds everything."""

    def gini(ordered: Column) -> Column:
        n = F.size(ordered)
        weighted = total(F.transform(ordered, lambda v, i: (n - i - 0.5) * v))
        return 1.0 - F.try_divide(2.0 * weighted, n)

    return let(F.array_sort(normalise(heatmap)), gini)
