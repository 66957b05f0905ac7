"""Deletion and insertion curves of a linear predictor.

A linear predictor's logits change by one dot product per patch, so a curve is a running sum over the
patches in order of importance instead of one full rescoring per mask. Opaque predictors rescore their
masks in :mod:`steadymark.operators.scoring`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadymark.functions.arrays import let, total
from steadymark.functions.explanation import EPSILON
from steadymark.functions.scores import linear_logits, softmax_at


@dataclass(frozen=True)
class PatchGrid:
    """Square patches over a row-major ``height x width x channels`` image."""

    width: int
    patch: int = 1
    channels: int = 1

    @property
    def per_row(self) -> int:
        return self.width // self.patch

    def corner(self, index: Column) -> tuple[Column, Column]:
        """Top row and left column of patch ``index``."""
        row = F.floor(index / self.per_row).cast("int") * self.patch
        return row, (index % self.per_row) * self.patch

    def pixels(self, index: Column) -> Column:
        """Positions of the values of patch ``index`` in the flat image."""
        row, col = self.corner(index)
        first = (row * self.width + col) * self.channels
        inside = [
            (r * self.width + c) * self.channels + ch
            for r in range(self.patch)
            for c in range(self.patch)
            for ch in range(self.channels)
        ]
        return F.array(*[first + offset for offset in inside])


def patch_order(heatmap: Column) -> Column:
    """Patch indices by falling importance, the lower index first on ties."""
    keyed = F.transform(heatmap, lambda h, i: F.struct((-h).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda entry: entry["i"])


def channel_means(vector: Column, channels: int) -> Column:
    def one(xs: Column, channel: int) -> Column:
        own = F.filter(xs, lambda _, i: i % channels == channel)
        return F.try_divide(total(own), F.size(xs) / channels)

    return let(vector, lambda xs: F.array(*[one(xs, channel) for channel in range(channels)]))


def trapezoid(scores: Column) -> Column:
    """Area under evenly spaced scores on [0, 1]."""
    return let(
        scores,
        lambda s: F.try_divide(total(s) - (F.get(s, F.lit(0)) + F.element_at(s, -1)) / 2.0, F.size(s) - 1),
    )


def _curve(
    order: Column,
    start: Column,
    change: Column,
    weights: Column,
    target: Column,
    steps: int,
    grid: PatchGrid | None,
) -> Column:
    """Confidence in ``target`` at the start and after each step; ``change`` is the vector added by a full run."""

    def advance(acc: Column, at: Column, patches: Column, size: Column) -> Column:
        chosen = F.slice(patches, at + 1, size)
        touched = chosen if grid is None else F.flatten(F.transform(chosen, grid.pixels))

        def shifted(pixels: Column) -> Column:
            return F.transform(
                acc["logits"],
                lambda logit, k: let(
                    F.get(weights, k),
                    lambda w: F.aggregate(pixels, logit, lambda sum_, p: sum_ + F.get(change, p) * F.get(w, p)),
                ),
            )

        return let(
            let(touched, shifted),
            lambda logits: F.struct(
                logits.alias("logits"),
                F.array_append(acc["scores"], softmax_at(logits, target)).alias("scores"),
            ),
        )

    def run(patches: Column, logits: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(F.size(patches) / steps).cast("int"))
        first = F.struct(logits.alias("logits"), F.array(softmax_at(logits, target)).alias("scores"))
        return let(
            size,
            lambda n: F.aggregate(
                F.sequence(F.lit(0), F.size(patches) - 1, n),
                first,
                lambda acc, at: advance(acc, at, patches, n),
                lambda acc: acc["scores"],
            ),
        )

    return let(order, lambda patches: let(start, lambda logits: run(patches, logits)))


def deletion_curve(
    vector: Column,
    heatmap: Column,
    weights: Column,
    bias: Column,
    target: Column,
    steps: int = 10,
    grid: PatchGrid | None = None,
) -> Column:
    """Confidence while the most important patches are replaced by the image mean per channel."""
    channels = 1 if grid is None else grid.channels

    def curve(x: Column) -> Column:
        change = let(
            channel_means(x, channels), lambda fill: F.transform(x, lambda v, i: F.get(fill, i % channels) - v)
        )
        start = linear_logits(x, weights, bias)
        return let(change, lambda delta: _curve(patch_order(heatmap), start, delta, weights, target, steps, grid))

    return let(vector, curve)


def insertion_curve(
    vector: Column,
    heatmap: Column,
    weights: Column,
    bias: Column,
    target: Column,
    steps: int = 10,
    grid: PatchGrid | None = None,
) -> Column:
    """Confidence while the most important patches are revealed on an all-zero image."""
    return let(vector, lambda x: _curve(patch_order(heatmap), bias, x, weights, target, steps, grid))


def deletion_score(*args, **kwargs) -> Column:
    """Area under the deletion curve relative to the confidence in the untouched image."""
    return let(
        deletion_curve(*args, **kwargs),
        lambda s: trapezoid(s) / F.greatest(F.get(s, F.lit(0)), F.lit(EPSILON)),
    )


def insertion_score(*args, **kwargs) -> Column:
    """Area under the insertion curve."""
    return trapezoid(insertion_curve(*args, **kwargs))
