"""Exact quantiles without a shuffle of all values.

A mergeable sketch tells between which two values a quantile lies; one more pass counts the rows below and keeps the
values between. A bracket with too many rows gets a sketch of its own, so each pass over the rows leaves a small share of
them, and only the values of the last, small brackets are grouped and ordered. The counts are exact, so a sketch that was
wrong is noticed and its bracket widened: it decides how much is read, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy parameter of the sketches, and the rank error (a share of the rows) to each side that a bracket allows for.
SKETCH, MARGIN = 400, 0.012
#: The widest margin: far beyond the error of a sketch, and still leaving out half of the rows.
WIDEST = 0.25
#: Rows of a bracket whose values are grouped.
SMALL = 1 << 17


@dataclass
class _Bracket:
    """Where the value of rank ``target`` lies: from ``low`` to ``high`` (None: no bound), after ``below`` rows, among ``inside``."""

    column: str
    place: int
    target: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    margin: float = field(default_factory=lambda: MARGIN)
    wider: list[tuple] = field(default_factory=list)

    def holds(self) -> Column:
        value = F.col(self.column)
        bounds = [value.isNotNull()]
        if self.low is not None:
            bounds.append(value >= self.low)
        if self.high is not None:
            bounds.append(value <= self.high)
        whole = bounds[0]
        for bound in bounds[1:]:
            whole = whole & bound
        return whole

    def counts(self) -> list[Column]:
        """Rows below the bracket, inside it, and at its bounds."""
        value = F.col(self.column)
        none = F.lit(0).cast("bigint")
        below = none if self.low is None else F.count_if(value < self.low)
        return [below, F.count_if(self.holds()), none if self.low is None else F.count_if(value == self.low), none if self.high is None else F.count_if(value == self.high)]

    def ranks(self) -> tuple[float, float]:
        """The shares of the rows inside between which the target is looked for."""
        rank = (self.target - self.below) / self.inside
        return rank - self.margin, rank + self.margin

    def narrow(self, low: float | None, high: float | None) -> None:
        """Take new bounds where there are any."""
        self.wider.append((self.low, self.high, self.below, self.inside))
        self.low = self.low if low is None else low
        self.high = self.high if high is None else high

    def settle(self, below: int, inside: int, at_low: int, at_high: int) -> float | None:
        """Judge the bounds by the counts: the value if it is one of them; else they are left out, or go back if the target is elsewhere."""
        if not below < self.target <= below + inside:
            self.low, self.high, self.below, self.inside = self.wider.pop()
            self.margin = min(4 * self.margin, WIDEST)
            return None
        if self.target <= below + at_low:
            return self.low
        if self.target > below + inside - at_high:
            return self.high
        # A value that holds many rows would otherwise stay at the bound of every later bracket.
        self.below, self.inside = below + at_low, inside - at_low - at_high
        self.low = None if self.low is None else math.nextafter(self.low, math.inf)
        self.high = None if self.high is None else math.nextafter(self.high, -math.inf)
        return None


def _sketch(values: Column) -> Column:
    return F.kll_sketch_agg_double(values, F.lit(SKETCH))


def _narrowed(df: DataFrame, brackets: Sequence[_Bracket], sketches: Sequence[bytes] | None = None) -> None:
    """One pass with a sketch of each bracket, if there are none yet, and one small job that reads the new bounds from them."""
    sketches = sketches or df.agg(*[_sketch(F.when(b.holds(), F.col(b.column))) for b in brackets]).first()
    asked = [(i, r) for i, b in enumerate(brackets) for r in b.ranks() if 0 < r < 1]
    read = [F.kll_sketch_get_quantile_double(F.lit(bytearray(sketches[i])), F.lit(r)) for i, r in asked]
    known = dict(zip(asked, df.sparkSession.range(1).select(*read).first())) if read else {}
    for i, b in enumerate(brackets):
        b.narrow(*(known.get((i, r)) for r in b.ranks()))


def sketched_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], small: int = SMALL) -> DataFrame:
    """``feature`` and ``q_0``, ``q_1``, ...: for each p the smallest value whose share of rows at or below it reaches p.

    NULLs are left out and NaN is the greatest value; a column without values has NULLs. ``df`` is read once for totals and
    sketches, once or twice more for each factor of about 40 by which a column has more than ``small`` rows, and once for the
    values of the last brackets. It should be cheap to read again. A few numbers a quantile and the sketches reach the driver.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    known = doubles.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    totals = doubles.agg(
        *[F.count(c) for c in columns], *[F.count_if(F.isnan(c)) for c in columns], *[_sketch(F.when(~F.isnan(c), F.col(c))) for c in columns]
    ).first()
    whole = dict(zip(columns, totals[2 * len(columns) :]))
    found: dict[tuple[str, int], float] = {}
    open_, ready = [], []
    for c, every, nan in zip(columns, totals, totals[len(columns) : 2 * len(columns)]):
        for i, p in enumerate(probabilities if every else ()):
            target = max(1, math.ceil(every * p))
            if target > every - nan:
                found[c, i] = math.nan
            else:
                open_.append(_Bracket(c, i, target, inside=every - nan))
    while open_:
        ready += [b for b in open_ if b.inside <= small]
        open_ = [b for b in open_ if b.inside > small]
        if not open_:
            break
        _narrowed(known, open_, whole and [whole[b.column] for b in open_])
        whole = {}
        counts = iter(known.agg(*[c for b in open_ for c in b.counts()]).first())
        for b in open_:
            value = b.settle(*(next(counts) for _ in range(4)))
            if value is not None:
                found[b.column, b.place] = value
        open_ = [b for b in open_ if (b.column, b.place) not in found]
    if ready:
        found |= _picked(known, ready)
    rows = [(c, *[found.get((c, i)) for i in range(len(probabilities))]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"q_{i} double" for i in range(len(probabilities))))


def _picked(df: DataFrame, brackets: Sequence[_Bracket]) -> dict[tuple[str, int], float]:
    """The values of small brackets: grouped first, then ordered within each bracket."""
    inside = F.array_compact(F.array(*[
        F.when(b.holds(), F.struct(F.lit(i).alias("bracket"), F.col(b.column).alias("value"))) for i, b in enumerate(brackets)
    ]))
    counts = df.select(F.inline(inside)).groupBy("bracket", "value").count()
    order = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.element_at(F.array(*[F.lit(b.target - b.below) for b in brackets]), F.col("bracket") + 1)
    reached = counts.withColumn("through", F.sum("count").over(order)).where(F.col("through") >= wanted)
    rows = reached.groupBy("bracket").agg(F.min("value").alias("value")).collect()  # one row a bracket
    return {(brackets[r["bracket"]].column, brackets[r["bracket"]].place): r["value"] for r in rows}
