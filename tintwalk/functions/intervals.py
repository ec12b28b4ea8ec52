"""Sets of real parameters as sorted arrays of disjoint intervals, each with its low end and without its high one.

:class:`Intervals` has the algebra of the encodings of :mod:`tintwalk.functions.colours`, so that the operators of :mod:`tintwalk.operators.sets` take it for ``how``: a system's parameters are
then no list of colours but a stretch of the real line, and an edge is enabled for the parameters of its intervals. Intervals that touch are one; ends are compared as
doubles, and NaN is no end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<low: double, high: double>>"


def _interval(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))


@dataclass(frozen=True)
class Intervals:
    """Sets of the parameters from ``low`` to below ``high``."""

    low: float
    high: float
    #: A union gathers a group's sets before it joins them; see :func:`tintwalk.operators.sets.merged`.
    gathers = True

    def __post_init__(self):
        if not self.low < self.high:
            raise ValueError(f"no parameters from {self.low} to below {self.high}")

    def all(self) -> Column:
        return F.array(_interval(F.lit(self.low), F.lit(self.high)))

    def none(self) -> Column:
        return F.array().cast(TYPE)

    def between(self, low: Column, high: Column) -> Column:
        """The set of the parameters from ``low`` to below ``high``; none if either is null or NaN."""
        known = low.isNotNull() & high.isNotNull() & ~F.isnan(low.cast("double")) & ~F.isnan(high.cast("double"))
        low, high = F.greatest(low.cast("double"), F.lit(float(self.low))), F.least(high.cast("double"), F.lit(float(self.high)))
        return F.when(known & (low < high), F.array(_interval(low, high))).otherwise(self.none())

    def both(self, a: Column, b: Column) -> Column:
        met = lambda x: F.transform(b, lambda y: _interval(F.greatest(x.low, y.low), F.least(x.high, y.high)))
        return F.filter(F.flatten(F.transform(a, met)), lambda x: x.low < x.high)

    def either(self, a: Column, b: Column) -> Column:
        return self._joined(F.concat(a, b))

    def other(self, a: Column) -> Column:
        """What lies between the intervals, before the first and after the last."""
        ends = F.concat(F.array(F.lit(float(self.low))), F.transform(a, lambda x: x.high))
        begins = F.concat(F.transform(a, lambda x: x.low), F.array(F.lit(float(self.high))))
        return F.filter(F.zip_with(ends, begins, _interval), lambda x: x.low < x.high)

    def less(self, a: Column, b: Column) -> Column:
        return self.both(a, self.other(b))

    def is_some(self, a: Column) -> Column:
        return F.size(a) > 0

    def has_more(self, a: Column, b: Column) -> Column:
        return self.is_some(self.less(a, b))

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def union(self, a: Column) -> Column:
        """Aggregate: the union of a group's sets."""
        return self._joined(F.flatten(F.collect_set(a)))

    def _joined(self, intervals: Column) -> Column:
        def add(found: Column, x: Column) -> Column:
            last = F.element_at(found, -1)
            grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(_interval(last.low, F.greatest(last.high, x.high))))
            return F.when(F.size(found) == 0, F.array(x)).when(x.low <= last.high, grown).otherwise(F.concat(found, F.array(x)))

        return F.aggregate(F.sort_array(intervals), self.none(), add)
