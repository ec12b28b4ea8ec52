"""Sets of colours as columns: a mask of up to 63 bits, an array of longs with 64 bits each, or a sorted array of colours.

A mask holds colours 0 to 62 in a long and is the smallest for few colours; ``Bits`` holds any number in a fixed number of longs, for many colours of which sets
hold many; a sorted array is for sets of few. Every encoding has the same algebra, built from Spark's own functions; ``encoded`` and ``decoded`` convert from
and to one row for each colour.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_COLOURS = 63


@dataclass(frozen=True)
class Masks:
    """Sets of the colours 0 to ``n - 1`` as bits of a long."""

    n: int

    def __post_init__(self):
        if not 0 <= self.n <= MASK_COLOURS:
            raise ValueError(f"a mask holds {MASK_COLOURS} colours; use Arrays for {self.n}")

    def all(self) -> Column:
        return F.lit((1 << self.n) - 1).cast("long")

    def none(self) -> Column:
        return F.lit(0).cast("long")

    def both(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b)

    def either(self, a: Column, b: Column) -> Column:
        return a.bitwiseOR(b)

    def other(self, a: Column) -> Column:
        return self.all().bitwiseAND(F.bitwise_not(a))

    def less(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.bitwise_not(b))

    def is_some(self, a: Column) -> Column:
        return a != 0

    def has_more(self, a: Column, b: Column) -> Column:
        """Some colour of ``a`` isn't in ``b``."""
        return self.less(a, b) != 0

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def gathered(self, colour: Column) -> Column:
        """Aggregate: the set of all colours of a group."""
        return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), colour))

    def union(self, a: Column) -> Column:
        """Aggregate: the union of a group's sets."""
        return F.bit_or(a)

    def colours(self, a: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(max(self.n - 1, 0))), lambda c: F.getbit(a, c) == 1)


@dataclass(frozen=True)
class Arrays:
    """Sets as sorted arrays; ``every`` is the sorted list of all colours."""

    every: tuple[int, ...]
    #: A union gathers a group's sets before it joins them; see :func:`tintwalk.operators.sets.merged`.
    gathers = True

    def all(self) -> Column:
        return F.array(*[F.lit(c) for c in self.every]).cast("array<int>")

    def none(self) -> Column:
        return F.array().cast("array<int>")

    def both(self, a: Column, b: Column) -> Column:
        return F.sort_array(F.array_intersect(a, b))

    def either(self, a: Column, b: Column) -> Column:
        return F.sort_array(F.array_union(a, b))

    def other(self, a: Column) -> Column:
        return F.array_except(self.all(), a)

    def less(self, a: Column, b: Column) -> Column:
        return F.array_except(a, b)

    def is_some(self, a: Column) -> Column:
        return F.size(a) > 0

    def has_more(self, a: Column, b: Column) -> Column:
        return self.is_some(self.less(a, b))

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def gathered(self, colour: Column) -> Column:
        return F.sort_array(F.collect_set(colour))

    def union(self, a: Column) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.collect_set(a))))

    def colours(self, a: Column) -> Column:
        return a


@dataclass(frozen=True)
class Bits:
    """Sets of the colours 0 to ``n - 1`` as bits of as many longs as it takes, of 64 each."""

    n: int

    @property
    def words(self) -> int:
        return max(-(-self.n // 64), 1)

    def _each(self, word: Callable[[int], int]) -> Column:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return F.array(*[F.lit(signed(word(i))).cast("long") for i in range(self.words)])

    def all(self) -> Column:
        return self._each(lambda i: (1 << min(max(self.n - 64 * i, 0), 64)) - 1)

    def none(self) -> Column:
        return self._each(lambda i: 0)

    def both(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))

    def either(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))

    def other(self, a: Column) -> Column:
        return self.less(self.all(), a)

    def less(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def is_some(self, a: Column) -> Column:
        return F.exists(a, lambda x: x != 0)

    def has_more(self, a: Column, b: Column) -> Column:
        return self.is_some(self.less(a, b))

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def gathered(self, colour: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(colour, F.lit(64)).cast("int"))
        return F.array(*[F.coalesce(F.bit_or(F.when(F.floor(colour / 64) == i, bit)), F.lit(0).cast("long")) for i in range(self.words)])

    def union(self, a: Column) -> Column:
        return F.array(*[F.bit_or(F.get(a, F.lit(i))) for i in range(self.words)])

    def colours(self, a: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(max(self.n - 1, 0))), lambda c: F.getbit(F.get(a, F.floor(c / 64).cast("int")), F.pmod(c, F.lit(64)).cast("int")) == 1)


Encoding = Masks | Bits | Arrays


def encoding(n: int) -> Encoding:
    """The one for colours 0 to ``n - 1``."""
    return Masks(n) if n <= MASK_COLOURS else Bits(n)


def encoded(rel: DataFrame, how: Encoding, name: str = "colours") -> DataFrame:
    """A row for each state (and open names) with its set, from one row per colour."""
    return rel.groupBy(*[c for c in rel.columns if c != "colour"]).agg(how.gathered(F.col("colour")).alias(name))


def decoded(sets: DataFrame, how: Encoding, name: str = "colours") -> DataFrame:
    return sets.withColumn("colour", F.explode(how.colours(F.col(name)).cast("array<int>"))).drop(name)
