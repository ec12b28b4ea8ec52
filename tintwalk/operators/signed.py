"""Relations with a sign, over names, perhaps the state, and the colour.

A negation is carried as a sign and never built: where it meets a relation that has its columns it becomes an anti join, two of them meet in one join, and a quantifier counts instead of
building what fails. What doesn't depend on the state has no ``state`` column, and meets the states only where it is joined with what does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOUR, STATE = "colour", "state"


@dataclass(frozen=True)
class Relation:
    """``rows(names..., state if it matters, colour)``, a set; if ``negated``, all else over the same columns."""

    rows: DataFrame
    negated: bool = False

    @property
    def columns(self) -> set[str]:
        """All but the colour."""
        return set(self.rows.columns) - {COLOUR}

    def __invert__(self) -> Relation:
        return Relation(self.rows, not self.negated)


def ordered(rows: DataFrame, columns: set[str]) -> DataFrame:
    """Names in order, then state, then colour."""
    return rows.select(*sorted(columns - {STATE}), *[c for c in (STATE,) if c in columns], COLOUR)


def _joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def both(a: Relation, b: Relation) -> Relation | None:
    """Conjunction, or None if it can't be had without states for columns that one side lacks."""
    if a.negated and not b.negated:
        a, b = b, a
    if b.negated and not a.negated:
        return Relation(_joined(a.rows, b.rows, "left_anti")) if b.columns <= a.columns else None
    if a.negated:
        return ~union(a.rows, b.rows) if a.columns == b.columns else None
    if b.columns <= a.columns:
        return Relation(_joined(a.rows, b.rows, "left_semi"))
    if a.columns <= b.columns:
        return Relation(_joined(b.rows, a.rows, "left_semi"))
    return Relation(ordered(_joined(a.rows, b.rows), a.columns | b.columns))


def union(a: DataFrame, b: DataFrame) -> Relation:
    return Relation(a.unionByName(b).distinct())


def either(a: Relation, b: Relation) -> Relation | None:
    """Disjunction, or None as in :func:`both`: two negations join, a negation loses what the other side has."""
    met = both(~a, ~b)
    return ~met if met else None


def same(a: Relation, b: Relation) -> Relation | None:
    """Equivalence, or None if the columns differ: all but the rows that one side has and the other lacks, which are told in one pass over both."""
    if a.columns != b.columns:
        return None
    columns = a.rows.columns
    rows = a.rows.unionByName(b.rows).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*columns)
    return Relation(rows, a.negated == b.negated)


def bound(rel: Relation, column: str) -> Relation:
    """Where the named state is the one at hand."""
    if column not in rel.columns:
        return rel
    if STATE in rel.columns:
        return Relation(rel.rows.where(F.col(column) == F.col(STATE)).drop(column), rel.negated)
    rows = rel.rows.withColumnRenamed(column, STATE)
    return Relation(ordered(rows, rel.columns - {column} | {STATE}), rel.negated)


def at(rel: Relation, where: str | int) -> Relation:
    """What holds at one state, wherever one is: the state goes, a name stands for it."""
    if STATE not in rel.columns:
        return rel
    if isinstance(where, int):
        rows, columns = rel.rows.where(F.col(STATE) == where).drop(STATE), rel.columns - {STATE}
    elif where in rel.columns:
        rows, columns = rel.rows.where(F.col(STATE) == F.col(where)).drop(STATE), rel.columns - {STATE}
    else:
        rows, columns = rel.rows.withColumnRenamed(STATE, where), rel.columns - {STATE} | {where}
    return Relation(ordered(rows, columns), rel.negated)


def some(rel: DataFrame, column: str, limits: DataFrame | None) -> Relation:
    """Some state under ``column`` that ``limits(column, names..., colour)`` allows (None: any) puts a row into ``rel``."""
    if limits is not None:
        rel = _joined(rel, limits if column in rel.columns else limits.drop(column).distinct())
    columns = set(rel.columns) - {COLOUR, column}
    return Relation(ordered(rel, columns).distinct())


def every(rel: DataFrame, column: str, limits: DataFrame) -> DataFrame:
    """Rows of which every state that ``limits(column, colour)`` allows is in ``rel``, by counting them; colours that allow none have no rows."""
    need = limits.groupBy(COLOUR).agg(F.count(F.lit(1)).alias("need"))
    columns = set(rel.columns) - {COLOUR, column}
    got = _joined(rel, limits, "left_semi").groupBy(*sorted(columns), COLOUR).agg(F.count(F.lit(1)).alias("got"))
    return ordered(got.join(need, COLOUR).where("got = need"), columns)
