"""Temporal operators over sets of colours: relations ``(names..., state, colours)`` with one row for a state, and edges ``(src, dst, colours)`` with one row for a pair.

Rows meet on names and state alone. What passes an edge is the intersection of both sets, what a state gets is the union of all that passes into it, and a round of a fixpoint
carries what is new for a state and not what it had. So a round shuffles a row for a state where the form with a row for each colour shuffles one for every
colour of the state. ``how`` is an encoding of :mod:`tintwalk.functions.colours`, or :class:`tintwalk.functions.intervals.Intervals`
for sets of real parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwalk.functions.colours import Encoding, encoded
from tintwalk.operators.temporal import FEW
from tintwalk.written import Grown, cut

SET = "colours"
#: Parts of a group's sets that are joined first.
PARTS = 64


def keys(rel: DataFrame) -> list[str]:
    return [c for c in rel.columns if c != SET]


def some(rel: DataFrame, how: Encoding) -> DataFrame:
    """Rows with a colour."""
    return rel.where(how.is_some(F.col(SET)))


def full(states: DataFrame, how: Encoding) -> DataFrame:
    return states.select("state", how.all().alias(SET))


def edges_of(edges: DataFrame, how: Encoding, along: Column | None = None) -> DataFrame:
    """``(src, dst, colours)`` from edges with a row for each colour; with ``along`` also the colours ``going`` in which the edge goes along."""
    if along is None:
        return encoded(edges.select("src", "dst", "colour"), how, SET)
    each = edges.select("src", "dst", "colour", along.alias("goes"))
    going = how.gathered(F.when(F.col("goes"), F.col("colour")))
    return each.groupBy("src", "dst").agg(how.gathered(F.col("colour")).alias(SET), F.coalesce(going, how.none()).alias("going"))


def both(a: DataFrame, b: DataFrame, how: Encoding) -> DataFrame:
    """Conjunction: on the names that both have, and the state."""
    joined = a.join(b.withColumnRenamed(SET, "_more"), [c for c in keys(a) if c in keys(b)])
    return some(joined.withColumn(SET, how.both(F.col(SET), F.col("_more"))).drop("_more"), how)


def either(a: DataFrame, b: DataFrame, how: Encoding) -> DataFrame:
    """Disjunction of relations with the same names."""
    return merged(a.unionByName(b), how)


def merged(rel: DataFrame, how: Encoding) -> DataFrame:
    """One row for a state, with the union of its sets. Where a union gathers them first, they are joined by parts of a group before, so that none is gathered whole."""
    union, on = how.union(F.col(SET)).alias(SET), keys(rel)
    if getattr(how, "gathers", False):
        rel = rel.groupBy(*on, F.pmod(F.hash(SET), F.lit(PARTS)).alias("_part")).agg(union).drop("_part")
    return rel.groupBy(*on).agg(union)


def less(a: DataFrame, b: DataFrame, how: Encoding) -> DataFrame:
    """Colours of ``a`` that ``b`` doesn't have; the names of ``b`` are among those of ``a``."""
    joined = a.join(b.withColumnRenamed(SET, "_less"), keys(b), "left")
    own = F.when(F.col("_less").isNull(), F.col(SET)).otherwise(how.less(F.col(SET), F.col("_less")))
    return some(joined.withColumn(SET, own).drop("_less"), how)


def apart(a: DataFrame, b: DataFrame, how: Encoding) -> DataFrame:
    """Colours that one of two relations with the same names has and the other lacks."""
    joined = a.join(b.withColumnRenamed(SET, "_more"), keys(a), "full_outer")
    one, other = F.coalesce(SET, how.none()), F.coalesce("_more", how.none())
    return some(joined.withColumn(SET, how.either(how.less(one, other), how.less(other, one))).drop("_more"), how)


def step_back(rel: DataFrame, edges: DataFrame, how: Encoding) -> DataFrame:
    """Where an edge leads into ``rel``, in the colours of both; a row for a state."""
    into = edges.select("src", F.col("dst").alias("state"), F.col(SET).alias("_on"))
    back = into.join(rel, "state").withColumn(SET, how.both(F.col(SET), F.col("_on"))).drop("state", "_on")
    return merged(some(back.withColumnRenamed("src", "state").select(*rel.columns), how), how)


def some_next(rel: DataFrame, edges: DataFrame, how: Encoding) -> DataFrame:
    return step_back(rel, edges, how)


def every_next(rel: DataFrame, edges: DataFrame, how: Encoding) -> DataFrame:
    """Some edge, and all of them go along and into ``rel(state, colours)``; edges are ``(src, dst, colours, going)``."""
    return _all_into(edges, rel, how)


def _all_into(edges: DataFrame, rel: DataFrame, how: Encoding) -> DataFrame:
    """``(state, colours)``: in which all enabled edges of a state go along and into ``rel``."""
    into = edges.join(rel.select(F.col("state").alias("dst"), F.col(SET).alias("_in")), "dst", "left")
    good = F.coalesce(how.both(F.col("going"), F.col("_in")), how.none())
    each = into.select(F.col("src").alias("state"), SET, how.less(F.col(SET), good).alias("_bad"))
    bad = merged(some(each.select("state", F.col("_bad").alias(SET)), how), how)
    return less(merged(each.select("state", SET), how), bad, how)


def closure(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], how: Encoding, name: str, log: list | None = None) -> DataFrame:
    """Least relation with ``seed`` (a row for a state) and all that ``step(new, found)`` makes; ``step`` is given what the last round added and all that was found."""
    on = keys(seed)
    found = Grown(seed.sparkSession, seed.schema, name)
    new = found.add(seed)
    while new is not None:
        rows, known = step(new, found.all()), found.all()
        if found.rows > FEW:
            known = known.join(rows, on, "left_semi")
        new = found.add(less(rows, merged(known, how), how))
    if log is not None:
        log += [(found.name, at, n) for at, n in enumerate(found.rounds)]
    return merged(found.all(), how)


def exists_until(path: DataFrame | None, goal: DataFrame, edges: DataFrame, how: Encoding, log: list | None = None) -> DataFrame:
    """Least relation with ``goal`` and, of ``path`` (None: all), what has an edge into it. ``edges(src, dst, colours)`` are those that go along."""
    if path is not None:
        path = cut(path, "path")
    edges = edges.select("src", "dst", SET).repartition("dst").persist()
    try:

        def step(new: DataFrame, found: DataFrame) -> DataFrame:
            back = step_back(new, edges, how)
            return both(back, path, how) if path is not None else back

        return closure(goal, step, how, "exists-until", log)
    finally:
        edges.unpersist()


def every_until(path: DataFrame | None, goal: DataFrame, edges: DataFrame, how: Encoding, log: list | None = None) -> DataFrame:
    """Least relation with ``goal(state, colours)`` and, of ``path`` (None: all), what has an edge and all its enabled ones go along and into it. A
    round judges the states anew that have an edge into what the last one added."""
    if path is not None:
        path = cut(path, "path")
    edges = edges.select("src", "dst", SET, "going").repartition("src").persist()
    try:

        def step(new: DataFrame, found: DataFrame) -> DataFrame:
            touched = edges.join(new.select(F.col("state").alias("dst")), "dst", "left_semi").select("src").distinct()
            good = _all_into(edges.join(touched, "src", "left_semi"), merged(found, how), how)
            return both(good, path, how) if path is not None else good

        return closure(goal, step, how, "every-until", log)
    finally:
        edges.unpersist()


def reach(seed: DataFrame, edges: DataFrame, how: Encoding, forward: bool = True, guard: DataFrame | None = None, log: list | None = None) -> DataFrame:
    """All that ``seed(state, colours)`` reaches, in each colour over its own edges, through what ``guard`` allows (the seed itself isn't guarded)."""
    if forward:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), SET)
    return exists_until(guard, seed, edges, how, log)
