"""Boolean operators over relations ``(names..., state, colour)``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["state", "colour"]


def names(rel: DataFrame) -> list[str]:
    return [c for c in rel.columns if c not in KEY]


def nothing(space: DataFrame) -> DataFrame:
    return space.where(F.lit(False))


def widened(rel: DataFrame, wanted: list[str], states: DataFrame) -> DataFrame:
    """``rel`` with a column for each name in ``wanted``; a name that ``rel`` lacks takes every state."""
    for name in wanted:
        if name not in rel.columns:
            rel = rel.crossJoin(states.select(F.col("state").alias(name)))
    return rel.select(*sorted(set(wanted) | set(names(rel))), *KEY)


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    """Natural join: on names that both have, state and colour."""
    if set(names(b)) <= set(names(a)):
        return a.join(b, [*names(b), *KEY], "left_semi")
    if set(names(a)) <= set(names(b)):
        return b.join(a, [*names(a), *KEY], "left_semi")
    shared = [c for c in a.columns if c in b.columns]
    both = a.join(b, shared)
    return both.select(*sorted(names(both)), *KEY)


def disjunction(a: DataFrame, b: DataFrame, states: DataFrame) -> DataFrame:
    wanted = sorted({*names(a), *names(b)})
    return widened(a, wanted, states).unionByName(widened(b, wanted, states)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` doesn't hold; the names of ``b`` must be among those of ``a``."""
    return a.join(b, [*names(b), *KEY], "left_anti")


def complement(rel: DataFrame, space: DataFrame, states: DataFrame) -> DataFrame:
    return difference(widened(space, names(rel), states), rel)


def restricted(rel: DataFrame, colours: DataFrame) -> DataFrame:
    """Rows whose colour is among ``colours``."""
    return rel.join(colours.select("colour"), "colour", "left_semi").select(*rel.columns)


def all_colours(rel: DataFrame) -> DataFrame:
    return rel.select("colour").distinct()


def pivots(rel: DataFrame) -> DataFrame:
    """One state for each colour: its smallest."""
    return rel.groupBy("colour").agg(F.min("state").alias("state")).select(*KEY)


def different(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(side, ...)``: rows of one relation that the other lacks; empty for equal relations, whatever the order or repeats of rows."""
    cols = a.columns
    a = a.distinct().select(*[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("in_a"))
    b = b.select(*cols).distinct().select(*[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("in_b"))
    same = reduce(Column.__and__, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cols])
    rows = a.join(b, same, "full_outer").where("in_a is null or in_b is null")
    return rows.select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in cols], F.when(F.col("in_b").isNull(), "left").otherwise("right").alias("side"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return different(a, b).isEmpty()


def pretty(rel: DataFrame, colour_names: DataFrame | None = None) -> DataFrame:
    """``(state, colours)``: each state with the sorted list of its colours, by name if ``colour_names(colour, name)`` is given."""
    named = rel.join(colour_names, "colour") if colour_names is not None else rel.withColumn("name", F.col("colour"))
    return named.groupBy("state").agg(F.sort_array(F.collect_set("name")).alias("colours"))


def assert_equal(actual: DataFrame, expected: DataFrame, what: str = "relation", shown: int = 10) -> None:
    """Raise AssertionError with up to ``shown`` rows that are missing and as many that are too many, if the relations differ."""
    sides = {"left": "too many", "right": "missing"}
    rows = different(actual, expected)
    counts = {r.side: r.n for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = {side: rows.where(F.col("side") == side).drop("side").orderBy(*actual.columns).limit(shown).collect() for side in counts}
    if some:
        told = [f"{sides[side]} ({counts[side]}): {', '.join(str(tuple(x)) for x in some[side])}" for side in sorted(some)]
        raise AssertionError(f"{what}: {'; '.join(told)}")


# relations made by hand


def of_states(states: DataFrame, colours: DataFrame) -> DataFrame:
    """All of ``colours`` at each of ``states``; other columns of both are left out."""
    return states.select("state").distinct().crossJoin(colours.select("colour").distinct())


def of_range(spark: SparkSession, first: int, last: int, colours: DataFrame) -> DataFrame:
    """All of ``colours`` at the states ``first`` to ``last``, both inside; none if ``last`` is before ``first``."""
    return of_states(spark.range(first, last + 1).withColumnRenamed("id", "state"), colours)


def of_state(spark: SparkSession, state: int, colours: DataFrame) -> DataFrame:
    return of_range(spark, state, state, colours)


def of_map(spark: SparkSession, sets: Mapping[int, Iterable[int]]) -> DataFrame:
    """The colours that are listed for each state; an empty list is no row."""
    rows = sorted({(state, colour) for state, colours in sets.items() for colour in colours})
    return spark.createDataFrame(rows, "state long, colour int")
