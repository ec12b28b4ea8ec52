"""Which part of the state space a state belongs to. Parts change where rows lie and never what holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwalk.system import TransitionSystem


def single(state: Column) -> Column:
    return F.lit(0)


def hashed(state: Column, parts: int) -> Column:
    return F.pmod(state, F.lit(parts)).cast("int")


def uniform(state: Column, parts: int, count: int) -> Column:
    """Equal ranges of the states 0 to ``count - 1``."""
    return F.floor(state / F.lit(max(-(-count // parts), 1))).cast("int")


def intervals(state: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """The first of ``ranges`` (both ends inside) that holds the state, else -1."""
    part = F.lit(-1)
    for at, (low, high) in reversed(list(enumerate(ranges))):
        part = F.when(state.between(low, high), at).otherwise(part)
    return part.cast("int")


def blocks(state: Column, parts: int, count: int, block_count: int) -> Column:
    """Blocks of neighbours, dealt out in turn; more blocks than states are blocks of one state."""
    return F.pmod(F.floor(state / F.lit(max(count // block_count, 1))), F.lit(parts)).cast("int")


def listed(system: TransitionSystem, parts: DataFrame) -> DataFrame:
    """``(state, part)`` from a table of them; states it lacks are in part 0."""
    return system.states.select("state").join(parts.select("state", "part"), "state", "left").select("state", F.coalesce("part", F.lit(0)).alias("part"))


def dealt(system: TransitionSystem, part: Column, parts: int) -> TransitionSystem:
    """The system with its tables partitioned by ``part``, an expression of the column ``state``."""
    by_source = system.edges.withColumn("state", F.col("src"))
    edges = by_source.withColumn("part", part).repartition(parts, "part").select(*system.edges.columns)
    return replace(system, states=system.states.withColumn("part", part).repartition(parts, "part").drop("part"), edges=edges)
