"""Systems without a table of edges: what a state leads to, and what leads to it, are expressions of the state.

A state is a long, and a :class:`Move` says where it goes, from where it comes, and when. Facts about a state (capacities, prices) are a table that is met by a key made from the state.
Operators expand the rows they are given and no others, so a fixpoint costs what it reaches, however large the space of states is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwalk.formula import ANYWHERE, Direction
from tintwalk.operators.relations import KEY, conjunction, names
from tintwalk.operators.temporal import closure
from tintwalk.system import ANY
from tintwalk.written import Grown, cut


@dataclass(frozen=True)
class Move:
    """An edge from each state for which ``when`` holds, an expression of ``state``, ``colour`` and the facts.

    ``to`` gives the target of ``state``; ``back`` an array of the states that may have a given one for target, in the same columns. Sources that ``back`` gives too
    many don't matter: they are kept if ``when`` holds and ``to`` leads back.
    """

    to: Column
    back: Column
    when: Column
    name: str | None = None
    facet: str = ANY


@dataclass(frozen=True)
class ImplicitSystem:
    """``moves`` over the states for which ``exists`` holds; ``facts(key, ...)``, a row for a key, are met where ``key``, an expression of ``state``, is theirs.

    ``leaps`` are no edges: each is what several moves in a row come to, and takes ``reach`` there in one round.
    """

    moves: Sequence[Move]
    exists: Column
    facts: DataFrame | None = None
    key: Column | None = None
    leaps: Sequence[Move] = ()

    def _known(self, rows: DataFrame) -> DataFrame:
        """With facts; states without any, or that don't exist, go."""
        if self.facts is not None:
            rows = rows.withColumn("_key", self.key).join(self.facts.withColumnRenamed("key", "_key"), "_key")
        return rows.where(self.exists)

    def _ways(self) -> list[Column]:
        return [F.struct(F.lit(m.name).cast("string").alias("dir_name"), F.lit(m.facet).alias("dir_facet")) for m in self.moves]

    def edges_from(self, rel: DataFrame, along: Direction = ANYWHERE) -> DataFrame:
        """``(columns of rel, src, goes)`` with ``state`` for the target: every edge that leaves a row of ``rel(names..., state, colour)``, and whether it goes along."""
        way = self._ways()
        out = F.array(*[F.when(m.when, F.struct(m.to.cast("long").alias("to"), w.alias("way"))) for m, w in zip(self.moves, way, strict=True)])
        each = self._known(rel).select(*rel.columns, F.explode(F.filter(out, lambda x: x.isNotNull())).alias("e"))
        each = each.select(*names(rel), F.col("state").alias("src"), F.col("e.to").alias("state"), "colour", F.col("e.way.dir_name").alias("dir_name"), F.col("e.way.dir_facet").alias("dir_facet"))
        return self.existing(each).select(*names(rel), "src", *KEY, along.column().alias("goes")).distinct()

    def edges_into(self, rel: DataFrame, along: Direction = ANYWHERE) -> DataFrame:
        """``(names..., state, colour)`` (a set) of what has an edge along into ``rel``."""
        way = self._ways()
        numbered = lambda i: lambda s: F.struct(s.cast("long").alias("s"), F.lit(i).alias("move"))
        sources = [F.transform(m.back, numbered(i)) for i, m in enumerate(self.moves)]
        each = self._known(rel.withColumn("dst", F.col("state")))
        each = each.withColumn("e", F.explode(F.concat(*sources))).select(*names(rel), "dst", "colour", F.col("e.s").alias("state"), F.col("e.move").alias("move"))
        fits = F.lit(False)
        for i, m in enumerate(self.moves):
            fits = F.when(F.col("move") == i, m.when & (m.to == F.col("dst"))).otherwise(fits)
        each = self._known(each).where(fits).select(*names(rel), *KEY, F.get(F.array(*way), F.col("move")).alias("w"))
        return each.select(*names(rel), *KEY, "w.dir_name", "w.dir_facet").where(along.column()).select(*names(rel), *KEY).distinct()

    def existing(self, rows: DataFrame) -> DataFrame:
        """Rows whose state exists."""
        return self._known(rows).select(*rows.columns)

    # operators, as of :mod:`tintwalk.operators.temporal`

    def some_next(self, rel: DataFrame, along: Direction = ANYWHERE) -> DataFrame:
        return self.edges_into(rel, along)

    def every_next(self, rel: DataFrame, along: Direction = ANYWHERE) -> DataFrame:
        """Some edge, and every one goes along and into ``rel``."""
        return self._all_into(self.edges_into(rel, along), rel, along)

    def _all_into(self, candidates: DataFrame, rel: DataFrame, along: Direction) -> DataFrame:
        out = self.edges_from(candidates, along)
        at = rel.select(*names(rel), *KEY, F.lit(True).alias("_in"))
        into = out.join(at, [*names(rel), *KEY], "left").groupBy(*names(rel), F.col("src").alias("state"), "colour")
        return into.agg(F.bool_and(F.col("goes") & F.col("_in").isNotNull()).alias("all_in")).where("all_in").drop("all_in")

    def exists_until(self, path: DataFrame | None, goal: DataFrame, along: Direction = ANYWHERE, log: list | None = None) -> DataFrame:
        path = cut(path, "path") if path is not None else None

        def step(rel: DataFrame) -> DataFrame:
            back = self.edges_into(rel, along)
            return conjunction(back, path) if path is not None else back

        return closure(goal.distinct(), step, "exists-until", log)

    def every_until(self, path: DataFrame | None, goal: DataFrame, along: Direction = ANYWHERE, log: list | None = None) -> DataFrame:
        """A round judges what has an edge into the rows that the last one added."""
        path = cut(path, "path") if path is not None else None
        found, keys = Grown(goal.sparkSession, goal.schema, "every-until"), goal.columns
        new = found.add(goal.distinct())
        while new is not None:
            touched = self.edges_into(new, along).join(found.all(), keys, "left_anti")
            touched = conjunction(touched, path) if path is not None else touched
            new = found.add(self._all_into(touched, found.all(), along))
        if log is not None:
            log += [(found.name, at, n) for at, n in enumerate(found.rounds)]
        return found.all()

    def reach(self, seed: DataFrame, forward: bool = True, guard: Callable[[DataFrame], DataFrame] | None = None, log: list | None = None) -> DataFrame:
        """All that ``seed(state, colour)`` reaches through rows that ``guard`` lets pass (the seed itself isn't guarded); a guard is asked at every move, so none is leapt."""
        ways = self if guard else replace(self, moves=[*self.moves, *self.leaps])

        def step(rel: DataFrame) -> DataFrame:
            rows = ways.edges_from(rel).select(*rel.columns) if forward else ways.edges_into(rel)
            return guard(rows) if guard else rows

        return closure(seed.select(*KEY).distinct(), step, "reach", log)
