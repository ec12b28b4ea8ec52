"""Transition systems: states, colours, labelled and coloured edges, and propositions, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facets of an edge's direction: a proposition that rises or falls, a loop that totalises, or none.
POSITIVE, NEGATIVE, LOOP, ANY = "+", "-", "LOOP", "TRUE"

EDGE_SCHEMA = "src long, dst long, dir_name string, dir_facet string, colour int"


def flipped(facet: Column) -> Column:
    return F.when(facet == POSITIVE, NEGATIVE).when(facet == NEGATIVE, POSITIVE).otherwise(facet)


@dataclass(frozen=True)
class TransitionSystem:
    """``states(state long, ...)``, ``colours(colour int, ...)``, ``edges(src, dst, dir_name, dir_facet, colour)`` and
    ``atoms(atom string, state, colour)``.

    An edge row is one colour of one transition: (src, dst) is enabled under that colour. Further columns of ``states`` are attributes
    that :func:`tintwalk.formula.where` tests. Rows of edges and atoms are sets: repeats don't change any result.
    """

    states: DataFrame
    colours: DataFrame
    edges: DataFrame
    atoms: DataFrame | None = None

    def space(self) -> DataFrame:
        """All (state, colour). Colours are the small side: a model's parameter valuations, declared one by one."""
        return self.states.select("state").crossJoin(self.colours.select("colour"))

    def reversed(self) -> TransitionSystem:
        """The same system with time turned round: edges swapped and rising directions falling."""
        facet = flipped(F.col("dir_facet")).alias("dir_facet")
        edges = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dir_name", facet, "colour")
        return replace(self, edges=edges)

    def deadlocks(self) -> DataFrame:
        """(state, colour) without an enabled edge."""
        return self.space().join(self.edges.select(F.col("src").alias("state"), "colour"), ["state", "colour"], "left_anti")

    def totalised(self) -> TransitionSystem:
        """With a loop for each (state, colour) that has no enabled edge, so that every path is infinite."""
        none, facet = F.lit(None).cast("string").alias("dir_name"), F.lit(LOOP).alias("dir_facet")
        loops = self.space().select(F.col("state").alias("src"), F.col("state").alias("dst"), none, facet, "colour", F.lit(False).alias("moves"))
        edges = self.edges.select(*loops.columns[:-1], F.lit(True).alias("moves"))
        moving = F.bool_or("moves").over(Window.partitionBy("src", "colour"))  # so that what the edges are made from is read once
        both = edges.unionByName(loops).withColumn("moving", moving)
        return replace(self, edges=both.where("moves or not moving").drop("moves", "moving"))

    def restricted_to(self, colours: DataFrame) -> TransitionSystem:
        """The same system under some of its colours only."""
        few = colours.select("colour").distinct()
        kept = lambda df: df.join(few, "colour", "left_semi").select(*df.columns)
        return replace(self, colours=kept(self.colours), edges=kept(self.edges), atoms=None if self.atoms is None else kept(self.atoms))

    def is_total(self) -> bool:
        return self.deadlocks().isEmpty()

    def problems(self) -> DataFrame:
        """``(problem, n)``: edges or atoms of undeclared states or colours, states declared twice."""
        colours, states = self.colours.select("colour"), self.states.select("state")
        edges = self.edges
        found = [
            ("edge from an undeclared state", edges.join(states.withColumnRenamed("state", "src"), "src", "left_anti")),
            ("edge to an undeclared state", edges.join(states.withColumnRenamed("state", "dst"), "dst", "left_anti")),
            ("edge of an undeclared colour", edges.join(colours, "colour", "left_anti")),
            ("state declared twice", states.groupBy("state").count().where(F.col("count") > 1)),
        ]
        if self.atoms is not None:
            found.append(("proposition at an undeclared state", self.atoms.join(states, "state", "left_anti")))
            found.append(("proposition of an undeclared colour", self.atoms.join(colours, "colour", "left_anti")))
        counts = [df.agg(F.lit(what).alias("problem"), F.count(F.lit(1)).alias("n")) for what, df in found]
        out = counts[0]
        for df in counts[1:]:
            out = out.unionByName(df)
        return out.where("n > 0")
