"""A hypercube of states, made on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.system import LOOP, POSITIVE, TransitionSystem


@dataclass(frozen=True)
class Cube:
    """``size`` ** ``dims`` states; a state's number has its coordinates for digits. Edges add 1 to a coordinate.

    Colours are 0 to (size - 1) * dims + 1. A state owns colour 0 and, for each dimension i, the colours p + (size - 1) * i for p from 1 to
    its coordinate; edges upwards have their source's colours, and a loop has the others, so that every state has an edge in every colour.
    """

    dims: int
    size: int

    @property
    def count(self) -> int:
        return self.size**self.dims

    @property
    def colour_count(self) -> int:
        return (self.size - 1) * self.dims + 2

    def coordinate(self, state: Column, i: int) -> Column:
        return F.pmod(F.floor(state / F.lit(self.size**i)), F.lit(self.size)).cast("int")

    def coordinates(self, state: Column) -> Column:
        return F.array(*[self.coordinate(state, i) for i in range(self.dims)])

    def owns(self, state: Column, colour: Column) -> Column:
        step = max(self.size - 1, 1)
        i = F.floor((colour - 1) / step).cast("int")
        within = F.get(self.coordinates(state), i)
        return (colour == 0) | ((colour > 0) & (i < self.dims) & (colour - i * step <= within) & F.lit(self.size > 1))

    def states(self, spark: SparkSession) -> DataFrame:
        cells = spark.range(self.count).withColumnRenamed("id", "state")
        return cells.select("state", *[self.coordinate(F.col("state"), i).alias(f"x{i}") for i in range(self.dims)])

    def colours(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.colour_count).select(F.col("id").cast("int").alias("colour"))

    def _valued(self, spark: SparkSession, owned: bool) -> DataFrame:
        """(state, colour) of the colours that each state owns, or of the others."""
        each = self.states(spark).select("state", F.explode(F.sequence(F.lit(0), F.lit(self.colour_count - 1))).alias("colour"))
        owns = F.coalesce(self.owns(F.col("state"), F.col("colour")), F.lit(False))
        return each.where(owns if owned else ~owns)

    def owned(self, spark: SparkSession) -> DataFrame:
        """(state, colour) of the colours that each state owns."""
        return self._valued(spark, True)

    def system(self, spark: SparkSession) -> TransitionSystem:
        owned = self.owned(spark)
        ways = F.explode(F.array(*[F.struct(F.lit(f"x{i}").alias("dir_name"), F.lit(self.size**i).cast("long").alias("add"), self.coordinate(F.col("state"), i).alias("at")) for i in range(self.dims)]))
        up = owned.select("state", "colour", ways.alias("w")).where(F.col("w.at") < self.size - 1)
        up = up.select(F.col("state").alias("src"), (F.col("state") + F.col("w.add")).alias("dst"), "w.dir_name", F.lit(POSITIVE).alias("dir_facet"), "colour")
        loops = self._valued(spark, False).select(F.col("state").alias("src"), F.col("state").alias("dst"), F.lit(None).cast("string").alias("dir_name"), F.lit(LOOP).alias("dir_facet"), "colour")
        return TransitionSystem(self.states(spark), self.colours(spark), up.unionByName(loops))

    def every(self, low: int, high: int | None = None) -> str:
        """A condition: all coordinates from ``low`` to ``high``."""
        return " AND ".join(f"x{i} BETWEEN {low} AND {self.size - 1 if high is None else high}" for i in range(self.dims))

    @property
    def lower_corner(self) -> str:
        return self.every(0, 0)

    @property
    def upper_corner(self) -> str:
        return self.every(self.size - 1)

    @property
    def center(self) -> str:
        return self.every(self.size // 2, self.size // 2)

    @property
    def border(self) -> str:
        return " OR ".join(f"x{i} IN (0, {self.size - 1})" for i in range(self.dims))

    @property
    def upper_half(self) -> str:
        return self.every(self.size // 2)
