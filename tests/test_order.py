"""A fixpoints that are told by the order of the states' numbers: against brute force on small graphs, and by the number of rounds on a cube."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_formulas import TEMPORAL, graph, same, system
from tintwalk import formula as f
from tintwalk.operators import chains, temporal
from tintwalk.plans.checker import Checker
from tintwalk.sources.cube import Cube
from tintwalk.system import TransitionSystem

ALL = [q for q in TEMPORAL if any(isinstance(p, f.Until) and p.every for p in f.subformulas(q))]


@pytest.mark.parametrize("seed", range(2))
def test_by_order_where_numbers_turn(spark, monkeypatch, seed):
    monkeypatch.setattr(chains, "PLAIN", 1)
    monkeypatch.setattr(temporal, "TURNS", 2)  # however many edges turn
    g = graph(random.Random(51 + seed), n=14, colours=2)
    g.edges = {e for e in g.edges if e[0] < e[1] or (e[0] + e[1]) % 4 == seed}
    same(spark, g, Checker(system(spark, g)), *ALL[seed::2])


def test_a_cube_in_few_rounds(spark):
    cube = Cube(2, 30)
    checker = Checker(cube.system(spark))
    found = checker.verify(f.AF(f.where(cube.upper_corner)))
    wanted = cube.owned(spark).unionByName(cube.colours(spark).select(F.lit(cube.count - 1).cast("long").alias("state"), "colour")).distinct()
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    assert checker.statistics().where("fixpoint = 'every-until'").count() <= 20  # 59 one step at a time


def test_a_circle_and_what_leads_to_it_in_a_falling_order(spark):
    """States 99 to 0, each to the next two below; 50 also goes back to 60, and 40 to itself."""
    edges = spark.range(100).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("dst")).where("dst >= 0")
    more = spark.createDataFrame([(50, 60), (40, 40)], "src long, dst long")
    none, colour = F.lit(None).cast("string").alias("dir_name"), F.lit(0).alias("colour")
    edges = edges.unionByName(more).select("src", "dst", none, F.lit("TRUE").alias("dir_facet"), colour)
    one = spark.range(1).select(F.col("id").cast("int").alias("colour"))
    log = lambda c: {row["fixpoint"] for row in c.statistics().collect()}
    checker = Checker(TransitionSystem(spark.range(100).toDF("state"), one, edges))
    assert {row["state"] for row in checker.verify(f.AF(f.where("state = 0"))).collect()} == set(range(40))
    assert {"lost", "doubtful"} <= log(checker)
    loose = Checker(TransitionSystem(spark.range(100).toDF("state"), one, edges.where("src <> dst")))
    assert {row["state"] for row in loose.verify(f.AF(f.where("state = 0"))).collect()} == set(range(50))
