"""``bind x: EX EF x`` by walks that end where a start is met again: against brute force, and by the rows and rounds it takes."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_chains import line
from tests.test_formulas import graph, same, system
from tintwalk import formula as f
from tintwalk.operators import chains
from tintwalk.plans.checker import Checker
from tintwalk.system import TransitionSystem

CIRCLE = f.bind("x", f.EX(f.EF(f.var("x"))))


@pytest.mark.parametrize("plain", [0, 12])
def test_against_brute_force(spark, monkeypatch, plain):
    monkeypatch.setattr(chains, "PLAIN", plain)
    g = graph(random.Random(61), n=7, colours=2)
    g.edges = set(sorted(g.edges, key=str)[::2])
    same(spark, g, Checker(system(spark, g)), CIRCLE, f.bind("x", f.pEX(f.pEF(f.var("x")))))


def test_starts_that_are_met_again_are_followed_no_further(spark):
    to = F.explode(F.array(F.col("id") - 1, F.col("id") + 1))
    edges = spark.range(100).select(F.col("id").alias("src"), to.alias("dst")).where("dst between 0 and 99")
    edges = edges.select("src", "dst", F.lit(None).cast("string").alias("dir_name"), F.lit("TRUE").alias("dir_facet"), F.lit(0).alias("colour"))
    checker = Checker(TransitionSystem(spark.range(100).toDF("state"), spark.range(1).select(F.col("id").cast("int").alias("colour")), edges))
    assert checker.verify(CIRCLE).count() == 100
    assert checker.statistics().agg(F.sum("rows")).first()[0] < 1000  # 10,000 pairs reach each other


def test_a_long_circle_crosses_chains(spark):
    checker = Checker(line(spark, 60, closed=True))
    assert checker.verify(CIRCLE).count() == 60
    assert checker.statistics().where("fixpoint = 'chains'").count() > 0
    assert Checker(line(spark, 60)).verify(CIRCLE).count() == 0
