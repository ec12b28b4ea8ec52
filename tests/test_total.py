"""Totalising reads the edges once, and keeps what a loop's direction and repeated edges mean."""

from pyspark.sql import functions as F

from tintwalk import formula as f
from tintwalk.plans.checker import Checker
from tintwalk.sources import tables
from tintwalk.system import EDGE_SCHEMA, LOOP, TransitionSystem

SF = "/root/testdata/sf0.001"


def test_edges_of_a_totalised_journey_are_made_once(spark):
    plan = tables.journey(spark, SF).totalised().edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # for edges and for states; 3 if loops were told from the edges anew


def test_eg_writes_no_edges(spark):
    checker = Checker(tables.journey(spark, SF).totalised())
    checker.verify(f.EG(~f.where("event_type = 'purchase'")))
    assert not [p for p in checker.paths if "/edges-" in p or "/states-" in p]


def test_loops_where_there_is_no_edge(spark):
    edges = spark.createDataFrame([(0, 1, "v", "+", 0), (0, 1, "v", "+", 0), (1, 1, None, "TRUE", 1)], EDGE_SCHEMA)
    colours = spark.range(2).select(F.col("id").cast("int").alias("colour"))
    made = TransitionSystem(spark.range(2).toDF("state"), colours, edges).totalised()
    loops = made.edges.where(F.col("dir_facet") == LOOP)
    assert {tuple(r) for r in loops.select("src", "dst", "colour").collect()} == {(0, 0, 1), (1, 1, 0)}
    assert made.is_total() and made.edges.columns == edges.columns
