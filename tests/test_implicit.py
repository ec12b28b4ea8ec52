"""Systems without a table of edges against the same ones with it."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tintwalk import formula as f
from tintwalk.operators import temporal
from tintwalk.plans.checker import Checker
from tintwalk.queries import QUERIES
from tintwalk.sources import tables
from tintwalk.sources.implicit import ImplicitSystem, Move
from tintwalk.system import NEGATIVE, POSITIVE, TransitionSystem


@pytest.fixture(scope="module")
def ring(spark):
    """Thirty states: one on in colours above 0, halved if even, five back in colour 2 by two moves of one direction; facts lock every seventh state."""
    S, C = F.col("state"), F.col("colour")  # noqa: N806
    facts = spark.createDataFrame([(i, i % 7 == 3) for i in range(30)], "key long, locked boolean")
    moves = [
        Move((S + 1) % 30, F.array((S + 29) % 30), (C > 0) & ~F.col("locked"), "x", POSITIVE),
        Move(F.floor(S / 2), F.array(S * 2, S * 2 + 1), S % 2 == 0, "x", NEGATIVE),
        Move(S - 5, F.array(S + 5), C == 2, "y", NEGATIVE),
        Move(S - 5, F.array(S + 5), (C == 2) & (S % 3 == 0), "y", NEGATIVE),
    ]
    return ImplicitSystem(moves, S.between(0, 29), facts, S)


def explicit(spark, ring):
    states = spark.range(30).withColumnRenamed("id", "state")
    colours = spark.createDataFrame([(c,) for c in range(3)], "colour int")
    edges = None
    for m in ring.moves:
        some = states.crossJoin(colours).join(ring.facts.withColumnRenamed("key", "state"), "state").where(m.when)
        some = some.select(F.col("state").alias("src"), m.to.cast("long").alias("dst"), F.lit(m.name).alias("dir_name"), F.lit(m.facet).alias("dir_facet"), "colour").where("dst between 0 and 29")
        edges = some if edges is None else edges.unionByName(some)
    return TransitionSystem(states, colours, edges)


def rows(df):
    found = [(r.state, r.colour) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_operators_are_those_over_edges(spark, ring):
    made = explicit(spark, ring)
    checker = Checker(made)
    p, q = f.where("state % 8 = 5"), f.where("state % 5 <> 2")
    goal, path = checker.verify(p), checker.verify(q)
    for along in (f.ANYWHERE, ~f.down("x")):
        assert rows(ring.some_next(goal, along)) == rows(checker.verify(f.EX(p, along)))
        assert rows(ring.every_next(goal, along)) == rows(checker.verify(f.AX(p, along)))
    assert rows(ring.exists_until(path, goal, f.up("x"))) == rows(checker.verify(f.EU(q, p, f.up("x"))))
    assert rows(ring.every_until(path, goal)) == rows(checker.verify(f.AU(q, p)))
    guarded = ring.reach(goal, True, lambda df: df.where("state % 5 <> 2"))
    assert rows(guarded) == rows(temporal.reach(goal, made.edges, True, path))


def test_open_names_ride_along(spark, ring):
    made = explicit(spark, ring)
    named = made.space().where("state % 11 = 4").select(F.col("state").alias("atx"), "state", "colour")
    want = temporal.exists_until(None, named, made.edges, F.lit(True), made.states)
    assert {(r.atx, r.state, r.colour) for r in ring.exists_until(None, named).collect()} == {(r.atx, r.state, r.colour) for r in want.collect()}


def test_states_that_do_not_exist_are_left(spark, ring):
    outside = spark.createDataFrame([(99, 0), (-1, 1)], "state long, colour int")
    assert ring.existing(outside).count() == 0 and ring.edges_from(outside).count() == 0 and ring.edges_into(outside).count() == 0


def test_a_fixpoint_costs_what_it_reaches(spark):
    """Of a space of 2 ** 20 states, a few are expanded."""
    S = F.col("state")  # noqa: N806
    moves = [Move(S * 2, F.array(F.floor(S / 2)), S < 1 << 19), Move(S * 2 + 1, F.array(F.floor(S / 2)), S < 1 << 19)]
    tree = ImplicitSystem(moves, S.between(1, (1 << 20) - 1))
    leaf = spark.createDataFrame([(987_654, 0)], "state long, colour int")
    log = []
    assert rows(tree.exists_until(None, leaf, log=log)) == {(987_654 >> i, 0) for i in range(20)}
    assert sum(n for _, _, n in log) == 20


def test_the_stock_of_parts(spark):
    stock = tables.stock(spark, "/root/testdata/sf0.001")
    part = stock.facts.orderBy(F.desc("room"), "key").first()
    full = spark.createDataFrame([(part.key * tables.LEVELS + part.room, 0)], "state long, colour int")
    assert rows(stock.edges_from(full)) == ({(full.first().state - part.order, 0)} if part.order <= part.room else set())


def test_facts_of_the_stock_are_written_once(spark):
    """A round reads them, and must not group all lines again."""
    plan = tables.stock(spark, "/root/testdata/sf0.001").facts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_stock_is_reached_of_all_parts(spark):
    """Of every part that was ordered, in every colour, and not of the small ones alone."""
    facts = tables.stock(spark, "/root/testdata/sf0.001").facts
    found = QUERIES["implicit_reach"](spark, "/root/testdata/sf0.001").select(F.floor(F.col("state") / tables.LEVELS).alias("key"), "colour").distinct()
    assert facts.where("room > 12").count() > 0
    assert {(r.key, r.colour) for r in found.collect()} == {(r.key, c) for r in facts.collect() for c in range(tables.DAYS)}


def test_leaps_reach_what_moves_reach(spark):
    stock = tables.stock(spark, "/root/testdata/sf0.001")
    seed = stock.facts.where("room between 20 and 30").select((F.col("key") * tables.LEVELS).alias("state"), F.explode(F.array(*[F.lit(c) for c in range(tables.DAYS)])).alias("colour"))
    leapt, moved = [], []
    assert rows(stock.reach(seed, log=leapt)) == rows(replace(stock, leaps=()).reach(seed, log=moved))
    assert len(leapt) < len(moved)
