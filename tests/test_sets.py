"""Formulas over sets of colours: the same answers as with a row for each colour, and fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import Graph
from tests.test_formulas import TEMPORAL, graph, system
from tintwalk import formula as f
from tintwalk.functions.colours import Arrays, Bits, Masks, decoded, encoded
from tintwalk.operators import sets, temporal
from tintwalk.plans.checker import Checker
from tintwalk.plans.set_checker import SetChecker
from tintwalk.sources import tables
from tintwalk.sources.cube import Cube

P, Q = f.atom("p"), f.atom("q")


def rows(df):
    found = [tuple(r) for r in df.select("state", "colour").collect()]
    assert len(set(found)) == len(found)
    return set(found)


@pytest.mark.parametrize("how", [Masks(3), Bits(3), Arrays((0, 1, 2))])
def test_formulas_are_those_of_the_evaluator(spark, how):
    g = graph(random.Random(31))
    checker = SetChecker(system(spark, g), how)
    some = random.Random(4).sample(TEMPORAL, 30 if isinstance(how, Masks) else 8)
    for q in [*some, f.TRUE, f.FALSE, P & ~Q, ~P | Q, f.var(2), P.iff(Q), f.steps_in(f.up("x")), f.AG(f.EF(P)) & ~f.EX(f.AF(Q, f.up("x")))]:
        assert rows(checker.verify(q)) == g.sat(q), q


def test_more_colours_than_a_long_has_bits(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(8), rng.randrange(8), "x", "+", c) for c in range(130) for _ in range(6)}
    g = Graph(8, 130, edges, {(a, s, c) for a in "pq" for s in range(8) for c in range(130) if rng.random() < 0.3})
    checker = SetChecker(system(spark, g))
    assert isinstance(checker.how, Bits) and checker.how.words == 3
    for q in (f.EU(~P, Q), f.AU(P, Q), f.AX(P), f.EX(f.AF(Q)), ~P, f.AwF(P)):
        assert rows(checker.verify(q)) == g.sat(q), q


@pytest.mark.parametrize("n", [1, 63, 64, 65, 130])
def test_bits(spark, n):
    rng = random.Random(n)
    held = [{c for c in range(n) if rng.random() < p} for p in (0.0, 0.2, 0.8, 1.0)] + [{n - 1}, {0}]
    how, a, b = Bits(n), F.col("a"), F.col("b")
    one = encoded(spark.createDataFrame([(i, c) for i, s in enumerate(held) for c in s], "state long, colour int"), how, "a")
    pairs = one.crossJoin(one.select(F.col("state").alias("other"), F.col("a").alias("b")))
    tests = [how.colours(x) for x in (how.both(a, b), how.either(a, b), how.less(a, b), how.other(a), how.all(), how.none())]
    for r in pairs.select("state", "other", F.array(*tests).alias("sets"), how.has_more(a, b).alias("more"), how.same(a, b).alias("same"), how.is_some(how.less(a, b)).alias("some")).collect():
        x, y = held[r.state], held[r.other]
        assert [set(s) for s in r.sets] == [x & y, x | y, x - y, set(range(n)) - x, set(range(n)), set()]
        assert (r.more, r.same, r.some) == (bool(x - y), x == y, bool(x - y))
    assert set(one.agg(how.colours(how.union(a)).alias("u")).first().u) == set().union(*held)
    assert {tuple(r) for r in decoded(one, how, "a").select("state", "colour").collect()} == {(i, c) for i, s in enumerate(held) for c in s}


def test_reach_with_a_guard_and_open_names(spark):
    g = graph(random.Random(9))
    made, how = system(spark, g), Masks(3)
    seed, guard = (made.atoms.where(F.col("atom") == a).select("state", "colour").distinct() for a in "pq")
    edges = sets.edges_of(made.edges, how)
    for forward in (True, False):
        for through in (None, guard):
            got = sets.reach(encoded(seed, how), edges, how, forward, None if through is None else encoded(through, how))
            assert rows(decoded(got, how)) == rows(temporal.reach(seed, made.edges, forward, through))
    named = made.space().select(F.col("state").alias("atx"), "state", "colour")
    want = temporal.exists_until(None, named, made.edges, F.lit(True), made.states)
    got = decoded(sets.exists_until(None, encoded(named, how), edges, how), how)
    assert {tuple(r) for r in got.select("atx", "state", "colour").collect()} == {tuple(r) for r in want.select("atx", "state", "colour").collect()}


def test_a_round_has_a_row_for_a_state(spark):
    """On users who hand on, in five colours: the rows that rounds add and shuffle, for both forms."""
    made = tables.handoff(spark, "/root/testdata/sf0.001")
    goal = f.where("state % 7 = 0")
    by_set, by_row = SetChecker(made), Checker(made)
    assert rows(by_set.verify(f.EF(goal))) == rows(by_row.verify(f.EF(goal)))
    total = lambda checker: checker.statistics().agg(F.sum("rows")).first()[0]
    assert total(by_set) < 0.6 * total(by_row)


def test_what_is_not_evaluated_over_sets(spark):
    g = graph(random.Random(1))
    with pytest.raises(ValueError, match="Bind isn't evaluated"):
        SetChecker(system(spark, g)).verify(f.bind("x", f.EX(f.var("x"))))
    with pytest.raises(ValueError, match="numbered from 0"):
        made = system(spark, g)
        SetChecker(made.restricted_to(spark.createDataFrame([(0,)], "colour int")).__class__(made.states, spark.createDataFrame([(-1,)], "colour int"), made.edges))


@pytest.mark.parametrize("dims, size", [(2, 3), (3, 3)])
def test_cubes(spark, dims, size):
    cube = Cube(dims, size)
    made = cube.system(spark)
    by_set, by_row = SetChecker(made), Checker(made)
    for q in (f.EX(f.EX(f.where(cube.upper_half))), f.AF(f.where(cube.upper_corner)), f.AU(f.where(cube.upper_half), f.where(cube.upper_corner))):
        assert rows(by_set.verify(q)) == rows(by_row.verify(q))
