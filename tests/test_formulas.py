"""Formulas over random systems against a set-based evaluator, and laws that must hold."""

import os
import random

import pytest

from tests.oracle import Graph
from tintwalk import formula as f
from tintwalk.operators.components import terminal_components
from tintwalk.plans.checker import Checker
from tintwalk.system import EDGE_SCHEMA, TransitionSystem

P, Q = f.atom("p"), f.atom("q")
X, Y = f.up("x"), f.down("y")


def graph(rng, n=6, colours=3):
    edges = {(rng.randrange(n), rng.randrange(n), *rng.choice([("x", "+"), ("x", "-"), ("y", "-"), (None, "TRUE"), (None, "LOOP")]), rng.randrange(colours)) for _ in range(rng.randrange(n * colours * 2))}
    atoms = {(a, s, c) for a in "pq" for s in range(n) for c in range(colours) if rng.random() < 0.4}
    return Graph(n, colours, edges, atoms)


def system(spark, g):
    return TransitionSystem(
        spark.createDataFrame([(s,) for s in range(g.n)], "state long"),
        spark.createDataFrame([(c,) for c in range(g.colours)], "colour int"),
        spark.createDataFrame(list(g.edges) * 2, EDGE_SCHEMA),
        spark.createDataFrame(list(g.atoms) * 2, "atom string, state long, colour int"),
    )


def same(spark, g, checker, *formulas):
    for q in formulas:
        got = [(r.state, r.colour) for r in checker.verify(q).collect()]
        assert len(got) == len(set(got)) and set(got) == g.sat(q), q


TEMPORAL = [
    *[op(P) for op in (f.EX, f.AX, f.EwX, f.AwX, f.EF, f.AF, f.EwF, f.AwF, f.EG, f.AG)],
    *[op(P) for op in (f.pEX, f.pAX, f.pEwX, f.pAwX, f.pEF, f.pAF, f.pEwF, f.pAwF, f.pEG, f.pAG)],
    *[op(P, X | ~Y) for op in (f.EX, f.AX, f.EwX, f.AwX, f.EF, f.AF, f.EwF, f.AwF, f.EG, f.AG, f.pEX, f.pAF, f.pAwF, f.pEwF)],
    *[op(P, Q) for op in (f.EU, f.AU, f.pEU, f.pAU)],
    *[op(P, Q, ~X) for op in (f.EU, f.AU, f.pEU, f.pAU)],
]
HYBRID = [
    f.bind("x", f.EX(f.EF(f.var("x")))),
    f.bind("x", f.AG(f.EF(f.var("x")))),
    f.bind("x", f.AX(f.EF(f.var("x") & P))),
    f.bind("x", ~f.EX(f.bind("x", f.EX(f.var("x")))) | P),
    f.bind("x", f.EX(f.bind("y", f.EF(f.var("x") & f.EX(f.var("y")))))),
    f.exists("x", f.EX(f.var("x") & P), bound=f.EX(Q)),
    f.exists("x", ~f.EX(f.var("x")), bound=P),
    f.exists("x", P, bound=f.EX(Q)),
    f.forall("x", f.EF(f.var("x")), bound=P),
    f.forall("x", f.exists("y", f.EX(f.var("x") | f.var("y")), bound=f.EX(f.var("x")) | Q), bound=P),
    f.forall("y", f.EF(f.var("y")), bound=f.exists("z", f.var("z") & f.EX(f.EF(f.var("z"))))),
    f.at(2, f.EX(P)),
    f.bind("x", f.EX(f.at("x", P & f.EX(Q)))),
    f.bind("x", f.AF(f.at("x", ~P))),
    f.exists("x", f.at("x", f.EX(P)) & f.EF(f.var("x"))),
    f.bind("x", f.AU(P, f.var("x"))),
    f.bind("x", f.EX(f.EU(f.EX(f.var("x")), Q))),
    f.var(3) & P.iff(Q) | P.implies(f.FALSE),
]


@pytest.mark.parametrize("seed", [0])
def test_temporal_operators(spark, seed):
    g = graph(random.Random(seed))
    same(spark, g, Checker(system(spark, g)), *TEMPORAL)


@pytest.mark.parametrize("seed", range(2))
def test_hybrid_and_first_order(spark, seed):
    g = graph(random.Random(10 + seed), n=5, colours=2)
    same(spark, g, Checker(system(spark, g)), *HYBRID)


def test_terminal_components(spark):
    for seed in range(3):
        g = graph(random.Random(20 + seed))
        reach = {(s, c): {t for t in range(g.n) if (s, c) in Graph(g.n, g.colours, g.edges, {("t", t, c)}).sat(f.EF(f.atom("t")))} for s, c in g.space()}
        want = {(min(reach[s, c]), s, c) for s, c in g.space() if all(s in reach[t, c] for t in reach[s, c])}
        assert {tuple(r) for r in terminal_components(system(spark, g)).collect()} == want


def test_equal_formulas_share_a_relation(spark):
    g = graph(random.Random(1))
    checker = Checker(system(spark, g))
    one, two = f.bind("x", f.EX(f.var("x"))), f.bind("z", f.EX(f.var("z")))
    assert f.canonical(one) == f.canonical(two)
    found = checker.verify({"one": one, "two": f.EF(two), "three": f.EF(one)})
    assert found["two"].sameSemantics(found["three"])
    assert {r.fixpoint for r in checker.statistics().collect()} == {"exists-until"}


def test_shared_steps_are_written_once_and_let_go(spark):
    g = graph(random.Random(1))
    shared = f.EX(f.EX(P))
    with Checker(system(spark, g)) as checker:
        found = checker.verify({"one": shared & Q, "two": f.EX(shared), "three": f.EF(~shared)})
        for name, q in (("one", shared & Q), ("two", f.EX(shared)), ("three", f.EF(~shared))):
            assert {(r.state, r.colour) for r in found[name].collect()} == g.sat(q)
        plans = [found[name]._jdf.queryExecution().optimizedPlan().toString() for name in ("one", "two")]
        assert plans[0].count("Join Inner") == 0 and plans[1].count("Join Inner") == 1
        assert all(os.path.isdir(p) for p in checker.paths if "/shared-" in p)
        paths = list(checker.paths)
    assert len(paths) > 3 and not any(os.path.exists(p) for p in paths)
    assert {(r.state, r.colour) for r in checker.verify(shared).collect()} == g.sat(shared)


def test_names_that_are_bound_nowhere(spark):
    g = graph(random.Random(1))
    with pytest.raises(ValueError, match="bound nowhere: y"):
        Checker(system(spark, g)).verify(f.bind("x", f.EX(f.var("y"))))
    with pytest.raises(ValueError, match="larger|would have"):
        Checker(system(spark, g), largest_space=10).verify(f.bind("x", f.AG(f.EF(f.var("x")))))


def test_totalised_and_problems(spark):
    g = graph(random.Random(2))
    made = system(spark, g)
    assert not made.is_total() and made.totalised().is_total()
    assert made.problems().count() == 0
    wrong = TransitionSystem(made.states, made.colours.where("colour < 1"), spark.createDataFrame([(0, 99, None, "TRUE", 2)], EDGE_SCHEMA), made.atoms)
    assert {r.problem for r in wrong.problems().collect()} >= {"edge to an undeclared state", "edge of an undeclared colour"}
    empty = TransitionSystem(*[df.where("false") for df in (made.states, made.colours, made.edges, made.atoms)])
    assert Checker(empty).verify(f.AG(f.EF(P))).count() == 0 and terminal_components(empty).count() == 0


@pytest.mark.parametrize("build", [(f.AG, f.EF), (f.pAG, f.pEF)])
def test_where_all_that_is_reached_leads_back_needs_no_pairs(spark, build):
    g = graph(random.Random(12), n=5, colours=2)
    same(spark, g, Checker(system(spark, g), largest_space=10), f.bind("x", build[0](build[1](f.var("x")))))
