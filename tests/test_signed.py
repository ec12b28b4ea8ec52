"""Signed relations: hybrid and first-order formulas against the evaluator, and plans without products of states."""

import random
import re

import pytest

from tests.oracle import Graph
from tests.test_formulas import graph, system
from tintwalk import formula as f
from tintwalk.operators import signed
from tintwalk.operators.signed import Relation
from tintwalk.plans.checker import Checker

P, Q = f.atom("p"), f.atom("q")
X, Y = f.var("x"), f.var("y")


def drawn(rng, depth, names):
    """A random formula whose open names are among ``names``."""
    leaf = [P, Q, f.TRUE, f.FALSE, f.var(rng.randrange(4)), *(f.var(n) for n in names), *(f.var(n) for n in names)]
    if not depth:
        return rng.choice(leaf)
    sub = lambda more=(): drawn(rng, depth - 1, [*names, *more])
    name = rng.choice("xyz")
    match rng.randrange(10):
        case 0 | 1:
            return ~sub()
        case 2:
            return sub() & sub()
        case 3:
            return sub() | sub()
        case 4:
            return rng.choice([f.EX, f.AX, f.EX])(sub())
        case 5:
            return f.bind(name, sub([name]))
        case 6:
            return f.at(rng.choice([*names, 2]), sub())
        case 8:
            return sub().iff(sub())
        case 7:
            return f.exists(name, sub([name]), bound=rng.choice([f.TRUE, P, ~Q, sub()]))
        case _:
            return f.forall(name, sub([name]), bound=rng.choice([f.TRUE, P, ~Q, sub()]))


@pytest.mark.parametrize("seed", range(2))
def test_random_formulas(spark, seed):
    rng = random.Random(40 + seed)
    g = graph(rng, n=4, colours=2)
    checker = Checker(system(spark, g))
    for _ in range(12):
        q = drawn(rng, rng.randint(2, 4), [])
        got = [(r.state, r.colour) for r in checker.verify(q).collect()]
        assert len(got) == len(set(got)) and set(got) == g.sat(q), q


def test_a_colour_without_candidates(spark):
    """p holds in one colour only, so that in the other no state is there to be quantified over."""
    g = Graph(4, 2, {(0, 1, None, "TRUE", c) for c in (0, 1)} | {(1, 2, None, "TRUE", 0)}, {("p", 1, 0), ("p", 2, 0), ("q", 0, 1)})
    checker = Checker(system(spark, g))
    for q in (f.exists("x", ~f.EX(X), bound=P), f.forall("x", f.EX(X), bound=P), f.forall("x", ~f.EX(X), bound=P), f.exists("x", ~Q, bound=P), f.bind("y", f.EX(f.forall("x", f.EX(X | Y), bound=P)))):
        assert {(r.state, r.colour) for r in checker.verify(q).collect()} == g.sat(q), q


def products(df):
    """Joins of states with states that have no key, by plan; a product with the colours is none."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Join (?:Inner|Cross)\n", plan))


def test_plans_have_no_products(spark):
    g = graph(random.Random(3))
    made = system(spark, g)
    space = products(Checker(made).verify(f.EX(P) & ~f.EX(f.EX(P))))
    for q in (
        f.exists("x", f.exists("y", ~(f.EX(X) & f.EX(Y)), bound=Q), bound=P),
        f.bind("x", f.bind("y", ~(f.EX(X) & f.EX(Y)))),
        f.forall("x", f.EX(X), bound=P),
        f.exists("x", f.at("x", f.EX(P)) & f.EX(X)),
        f.EX(P) & f.at(2, Q),
    ):
        checker = Checker(made, largest_space=1)  # what isn't one of the above is refused
        got = checker.verify(q)
        assert {(r.state, r.colour) for r in got.collect()} == g.sat(q), q
        assert products(got) <= space + 8, q


def test_many_equivalences(spark):
    """Thirty, one within the other: each side is read once."""
    g = graph(random.Random(8))
    q = f.EX(P)
    for i in range(30):
        q = q.iff((P, Q, f.EX(Q))[i % 3])
    assert len(f.subformulas(q)) < 40
    assert {(r.state, r.colour) for r in Checker(system(spark, g)).verify(q).collect()} == g.sat(q)


def test_what_holds_at_a_state_has_no_state(spark):
    g = graph(random.Random(6))
    checker = Checker(system(spark, g))
    rel = checker.relation(f.canonical(f.at(2, f.EX(P))))
    assert rel.rows.columns == ["colour"] and not rel.negated
    assert checker.relation(f.canonical(~f.at(2, f.EX(P)))).negated
    assert checker.relation(f.canonical(f.EX(P) & f.at(2, f.EX(P)))).columns == {"state"}


def test_two_negations_meet_in_one_join(spark):
    a, b = (spark.createDataFrame(rows, "atx long, state long, colour int") for rows in ([(1, 2, 0), (1, 3, 0)], [(1, 2, 0), (9, 9, 0)]))
    met = signed.either(~Relation(a), ~Relation(b))
    assert met.negated and [tuple(r) for r in met.rows.collect()] == [(1, 2, 0)]
    one = spark.createDataFrame([(2, 0)], "state long, colour int")
    assert signed.both(Relation(one), ~Relation(a)) is None
    lost = signed.both(Relation(a), ~Relation(one))
    assert not lost.negated and [(r.atx, r.state, r.colour) for r in lost.rows.collect()] == [(1, 3, 0)]


AT_X = f.at("x", f.EX(P))
CONSTANT = [
    f.bind("x", f.EX(AT_X)),
    f.bind("x", f.AX(~AT_X, f.up("x"))),
    f.bind("x", f.pEX(AT_X | f.at(2, Q))),
    f.bind("x", f.EwX(AT_X.iff(f.at(1, P)))),
    f.bind("x", f.AF(~AT_X)),
    f.bind("x", f.AwF(AT_X, f.up("x"))),
    f.bind("x", f.EU(AT_X, Q)),
    f.bind("x", f.AU(~AT_X, Q, f.down("y"))),
    f.bind("x", f.EX(f.exists("y", f.at("y", f.EX(P)) & AT_X, bound=Q))),
    f.exists("x", f.EX(AT_X) & X, bound=Q),
]


@pytest.mark.parametrize("seed", range(2))
def test_what_holds_at_one_state_passes_steps_without_pairs(spark, seed):
    """Each would be refused if it met every state."""
    g = graph(random.Random(60 + seed), n=5, colours=2)
    checker = Checker(system(spark, g), largest_space=1)
    for q in CONSTANT:
        assert {(r.state, r.colour) for r in checker.verify(q).collect()} == g.sat(q), q
