"""Text descriptions, generated cubes, encodings and partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import Graph
from tintwalk import formula as f
from tintwalk import formula_text
from tintwalk.functions.colours import Arrays, Masks, decoded, encoded
from tintwalk.operators import partitioning, relations
from tintwalk.plans.checker import Checker
from tintwalk.sources import text
from tintwalk.sources.cube import Cube
from tintwalk.system import EDGE_SCHEMA, TransitionSystem

TEXT = """/* a lamp /* with two */ settings */
:params dim, bright   # how far it goes
:states(1) off, low; :states high
:edges off -> "x+" low, low -(bright)> "x +" high // only if it may
:edges low -(dim)> low, high -> "x-" off
:atom "level == 2" = [high]
:atom "lit == 1" = []
:atom "lit == 1" = [low, high(bright)]; :verify "EF lit == 1"
:assert "EX lit == 1" == [off, low]
:assert "AG lit == 1" == [low(dim)]
:assert "AX false" == []
:assert "level == 2" == [high(bright, dim)]
:assert "EF{x+} level == 2" == [high, low(bright), off(bright)]
"""


def test_a_description_is_read(spark, tmp_path):
    (tmp_path / "lamp.model").write_text(TEXT)
    lamp = text.read(spark, str(tmp_path / "lamp.model"))
    assert [r.name for r in lamp.state_names.orderBy("state").collect()] == ["high", "low", "off"]
    assert {(r.state, r.part) for r in lamp.parts.collect()} == {(0, 0), (1, 1), (2, 1)}
    assert {tuple(r) for r in lamp.system.edges.collect()} == {(2, 1, "x", "+", 0), (2, 1, "x", "+", 1), (1, 0, "x", "+", 0), (1, 1, None, "TRUE", 1), (0, 2, "x", "-", 0), (0, 2, "x", "-", 1)}
    assert [r.formula for r in lamp.asked.collect()] == ["EF lit == 1"]
    checker = Checker(lamp.system)
    assert {tuple(r) for r in lamp.named(checker.verify(f.atom("level==2"))).collect()} == {("high", "dim"), ("high", "bright")}
    assert relations.equal(checker.verify(f.EX(f.atom("lit == 1"))), lamp.expected("EX lit == 1"))
    assert relations.equal(checker.verify(f.AG(f.FALSE)), lamp.expected("AX false"))
    assert not relations.equal(checker.verify(f.TRUE), lamp.expected("AX false"))
    assert {tuple(r) for r in lamp.named(checker.verify(f.EF(f.atom("level==2"), f.up("x")))).collect()} == {("high", "dim"), ("high", "bright"), ("low", "bright"), ("off", "bright")}


def test_one_colour_without_a_name(spark):
    pair = text.parse(spark, ":states s, t\n:edges s -> t, t -> t")
    assert pair.system.colours.count() == 1
    assert Checker(pair.system).verify(f.AF(f.var(1))).count() == 2


@pytest.mark.parametrize("wrong, what", [(":states a\n:edges a -> b", "declared state: b"), (":params p\n:states a\n:edges a -(q)> a", "declared parameter: q"), (":states a\n:edgy a", "not a statement")])
def test_wrong_descriptions(spark, wrong, what):
    with pytest.raises(ValueError, match=what):
        text.parse(spark, wrong)


def test_statements_and_their_lines(spark):
    long = "/* a // b\n * c */ :states a; # d\n\n:edges a -> \"x // +\" b /* e\n /* f */ g */ ; :edges b\n:verify \"p # q\"//r"
    assert [x for x in text.statements(long) if x[1]] == [(1, ":states a"), (4, ':edges a -> "x // +" b'), (5, ":edges b"), (6, ':verify "p # q"')]
    with pytest.raises(ValueError, match=r"not a statement: :edges b \(line 3\), a comment"):
        text.parse(spark, ":states a\n\n:edges b\n/* no end")
    with pytest.raises(ValueError, match=r"not a declared state: b \(line 2\), c \(line 4\)"):
        text.parse(spark, ":states a\n:edges a -> b\n\n:edges a -> c")
    for wrong in (":params(1) a", ":states a,", ":states é", ":states 1a", ":atom p = [a]", ':atom "p" == [a]', ':assert "p" = [a]', ':verify "p" a', ":edges a -()> b", ':states "a" b'):
        with pytest.raises(ValueError, match="not a statement"):
            text.parse(spark, f":states a, b\n{wrong}")


def test_names_with_digits_and_many_names(spark):
    """Names that end in digits, numbers for names, and 20,000 states in one line."""
    many = text.parse(spark, ":states a1, b1, 0, 17, q0\n:states " + ", ".join(f"s{i}" for i in range(20_000)) + "\n:edges a1 -> b1, 17 -> 0" + "".join(f"\n:edges s{i} -> s{i + 1}" for i in range(300)))
    assert many.state_names.count() == 20_005
    names = {r.state: r.name for r in many.state_names.where("name in ('a1', 'b1', '0', '17', 's0', 's1')").collect()}
    assert {(names[r.src], names[r.dst]) for r in many.system.edges.collect() if {r.src, r.dst} <= set(names)} >= {("a1", "b1"), ("17", "0"), ("s0", "s1")}
    assert many.system.edges.count() == 302


def test_a_description_is_asked_and_checked(spark):
    lamp = text.parse(spark, TEXT)
    assert {tuple(r) for r in lamp.verify()["EF lit == 1"].collect()} == {(s, c) for s in ("off", "low", "high") for c in ("dim", "bright")}
    held = {r.formula: r.holds for r in lamp.outcomes().collect()}
    assert held == {"EX lit == 1": True, "AG lit == 1": True, "AX false": True, "level == 2": True, "EF{x+} level == 2": True}
    assert lamp.check() == 5
    wrong = text.parse(spark, TEXT + ':assert "AX lit == 1" == [off(dim), high]')
    assert not {r.formula: r.holds for r in wrong.outcomes().collect()}["AX lit == 1"]
    with pytest.raises(AssertionError, match=r"AX lit == 1: too many \(3\): .*low.*; missing \(2\): .*high"):
        wrong.check()


#: A ticket of a help desk, from (source, direction, target): strict desks review all work, loose ones let a ticket be dropped.
STATES = ("done", "dropped", "fresh", "parked", "review", "sorted", "work")  # in order of their numbers
MOVES = {
    "strict, loose": [("fresh", "age+", "sorted"), ("sorted", "age+", "work"), ("work", "age+", "parked"), ("parked", "age-", "work"), ("done", None, "done")],
    "strict": [("work", "age+", "review"), ("review", "age-", "work"), ("review", "age+", "done")],
    "loose": [("work", "age+", "done"), ("sorted", "age-", "dropped"), ("parked", "age-", "dropped")],
}
HOLDS = {
    "open == 1": {"fresh": "strict, loose", "sorted": "strict, loose", "work": "strict, loose", "parked": "strict, loose", "review": "strict"},
    "closed == 1": {"done": "strict, loose", "dropped": "loose"},
    "owner >= 1": {"work": "strict, loose", "review": "strict", "parked": "loose"},
}
TICKET_FORMULAS = [
    "AG (open == 1 -> EF closed == 1)",
    "owner>=1 AU closed == 1",
    "EwX closed == 1 && EX true",
    "EX{age+} owner >= 1 && !EX{age-} true",
    "bind here: AX AF here",
    "bind here: EX{!age-} EF here && open == 1",
    "exists t in closed == 1: EF t && !EX t",
    "forall t in owner >= 1: EF (t || closed == 1)",
    "forall t in closed == 1: open == 1 EU t",
    "at 6: EX owner >= 1",
    "exists t: (at t: closed == 1) && EX EX t",
    "pEF{age+} (open == 1 && !owner >= 1) && !pEX owner >= 1",
    "pAX open == 1 <-> open == 1",
    "AwF{age+} closed == 1",
    "EG owner >= 1 || pAG open == 1",
    "age:in+ && !age:out- || age : out +",
    "forall y in (bind z: EX EF z): EF y",
    "exists y in (bind z: EX EF z): EF y && !closed == 1",
]


def ticket():
    """The description without assertions, and the same graph for the evaluator."""
    of = {"loose": 0, "strict": 1}  # by name
    lines, edges, atoms = [":params strict, loose", ":states " + ", ".join(reversed(STATES))], set(), set()
    for colours, moves in MOVES.items():
        for a, way, b in moves:
            lines.append(f":edges {a} -({colours})> " + (f'"{way[:-1]} {way[-1]}" ' if way else "") + b)
            edges |= {(STATES.index(a), STATES.index(b), way and way[:-1], way[-1] if way else "TRUE", of[c]) for c in colours.split(", ")}
    for atom, where in HOLDS.items():
        lines.append(f':atom "{atom}" = [' + ", ".join(f"{state}({colours})" for state, colours in where.items()) + "]")
        atoms |= {(atom.replace(" ", ""), STATES.index(state), of[c]) for state, colours in where.items() for c in colours.split(", ")}
    for facet in "+-":
        for side, k in (("in", 1), ("out", 0)):
            atoms |= {(f"age:{side}{facet}", e[k], e[4]) for e in edges if e[2:4] == ("age", facet)}
            lines.append(f':atom "age:{side}{facet}" = [' + ", ".join(f"{STATES[s]}({['loose', 'strict'][c]})" for a, s, c in sorted(atoms) if a == f"age:{side}{facet}") + "]")
    return "\n".join(lines), Graph(len(STATES), 2, edges, atoms)


def test_a_ticket_is_asserted(spark):
    """Assertions as text, of what the evaluator answers on the same graph; a wrong one fails."""
    told, graph = ticket()
    for asked in TICKET_FORMULAS:
        found = graph.sat(formula_text.parse(asked))
        listed = [f"{STATES[s]}({['loose', 'strict'][c]})" for s, c in sorted(found)]
        told += f'\n:assert "{asked}" == [{", ".join(listed)}]'
    assert text.parse(spark, told).check() == len(TICKET_FORMULAS)
    with pytest.raises(AssertionError, match="EX closed==1|EX closed == 1"):
        text.parse(spark, told + '\n:assert "EX closed == 1" == [fresh]').check()


def test_relations_by_hand(spark):
    colours = spark.createDataFrame([(0,), (1,), (1,)], "colour int")
    rows = lambda df: sorted(map(tuple, df.select("state", "colour").collect()))
    assert rows(relations.of_range(spark, 3, 4, colours)) == [(3, 0), (3, 1), (4, 0), (4, 1)]
    assert rows(relations.of_range(spark, 3, 2, colours)) == []
    assert rows(relations.of_state(spark, 7, colours)) == [(7, 0), (7, 1)]
    assert rows(relations.of_map(spark, {1: [2, 2], 5: [], 4: {0, 3}})) == [(1, 2), (4, 0), (4, 3)]
    assert rows(relations.of_map(spark, {})) == []
    a, b = relations.of_map(spark, {1: [0, 1]}), relations.of_map(spark, {1: [1], 2: [2]})
    relations.assert_equal(a, a.unionByName(a))
    with pytest.raises(AssertionError, match=r"p: too many \(1\): \(1, 0\); missing \(1\): \(2, 2\)"):
        relations.assert_equal(a, b, "p")


def test_connectives_over_many_states(spark):
    """Random connectives over propositions by the digits of a state, in six colours, against sets."""
    rng, n, colours = random.Random(12), 1500, 6
    rules = {
        "ones": lambda s, c: bin(s).count("1") > c + 2,
        "ends": lambda s, c: str(s)[-1] == str(c),
        "square": lambda s, c: math.isqrt(s - c) ** 2 == s - c if s >= c else c == 5,
    }
    g = Graph(n, colours, set(), {(name, s, c) for name, rule in rules.items() for s in range(n) for c in range(colours) if rule(s, c)})
    atoms = spark.createDataFrame(sorted(g.atoms), "atom string, state long, colour int")
    states, some = spark.range(n).withColumnRenamed("id", "state"), spark.createDataFrame([(c,) for c in range(colours)], "colour int")
    checker = Checker(TransitionSystem(states, some, spark.createDataFrame([], EDGE_SCHEMA), atoms))

    def drawn(depth):
        if not depth:
            return f.atom(rng.choice(list(rules)))
        a, b = drawn(depth - 1), drawn(depth - 1)
        return rng.choice([a & b, a | b, ~a, a.implies(b), a.iff(b), a & ~b])

    for _ in range(12):
        asked = drawn(rng.randint(1, 4))
        assert {tuple(r) for r in checker.verify(asked).collect()} == g.sat(asked), asked


def test_long_chain(spark):
    cube = Cube(1, 24)
    checker = Checker(cube.system(spark).restricted_to(spark.createDataFrame([(0,), (12,)], "colour int")))
    found = {}
    for r in checker.verify(f.EF(f.where(cube.upper_corner))).collect():
        found.setdefault(r.colour, set()).add(r.state)
    assert found == {0: set(range(24)), 12: set(range(12, 24))}


@pytest.mark.parametrize("dims, size", [(1, 1), (2, 2), (3, 3), (2, 4), (4, 2)])
def test_closed_forms_on_cubes(spark, dims, size):
    cube = Cube(dims, size)
    checker = Checker(cube.system(spark))
    upper, border, half = f.where(cube.upper_corner), f.where(cube.border), f.where(cube.upper_half)
    owned = {tuple(r) for r in cube.owned(spark).collect()}
    of = lambda q: {tuple(r) for r in checker.verify(q).collect()}
    top, edge, high = of(upper), of(border), of(half)
    assert of(f.EF(f.where(cube.lower_corner))) == of(f.where(cube.lower_corner))
    assert of(f.EF(upper)) == of(f.AF(upper)) == top | owned
    assert of(f.EF(border)) == of(f.AF(border)) == edge | owned
    assert of(f.EU(f.FALSE, border)) == of(f.AU(f.FALSE, border)) == edge
    assert of(f.EU(border, upper)) == top | owned & edge
    assert of(f.AU(half, upper)) == top | owned & high


def test_next_on_a_chain_of_a_thousand(spark):
    """A thousand states in 1,001 colours: one step from the upper half, counted by its definition."""
    cube = Cube(1, 1000)
    found = Checker(cube.system(spark)).verify(f.EX(f.where(cube.upper_half)))
    # a state owns colour 0 and those up to itself, and goes up in these, but for the last; it stays in the others
    want = sum((s + 1 if 499 <= s < 999 else 0) + (1000 - s if s >= 500 else 0) for s in range(1000))
    assert found.count() == want
    assert {r.state for r in found.where("colour = 400").select("state").collect()} == set(range(499, 999))
    assert {r.state for r in found.where("colour = 700").select("state").collect()} == set(range(500, 999))


@pytest.mark.parametrize("how", [Masks(5), Arrays(tuple(range(5)))])
def test_sets_of_colours(spark, how):
    sets = [set(), {0}, {1, 3}, {0, 1, 2, 3, 4}, {4}]
    rows = spark.createDataFrame([(i, c) for i, s in enumerate(sets) for c in s], "state long, colour int")
    held = encoded(rows, how, "a")
    assert {tuple(r) for r in decoded(held, how, "a").select("state", "colour").collect()} == {(i, c) for i, s in enumerate(sets) for c in s}
    pairs = held.crossJoin(held.select(F.col("state").alias("other"), F.col("a").alias("b")))
    a, b = F.col("a"), F.col("b")
    tests = pairs.select("state", "other", *[F.sort_array(how.colours(x)).alias(n) for n, x in (("both", how.both(a, b)), ("either", how.either(a, b)), ("other_a", how.other(a)))], how.has_more(a, b).alias("more"), how.same(a, b).alias("same"), how.is_some(how.both(a, b)).alias("some"))
    for r in tests.collect():
        x, y = sets[r.state], sets[r.other]
        assert (set(r.both), set(r.either), set(r.other_a)) == (x & y, x | y, set(range(5)) - x)
        assert (r.more, r.same, r.some) == (bool(x - y), x == y, bool(x & y))
    assert set(held.agg(F.sort_array(how.colours(how.union(a))).alias("u")).first().u) == set(range(5))


def test_masks_hold_63_colours():
    with pytest.raises(ValueError, match="63"):
        Masks(64)


def test_parts_of_the_state_space(spark):
    states = spark.range(10).withColumnRenamed("id", "state")
    s = F.col("state")
    rows = states.select(partitioning.hashed(s, 3), partitioning.uniform(s, 3, 10), partitioning.intervals(s, [(0, 2), (2, 7)]), partitioning.blocks(s, 2, 10, 5), partitioning.blocks(s, 2, 10, 20), partitioning.single(s)).collect()
    for i, r in enumerate(rows):
        assert tuple(r) == (i % 3, i // 4, 0 if i <= 2 else 1 if i <= 7 else -1, i // 2 % 2, i % 2, 0)
