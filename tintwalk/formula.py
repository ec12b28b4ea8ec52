"""Formulas as Python values, and the functions that build them.

``EF(atom("p")) & ~AX(atom("q"))``; ``EU(p, q)``; ``bind("x", AG(EF(var("x"))))``; ``exists("x", p, bound=q)``; past operators are ``pEX(p)`` and so on.
Temporal operators take ``along=`` a direction formula: ``EX(p, along=up("x") | down("y"))``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwalk.system import NEGATIVE, POSITIVE


@dataclass(frozen=True)
class Direction:
    """A condition on the direction of an edge; a loop's direction meets no proposition."""

    kind: str
    parts: tuple = ()

    def __and__(self, other):
        return Direction("and", (self, other))

    def __or__(self, other):
        return Direction("or", (self, other))

    def __invert__(self):
        return Direction("not", (self,))

    def implies(self, other):
        return ~self | other

    def iff(self, other):
        return (self & other) | (~self & ~other)

    def column(self) -> Column:
        match self.kind:
            case "any":
                return F.lit(True)
            case "loop":  # can be written, but meets nothing
                return F.lit(False)
            case "step":
                name, facet = self.parts
                return F.coalesce((F.col("dir_name") == name) & (F.col("dir_facet") == facet), F.lit(False))
            case "not":
                return ~self.parts[0].column()
            case "and":
                return self.parts[0].column() & self.parts[1].column()
            case "or":
                return self.parts[0].column() | self.parts[1].column()
        raise ValueError(f"no direction is called {self.kind}")


ANYWHERE, LOOPING = Direction("any"), Direction("loop")


def up(name: str) -> Direction:
    return Direction("step", (name, POSITIVE))


def down(name: str) -> Direction:
    return Direction("step", (name, NEGATIVE))


@dataclass(frozen=True)
class Formula:
    def __and__(self, other: Formula) -> Formula:
        return And(self, other)

    def __or__(self, other: Formula) -> Formula:
        return Or(self, other)

    def __invert__(self) -> Formula:
        return Not(self)

    def implies(self, other: Formula) -> Formula:
        return Or(Not(self), other)

    def iff(self, other: Formula) -> Formula:
        return Iff(self, other)

    def parts(self) -> list[Formula]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Formula)]


@dataclass(frozen=True)
class Truth(Formula):
    value: bool


@dataclass(frozen=True)
class Atom(Formula):
    """A proposition of the atom table."""

    name: str


@dataclass(frozen=True)
class Where(Formula):
    """A condition on the attributes of a state, as a SQL expression."""

    condition: str


@dataclass(frozen=True)
class Step(Formula):
    """States with an edge that comes in or goes out in a direction."""

    along: Direction
    incoming: bool


@dataclass(frozen=True)
class Var(Formula):
    """The state that a name is bound to, or the state of a number."""

    name: str | int


@dataclass(frozen=True)
class Not(Formula):
    inner: Formula


@dataclass(frozen=True)
class And(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Or(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Iff(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Next(Formula):
    every: bool
    past: bool
    inner: Formula
    along: Direction = ANYWHERE


@dataclass(frozen=True)
class Until(Formula):
    """``path`` until ``goal``. ``weak`` also takes for a goal where the directions leave no way on (some way off, for one path)."""

    every: bool
    past: bool
    path: Formula
    goal: Formula
    along: Direction = ANYWHERE
    weak: bool = False


@dataclass(frozen=True)
class Exists(Formula):
    name: str
    bound: Formula
    inner: Formula


@dataclass(frozen=True)
class Bind(Formula):
    name: str
    inner: Formula


@dataclass(frozen=True)
class At(Formula):
    name: str | int
    inner: Formula


TRUE, FALSE = Truth(True), Truth(False)


def atom(name: str) -> Formula:
    """Names are equal up to white space."""
    return Atom(re.sub(r"\s+", "", name))


def where(condition: str) -> Formula:
    return Where(condition)


def steps_in(along: Direction) -> Formula:
    return Step(along, True)


def steps_out(along: Direction) -> Formula:
    return Step(along, False)


def var(name: str | int) -> Formula:
    return Var(name)


def bind(name: str, inner: Formula) -> Formula:
    return Bind(name, inner)


def at(name: str | int, inner: Formula) -> Formula:
    return At(name, inner)


def exists(name: str, inner: Formula, bound: Formula = TRUE) -> Formula:
    """The bound is read outside the scope of ``name``, at the state that ``name`` takes."""
    return Exists(name, bound, inner)


def forall(name: str, inner: Formula, bound: Formula = TRUE) -> Formula:
    return Not(Exists(name, bound, Not(inner)))


def _next(every: bool, past: bool, weak: bool):
    def build(inner: Formula, along: Direction = ANYWHERE) -> Formula:
        return Not(Next(not every, past, Not(inner), along)) if weak else Next(every, past, inner, along)

    return build


def _future(every: bool, past: bool, weak: bool):
    def build(inner: Formula, along: Direction = ANYWHERE) -> Formula:
        return Until(every, past, TRUE, inner, along, weak and (every or along != ANYWHERE))

    return build


def _globally(every: bool, past: bool):
    def build(inner: Formula, along: Direction = ANYWHERE) -> Formula:
        return Not(Until(not every, past, TRUE, Not(inner), along, along != ANYWHERE))

    return build


def _until(every: bool, past: bool):
    def build(path: Formula, goal: Formula, along: Direction = ANYWHERE) -> Formula:
        return Until(every, past, path, goal, along)

    return build


EX, AX, EwX, AwX = _next(False, False, False), _next(True, False, False), _next(False, False, True), _next(True, False, True)
EF, AF, EwF, AwF = _future(False, False, False), _future(True, False, False), _future(False, False, True), _future(True, False, True)
EG, AG, EU, AU = _globally(False, False), _globally(True, False), _until(False, False), _until(True, False)
pEX, pAX, pEwX, pAwX = _next(False, True, False), _next(True, True, False), _next(False, True, True), _next(True, True, True)
pEF, pAF, pEwF, pAwF = _future(False, True, False), _future(True, True, False), _future(False, True, True), _future(True, True, True)
pEG, pAG, pEU, pAU = _globally(False, True), _globally(True, True), _until(False, True), _until(True, True)


def subformulas(f: Formula) -> set[Formula]:
    return {f}.union(*map(subformulas, f.parts()))


@cache
def free(f: Formula) -> frozenset[str]:
    """Names of states that ``f`` leaves open."""
    match f:
        case Var(name):
            return frozenset([name] if isinstance(name, str) else [])
        case Bind(name, inner):
            return free(inner) - {name}
        case At(name, inner):
            return free(inner) | ({name} if isinstance(name, str) else set())
        case Exists(name, bound, inner):
            return free(bound) | (free(inner) - {name})
    return frozenset().union(*map(free, f.parts()))


@cache
def _depth(f: Formula) -> int:
    """Binders that are nested in ``f``."""
    return max([0, *map(_depth, f.parts())]) + isinstance(f, Bind | Exists)


def _renamed(f: Formula, old: str, new: str) -> Formula:
    if old not in free(f):
        return f
    match f:
        case Var() | At() if f.name == old:
            f = replace(f, name=new)
        case Exists(name, bound, _) if name == old:
            return replace(f, bound=_renamed(bound, old, new))
    return replace(f, **{x.name: _renamed(v, old, new) for x in fields(f) if isinstance(v := getattr(f, x.name), Formula)})


def _anywhere(f: Formula) -> bool:
    """Whether ``f``, canonical and no constant, holds at all states or at none, so that no step and no path changes it."""
    match f:
        case At():
            return True
        case Not() | And() | Or() | Iff():
            return all(map(_anywhere, f.parts()))
        case Exists():  # the bound is read where the name is
            return _anywhere(f.inner)
    return False


def canonical(f: Formula) -> Formula:
    """``f`` with bound names chosen by how many binders they hold, so that formulas that differ in names alone are equal.

    Binders move inside connectives, where they cost less: a bound name in ``bind`` and ``at`` never needs all pairs of states for a negation.
    What holds at all states or at none moves out of steps and paths, which would pair it with every state.
    """
    f = replace(f, **{x.name: canonical(v) for x in fields(f) if isinstance(v := getattr(f, x.name), Formula)})
    match f:
        case Bind(name, inner) if name not in free(inner):
            return inner
        case Bind(name, Var(other)) if name == other:
            return TRUE
        case Bind(name, At(other, inner)) if name == other:
            return canonical(Bind(name, inner))
        case Next(inner=inner) if _anywhere(inner):
            return And(replace(f, inner=TRUE), inner)
        case Until(goal=goal) if _anywhere(goal):
            return Or(canonical(replace(f, goal=FALSE)), goal) if f.weak else goal
        case Until(path=path) if _anywhere(path):
            now = canonical(replace(f, path=FALSE)) if f.weak else f.goal
            return canonical(Or(now, And(path, replace(f, path=TRUE))))
        case Bind(_, Not(inner)) | At(_, Not(inner)):
            return Not(canonical(replace(f, inner=inner)))
        case Bind(_, And(a, b)) | At(_, And(a, b)):
            return And(canonical(replace(f, inner=a)), canonical(replace(f, inner=b)))
        case Bind(_, Or(a, b)) | At(_, Or(a, b)):
            return Or(canonical(replace(f, inner=a)), canonical(replace(f, inner=b)))
        case Bind(_, Iff(a, b)) | At(_, Iff(a, b)):
            return Iff(canonical(replace(f, inner=a)), canonical(replace(f, inner=b)))
        case Not(Not(inner)):
            return inner
        case Not(Truth(value)):
            return Truth(not value)
        case And(Truth(value), other) | And(other, Truth(value)):
            return other if value else FALSE
        case Or(Truth(value), other) | Or(other, Truth(value)):
            return TRUE if value else other
        case Iff(Truth(value), other) | Iff(other, Truth(value)):
            return other if value else canonical(Not(other))
    if isinstance(f, Bind | Exists):
        new = f"#{_depth(f.inner)}"
        f = replace(f, name=new, inner=_renamed(f.inner, f.name, new))
    return f
