"""Evaluates formulas over a transition system: each becomes a relation ``(state, colour)``, by way of one relation per sub-formula.

Relations of sub-formulas have a sign, and a state only if it matters (see :mod:`tintwalk.operators.signed`). They are built as rows with all their columns where a temporal
operator reads them, and at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwalk import formula as f
from tintwalk.operators import relations as r
from tintwalk.operators import components, signed
from tintwalk.operators import temporal as t
from tintwalk.operators.signed import COLOUR, STATE, Relation
from tintwalk.system import TransitionSystem
from tintwalk.written import cut, dropped, noted

#: Rows that a table of all pairs, triples and so on of states may have, which a negation over open names needs if a temporal operator reads it.
LARGEST_SPACE = 10**12


def _column(name: str) -> str:
    return f"at{name}"


class Checker:
    """``Checker(system).verify(formula)`` gives the (state, colour) at which it holds.

    Sub-formulas that are equal up to the names of bound states share one relation, within a formula and among all formulas of a checker. A step or quantifier that several
    formulas of a call read is written once. ``with Checker(system) as checker`` deletes what was written at its end, when all answers must have been read.
    """

    def __init__(self, system: TransitionSystem, largest_space: int = LARGEST_SPACE):
        self.system, self._given, self.largest_space = system, system, largest_space
        self.rounds: list[tuple[str, int, int]] = []
        self._known: dict[f.Formula, Relation] = {}
        self._built: dict[f.Formula, DataFrame] = {}
        self._past: TransitionSystem | None = None
        self._sizes: tuple[int, int] | None = None
        self._written = False
        self._readers: Counter[f.Formula] = Counter()
        self.paths: list[str] = []

    def __enter__(self) -> Checker:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete the tables written so far; relations that were given out can't be read any more."""
        dropped(self.system.states.sparkSession, self.paths)
        for held in (self.paths, self._known, self._built):
            held.clear()
        self.system, self._past, self._written = self._given, None, False

    def verify(self, query: f.Formula | Mapping[str, f.Formula]) -> DataFrame | dict[str, DataFrame]:
        with noted(self.paths):
            if isinstance(query, Mapping):
                self._keep(query.values())
                return {name: self._verified(q) for name, q in query.items()}
            self._keep([query])
            return self._verified(query)

    def _verified(self, query: f.Formula) -> DataFrame:
        if names := sorted(f.free(query)):
            raise ValueError(f"states that are bound nowhere: {', '.join(names)}")
        self._declared(query)
        return self.rows(f.canonical(query)).select(*r.KEY)

    def _keep(self, queries: Collection[f.Formula]) -> None:
        """A system whose edges several jobs read is written, so that what it is made from isn't worked out each time; within a job Spark reads once what is the same."""
        parts = set().union(*(f.subformulas(f.canonical(q)) for q in queries))
        self._readers = Counter(part for whole in parts for part in whole.parts()) + Counter(map(f.canonical, queries))
        readers = {part for part in parts if isinstance(part, f.Next | f.Until | f.Step)}
        twice = lambda part: getattr(part, "weak", False) or (isinstance(part, f.Next) and part.every)
        reads = sum(2 if twice(part) else 1 for part in readers - set(self._known))
        jobs = sum(isinstance(part, f.Until) for part in parts) + len(queries)
        if not self._written and reads > 1 and jobs > 1:
            self.system = replace(self.system, states=cut(self.system.states, "states"), edges=cut(self.system.edges, "edges"))
            self._past, self._written = None, True

    def _declared(self, query: f.Formula) -> None:
        """``at`` a state that isn't there would hold nowhere, and its negation nowhere too; so it is refused."""
        wanted = sorted({q.name for q in f.subformulas(query) if isinstance(q, f.At) and isinstance(q.name, int)})
        if wanted:
            known = {row[0] for row in self.system.states.where(F.col("state").isin(wanted)).select("state").distinct().collect()}
            if missing := [str(name) for name in wanted if name not in known]:
                raise ValueError(f"not a state: {', '.join(missing)}")

    def statistics(self) -> DataFrame:
        """``(fixpoint, round, rows)``: rows that each round of each fixpoint so far has added."""
        return self.system.states.sparkSession.createDataFrame(self.rounds, "fixpoint string, round int, rows long")

    def relation(self, q: f.Formula) -> Relation:
        if q not in self._known:
            rel = self._made(q)
            if self._readers[q] > 1 and isinstance(q, f.Next | f.Exists | f.Iff):  # fixpoints are written anyway
                rel = Relation(cut(rel.rows, "shared"), rel.negated)
            self._known[q] = rel
        return self._known[q]

    def rows(self, q: f.Formula) -> DataFrame:
        """``(names..., state, colour)``."""
        if q not in self._built:
            rel = self.relation(q)
            self._built[q] = self._with(rel, rel.columns | {STATE})
        return self._built[q]

    def _with(self, rel: Relation, columns: set[str]) -> DataFrame:
        """Rows of ``rel`` with all of ``columns``: any state for those that it lacks."""
        if not rel.negated and rel.columns == columns:
            return signed.ordered(rel.rows, columns)
        lacking = columns - (set() if rel.negated else rel.columns)
        if len(columns) > 1 and lacking:
            states, colours = self._count()
            if rel.negated:
                self._allow(states ** len(columns) * colours, f"a negation over {len(columns) - (STATE in columns)} open names")
            else:
                rel = Relation(cut(rel.rows, "rows"))
                self._allow(rel.rows.count() * states ** len(lacking), "what holds for any state")
        space = self.system.colours.select(COLOUR) if rel.negated else rel.rows
        for column in sorted(lacking):
            space = space.crossJoin(self.system.states.select(F.col(STATE).alias(column)))
        if rel.negated:
            space = space.join(rel.rows, [*sorted(rel.columns), COLOUR], "left_anti")
        return signed.ordered(space, columns)

    def _flow(self, past: bool) -> DataFrame:
        if not past:
            return self.system.edges
        self._past = self._past or self.system.reversed()
        return self._past.edges

    def _count(self) -> tuple[int, int]:
        self._sizes = self._sizes or (self.system.states.count(), self.system.colours.count())
        return self._sizes

    def _allow(self, rows: int, what: str) -> None:
        if rows > self.largest_space:
            raise ValueError(f"{what} would have {rows} rows; bound the names, or raise largest_space")

    def _made(self, q: f.Formula) -> Relation:
        system, states = self.system, self.system.states
        match q:
            case f.Truth(value):
                return Relation(r.nothing(system.colours.select(COLOUR)), negated=value)
            case f.Atom(name):
                if system.atoms is None:
                    return Relation(r.nothing(system.space()))
                return Relation(system.atoms.where(F.regexp_replace("atom", r"\s+", "") == name).select(*r.KEY).distinct())
            case f.Where(condition):
                return Relation(states.where(F.expr(condition)).select(STATE).crossJoin(system.colours.select(COLOUR)))
            case f.Step(along, incoming):
                edges = system.edges.where(along.column())
                return Relation(t.targets(edges) if incoming else t.sources(edges))
            case f.Var(name):
                if isinstance(name, int):
                    return Relation(system.space().where(F.col(STATE) == name))
                return Relation(system.space().select(F.col(STATE).alias(_column(name)), *r.KEY))
            case f.Not(inner):
                return ~self.relation(inner)
            case f.And(left, right):
                a, b = self.relation(left), self.relation(right)
                return signed.both(a, b) or self._widened(signed.both, a, b)
            case f.Or(left, right):
                a, b = self.relation(left), self.relation(right)
                return signed.either(a, b) or self._widened(signed.either, a, b)
            case f.Iff(left, right):
                a, b = self.relation(left), self.relation(right)
                return signed.same(a, b) or signed.same(*(Relation(self._with(Relation(x.rows), a.columns | b.columns), x.negated) for x in (a, b)))
            case f.Next(every, past, inner, along):
                return Relation((t.every_next if every else t.some_next)(self.rows(inner), self._flow(past), along.column()))
            case f.Until(every, past, path, goal, along, weak):
                held = None if path == f.TRUE else self.rows(path)
                rel, edges = self.rows(goal), self._flow(past)
                if every:
                    return Relation(t.every_until(held, rel, edges, along.column(), states, weak, system.space(), log=self.rounds))
                return Relation(t.exists_until(held, rel, edges, along.column(), states, weak, log=self.rounds))
            case f.Bind(name, f.Until(False, past, f.TRUE, f.Not(f.Until(False, then, f.TRUE, f.Var(other), f.ANYWHERE, False)), f.ANYWHERE, False)) if name == other and past == then:
                return ~Relation(self._stable(past))
            case f.Bind(name, f.Next(False, past, f.Until(False, then, f.TRUE, f.Var(other), f.ANYWHERE, False), f.ANYWHERE)) if name == other and past == then:
                return Relation(self._circles(past))
            case f.Bind(name, inner):
                return signed.bound(self.relation(inner), _column(name))
            case f.At(name, inner):
                return signed.at(self.relation(inner), name if isinstance(name, int) else _column(name))
            case f.Exists(name, bound, inner):
                return self._exists(_column(name), bound, inner)
        raise ValueError(f"not a formula: {q}")

    def _stable(self, past: bool) -> DataFrame:
        """Where all that is reached leads back (``bind x: AG EF x``): in the terminal components, which are told without a row for each pair of states."""
        states, colours = self._count()
        self._allow(states * colours, "the components of all states")
        flow = replace(self.system, edges=self._flow(past))
        return components.terminal_components(flow, self.rounds).select(*r.KEY)

    def _circles(self, past: bool) -> DataFrame:
        """What reaches itself (``bind x: EX EF x``). Where that takes long walks, from the states for which it is open, with chains crossed at once."""
        edges = self._flow(past).select("src", "dst", "colour")
        found, left = components.on_circles(edges, self.rounds)
        if left is None:
            return found
        named = left.select(F.col(STATE).alias("start"), *r.KEY)
        reach = t.exists_until(None, named, edges, F.lit(True), self.system.states, log=self.rounds)
        more = t.some_next(reach, edges, F.lit(True)).where(F.col("start") == F.col(STATE)).select(*r.KEY)
        return found.unionByName(more).distinct()

    def _widened(self, meet: Callable[[Relation, Relation], Relation | None], a: Relation, b: Relation) -> Relation:
        """``meet`` of relations that lack each other's columns: both get any state for them, or the one that would lose rows to the other."""
        columns = a.columns | b.columns
        loses = lambda x: a.negated == b.negated or x.negated == (meet is signed.either)
        return meet(*(Relation(self._with(Relation(x.rows), columns), x.negated) if loses(x) and x.columns != columns else x for x in (a, b)))

    def _exists(self, column: str, bound: f.Formula, inner: f.Formula) -> Relation:
        """Some state of ``bound`` puts a row into ``inner``. The bound's own names stay open."""
        rel, limits = self.relation(inner), None
        if bound != f.TRUE:
            limits = self.rows(bound).withColumnRenamed(STATE, column)
        if not rel.negated:
            return signed.some(rel.rows, column, limits)
        if limits is None:
            limits = self.system.space().withColumnRenamed(STATE, column)
        if column not in rel.columns:
            some = Relation(limits.drop(column).distinct())
            return signed.both(some, rel) or self._widened(signed.both, some, rel)
        names = set(limits.columns) - {COLOUR}
        if rel.columns <= names:
            return signed.some(limits.join(rel.rows, [*sorted(rel.columns), COLOUR], "left_anti"), column, None)
        if names == {column}:  # not all of them are in what is negated
            all_in = signed.every(rel.rows, column, limits)
            idle = self.system.colours.select(COLOUR).join(limits, COLOUR, "left_anti")
            if not idle.isEmpty():  # in a colour without candidates there is none
                rest = self._with(Relation(idle), rel.columns - {column})
                all_in = all_in.unionByName(rest)
            return ~Relation(all_in)
        return signed.some(self._with(rel, rel.columns | names), column, limits)
