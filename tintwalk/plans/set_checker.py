"""Evaluates formulas over sets of colours: a relation has one row for a state, with the set of colours in which the formula holds there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwalk import formula as f
from tintwalk.functions.colours import Encoding, decoded, encoded, encoding
from tintwalk.operators import sets as s
from tintwalk.system import TransitionSystem
from tintwalk.written import cut


def encoding_of(system: TransitionSystem) -> Encoding:
    """The encoding for a system whose colours are numbers from 0."""
    low, high = system.colours.agg(F.min("colour"), F.max("colour")).first()
    if low is not None and low < 0:
        raise ValueError("sets of colours need colours that are numbered from 0")
    return encoding((high if high is not None else -1) + 1)


class SetChecker:
    """``SetChecker(system).verify(formula)`` is what :class:`tintwalk.plans.checker.Checker` gives, for formulas that name no states but by number.

    It is for systems of many colours: rows that meet, and are shuffled, don't grow with the colours of a state. Equal sub-formulas share one relation.
    """

    def __init__(self, system: TransitionSystem, how: Encoding | None = None):
        self.system, self.how = system, how or encoding_of(system)
        self.rounds: list[tuple[str, int, int]] = []
        self._known: dict[f.Formula, DataFrame] = {}
        self._edges: dict[tuple[f.Direction, bool], DataFrame] = {}

    def verify(self, query: f.Formula) -> DataFrame:
        """``(state, colour)``."""
        return decoded(self.sets(query), self.how, s.SET).select("state", "colour")

    def sets(self, query: f.Formula) -> DataFrame:
        """``(state, colours)``, of states where the formula holds in some colour."""
        return self._relation(f.canonical(query))

    def statistics(self) -> DataFrame:
        """``(fixpoint, round, rows)``, as a checker's."""
        return self.system.states.sparkSession.createDataFrame(self.rounds, "fixpoint string, round int, rows long")

    def edges(self, along: f.Direction, past: bool) -> DataFrame:
        """``(src, dst, colours, going)`` (written): a row for each pair of states, the colours of its edges, and those in which they go along."""
        if (along, past) not in self._edges:
            edges = self.system.reversed().edges if past else self.system.edges
            self._edges[along, past] = cut(s.edges_of(edges, self.how, along.column()), "edges")
        return self._edges[along, past]

    def _going(self, along: f.Direction, past: bool) -> DataFrame:
        return s.some(self.edges(along, past).select("src", "dst", F.col("going").alias(s.SET)), self.how)

    def _relation(self, q: f.Formula) -> DataFrame:
        if q not in self._known:
            self._known[q] = self._made(q)
        return self._known[q]

    def _made(self, q: f.Formula) -> DataFrame:
        system, how = self.system, self.how
        every = s.full(system.states.select("state").distinct(), how)
        match q:
            case f.Truth(value):
                return every if value else every.where(F.lit(False))
            case f.Atom(name):
                if system.atoms is None:
                    return every.where(F.lit(False))
                return encoded(system.atoms.where(F.regexp_replace("atom", r"\s+", "") == name).select("state", "colour"), how, s.SET)
            case f.Where(condition):
                return s.full(system.states.where(F.expr(condition)), how)
            case f.Step(along, incoming):
                return encoded(system.edges.where(along.column()).select(F.col("dst" if incoming else "src").alias("state"), "colour"), how, s.SET)
            case f.Var(name) if isinstance(name, int):
                return every.where(F.col("state") == name)
            case f.Not(inner):
                return s.less(every, self._relation(inner), how)
            case f.And(left, f.Not(right)) | f.And(f.Not(right), left):
                return s.less(self._relation(left), self._relation(right), how)
            case f.And(left, right):
                return s.both(self._relation(left), self._relation(right), how)
            case f.Or(left, right):
                return s.either(self._relation(left), self._relation(right), how)
            case f.Iff(left, right):
                return s.less(every, s.apart(self._relation(left), self._relation(right), how), how)
            case f.Next(every_edge, past, inner, along):
                rel = self._relation(inner)
                return s.every_next(rel, self.edges(along, past), how) if every_edge else s.some_next(rel, self._going(along, past), how)
            case f.Until(every_edge, past, path, goal, along, weak):
                held, rel = None if path == f.TRUE else self._relation(path), self._relation(goal)
                out = self.edges(along, past).withColumnRenamed("src", "state")
                if weak and every_edge:
                    rel = s.either(rel, s.less(every, s.merged(out.select("state", F.col("going").alias(s.SET)), how), how), how)
                elif weak:
                    rel = s.either(rel, s.merged(s.some(out.select("state", how.less(F.col(s.SET), F.col("going")).alias(s.SET)), how), how), how)
                if every_edge:
                    return s.every_until(held, rel, self.edges(along, past), how, self.rounds)
                return s.exists_until(held, rel, self._going(along, past), how, self.rounds)
        raise ValueError(f"{type(q).__name__} isn't evaluated over sets of colours")
