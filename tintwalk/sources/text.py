"""Text descriptions of explicit systems: one statement a line, or several with ``;`` between.

``:params a, b`` declares colours, ``:states(1) s, t`` states (the number is a part of the state space), ``:edges s -(a, b)> "x+" t`` edges,
``:atom "p" = [s(a), t]`` where a proposition holds, ``:verify "f"`` and ``:assert "f" == [s]`` what is to be asked and found. Comments are
``#``, ``//`` and ``/* */``, which may nest. A list without colours means all; without ``:params`` there is one colour without a name.

A text is cut into statements where it is read, by a small function; names are then numbered, joined and checked as tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.formula import Formula
from tintwalk.formula_text import parse as parse_formula
from tintwalk.operators.relations import assert_equal
from tintwalk.plans.checker import Checker
from tintwalk.system import ANY, TransitionSystem
from tintwalk.written import cut, ranked

#: The colour of a description that declares none.
UNNAMED = ""

NAME = r"(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]+)"
OUTSIDE, INSIDE = re.compile(r'"[^"\n]*"|/\*|//[^\n]*|#[^\n]*|[;\n]|[^"/#;\n]+|.'), re.compile(r"/\*|\*/|[^/*]+|.", re.S)
STATEMENT = re.compile(r':(params|states|edges|verify|atom|assert)\b\s*(?:\(\s*([0-9]+)\s*\))?\s*(?:"([^"]+)"\s*(==?)?)?(.*)', re.S)
ITEM = re.compile(r'\s*((?:"[^"\n]*"|\([^()]*\)|[^,"()]+)*)(,|$)')
COLOURS = rf"\(\s*({NAME}(?:\s*,\s*{NAME})*)\s*\)"
PLAIN, PLACE = re.compile(rf"({NAME})\s*"), re.compile(rf"({NAME})\s*(?:{COLOURS})?\s*")
EDGE = re.compile(rf'({NAME})\s*-\s*(?:{COLOURS})?\s*>\s*(?:"([^"]+)")?\s*({NAME})\s*')
READ = "array<struct<line: int, kind: string, formula: string, part: int, items: array<struct<a: string, b: string, along: string, named: array<string>>>>>"


def statements(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement) without comments; lines count from 1."""
    at, depth, line, began, held = 0, 0, 1, 1, []
    while at < len(text):
        found = (INSIDE if depth else OUTSIDE).match(text, at)[0]
        at += len(found)
        if found in ("/*", "*/"):
            depth = max(depth + (1 if found == "/*" else -1), 0)
            held.append(" ")
        elif not depth and found in "\n;":
            yield began, "".join(held).strip()
            held, began = [], line + (found == "\n")
        elif not depth and not found.startswith(("#", "//")):
            held.append(found)
        line += found.count("\n")
    yield began, "".join(held).strip() if not depth else "a comment that isn't closed"


def _item(kind: str, text: str) -> tuple | None:
    """(a, b, along, colours) of one item of a statement's list, or None."""
    named = lambda found: re.findall(NAME, found or "")
    if kind == "edges":
        m = EDGE.fullmatch(text)
        return m and (m[1], m[4], m[3], named(m[2]))
    m = (PLAIN if kind in ("params", "states") else PLACE).fullmatch(text)
    return m and (m[1], None, None, named(m[2]) if m.re is PLACE else [])


def _read(line: int, statement: str) -> tuple:
    """A statement as a row of ``READ``; one that can't be read has no kind, and stands in the place of the formula."""
    wrong = line, None, statement, None, []
    m = STATEMENT.fullmatch(statement)
    if not m:
        return wrong
    kind, part, formula, equals, rest = m.groups()
    rest = rest.strip()
    if (part is not None and kind != "states") or equals != {"atom": "=", "assert": "=="}.get(kind) or (formula is None) != (kind in ("params", "states", "edges")):
        return wrong
    if kind == "verify":
        return (line, kind, formula, None, []) if not rest else wrong
    if equals:
        if not (rest.startswith("[") and rest.endswith("]")):
            return wrong
        rest = rest[1:-1].strip()
        if not rest:
            return line, kind, formula, None, []
    items, at = [], 0
    while True:
        m = ITEM.match(rest, at)
        item = m and _item(kind, m[1].strip())
        if not item:
            return wrong
        items.append(item)
        at = m.end()
        if not m[2]:
            return line, kind, formula, int(part or 0), items


def _statements(text: str) -> list[tuple]:
    return [_read(line, s) for line, s in statements(text or "") if s]


@dataclass(frozen=True)
class Description:
    """A system with the names of its states and colours, and what is asserted: ``asserts(formula, state, colour)``, ``asked(formula)``."""

    system: TransitionSystem
    state_names: DataFrame
    colour_names: DataFrame
    parts: DataFrame
    asked: DataFrame
    asserts: DataFrame

    @cached_property
    def checker(self) -> Checker:
        return Checker(self.system)

    def formula(self, text: str) -> Formula:
        """Propositions are those of the description, by their text."""
        return parse_formula(text)

    def named(self, rel: DataFrame) -> DataFrame:
        """``(state, colour)`` by name."""
        states = self.state_names.withColumnRenamed("name", "state_name")
        colours = self.colour_names.withColumnRenamed("name", "colour_name")
        return rel.join(states, "state").join(colours, "colour").select(F.col("state_name").alias("state"), F.col("colour_name").alias("colour"))

    def expected(self, formula: str) -> DataFrame:
        return self.asserts.where(F.col("formula") == formula).where("state is not null").select("state", "colour").distinct()

    def verify(self) -> dict[str, DataFrame]:
        """By name, where each formula of ``:verify`` holds. Formulas share what they have in common."""
        asked = _texts(self.asked)
        found = self.checker.verify({text: self.formula(text) for text in asked})
        return {text: self.named(rel) for text, rel in found.items()}

    def outcomes(self) -> DataFrame:
        """``(formula, holds)`` for each formula of ``:assert``: whether it holds where it is said to and nowhere else."""
        spark, texts = self.asserts.sparkSession, _texts(self.asserts)
        found = self.checker.verify({text: self.formula(text) for text in texts})
        wrong = [_apart(found[text], self.expected(text)).withColumn("formula", F.lit(text)) for text in texts]
        rows = spark.createDataFrame([(text,) for text in texts], "formula string")
        for part in wrong:
            rows = rows.unionByName(part.select("formula").limit(1))
        return rows.groupBy("formula").agg((F.count(F.lit(1)) == 1).alias("holds"))

    def check(self) -> int:
        """Raise AssertionError with the names of what is missing or too many for the first ``:assert`` that fails; else how many there are."""
        texts = _texts(self.asserts)
        found = self.checker.verify({text: self.formula(text) for text in texts})
        for text in texts:
            assert_equal(self.named(found[text]), self.named(self.expected(text)), text)
        return len(texts)


def _texts(formulas: DataFrame) -> list[str]:
    return [row[0] for row in formulas.select("formula").distinct().orderBy("formula").collect()]


def _apart(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def read(spark: SparkSession, path: str) -> Description:
    """The description in the file or files at ``path``; raises ValueError with the statements or names that are wrong, and their lines."""
    return described(spark.read.text(path, wholetext=True))


def parse(spark: SparkSession, text: str) -> Description:
    return described(spark.createDataFrame([(text,)], "value string"))


def described(texts: DataFrame) -> Description:
    """The description in a table of texts, column ``value``."""
    spark = texts.sparkSession
    rows = texts.select(F.input_file_name().alias("file"), F.posexplode(F.udf(_statements, READ, useArrow=False)("value")).alias("at", "s")).select("file", "at", "s.*")
    rows = cut(rows, "statements")
    _refuse(rows.where("kind is null"), "formula", "not a statement")
    of = lambda kind: rows.where(F.col("kind") == kind)
    items = lambda kind, *more: of(kind).select("line", *more, F.explode("items").alias("i")).select("line", *more, "i.*")

    params = items("params").select(F.col("a").alias("name")).distinct()
    if params.isEmpty():
        params = spark.createDataFrame([(UNNAMED,)], "name string")
    colour_names = cut(ranked(params, F.col("name")).select(F.col("rank").cast("int").alias("colour"), "name"), "colours")
    declared = items("states", "part").groupBy(F.col("a").alias("name")).agg(F.max("part").alias("part"))
    state_names = cut(ranked(declared, F.col("name")).select(F.col("rank").alias("state"), "name", "part"), "states")
    located = lambda df: _known(_coloured(df, colour_names), state_names, "a", "state")

    edges = _known(_known(_coloured(items("edges"), colour_names), state_names, "a", "src"), state_names, "b", "dst")
    along = F.regexp_replace(F.coalesce("along", F.lit("")), r"\s", "")
    facet = F.when(along.endswith("+"), "+").when(along.endswith("-"), "-").otherwise(ANY)
    name = F.when(facet != ANY, F.substring(along, F.lit(1), F.length(along) - 1)).alias("dir_name")
    edges = cut(edges.select("src", "dst", name, facet.alias("dir_facet"), "colour").distinct(), "edges")

    key = F.regexp_replace("formula", r"\s", "").alias("atom")
    latest = of("atom").select(key, "line", F.struct("file", "at").alias("at"), "items").groupBy("atom").agg(F.max_by(F.struct("line", "items"), "at").alias("s"))
    atoms = latest.select("atom", "s.line", F.explode("s.items").alias("i")).select("atom", "line", "i.*")
    atoms = located(atoms).select("atom", "state", "colour").distinct()
    full = located(items("assert", "formula")).select("formula", "state", "colour")
    none = F.lit(None)
    empty = of("assert").where(F.size("items") == 0).select("formula", none.cast("long").alias("state"), none.cast("int").alias("colour"))

    system = TransitionSystem(state_names.select("state", "name", "part"), colour_names, edges, cut(atoms, "atoms"))
    asserts = cut(full.unionByName(empty).distinct(), "asserts")
    return Description(system, state_names.select("state", "name"), colour_names, state_names.select("state", "part"), of("verify").select("formula"), asserts)


def _refuse(df: DataFrame, column: str, what: str) -> None:
    """Up to ten wrong items are named, with their lines."""
    if wrong := df.select("line", column).distinct().orderBy("line", column).limit(10).collect():
        raise ValueError(f"{what}: {', '.join(f'{text} (line {line})' for line, text in wrong)}")


def _coloured(df: DataFrame, colour_names: DataFrame) -> DataFrame:
    """A row for each colour of ``named``, all colours where it is empty."""
    some = df.where(F.size("named") > 0).withColumn("name", F.explode("named"))
    _refuse(some.join(colour_names, "name", "left_anti"), "name", "not a declared parameter")
    every = df.where(F.size("named") == 0).crossJoin(colour_names.select("colour"))
    return some.join(colour_names, "name").drop("name", "named").unionByName(every.drop("named"))


def _known(df: DataFrame, state_names: DataFrame, column: str, into: str) -> DataFrame:
    found = state_names.select(F.col("state").alias(into), F.col("name").alias(column))
    _refuse(df.join(found, column, "left_anti"), column, "not a declared state")
    return df.join(found, column).drop(column)
