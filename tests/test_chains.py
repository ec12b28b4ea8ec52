"""Fixpoints that cross chains at once: against brute force on small graphs, and on long chains by the number of rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import Graph
from tests.test_formulas import HYBRID, TEMPORAL, graph, same, system
from tintwalk import formula as f
from tintwalk.operators import chains, temporal
from tintwalk.operators.components import terminal_components
from tintwalk.plans.checker import Checker
from tintwalk.system import EDGE_SCHEMA, TransitionSystem

LONG = 10_000


@pytest.mark.parametrize("sparse", [True, False])
def test_every_temporal_operator_over_contracted_chains(spark, monkeypatch, sparse):
    monkeypatch.setattr(chains, "PLAIN", 1)
    g = graph(random.Random(31), n=12, colours=2)
    if sparse:  # mostly one way on, circles among them
        left = {}
        for e in sorted(g.edges, key=str):
            left.setdefault((e[0], e[-1]), []).append(e)
        g.edges = {e for at, es in left.items() for e in es[: 1 + (at[0] % 4 == 0)]}
    same(spark, g, Checker(system(spark, g)), *[q for q in TEMPORAL if any(isinstance(p, f.Until) for p in f.subformulas(q))][sparse::2])


def test_open_names_over_contracted_chains(spark, monkeypatch):
    monkeypatch.setattr(chains, "PLAIN", 1)
    g = graph(random.Random(32), n=5, colours=2)
    same(spark, g, Checker(system(spark, g)), *[q for q in HYBRID if any(isinstance(p, f.Until) for p in f.subformulas(q))])


def line(spark, n, closed=False):
    edges = spark.range(n - 1 + closed).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    edges = edges.select("src", "dst", F.lit(None).cast("string").alias("dir_name"), F.lit("TRUE").alias("dir_facet"), F.lit(0).alias("colour"))
    return TransitionSystem(spark.range(n).toDF("state"), spark.range(1).select(F.col("id").cast("int").alias("colour")), edges)


@pytest.mark.parametrize("q", [f.EF(f.where(f"state = {LONG - 1}")), f.AF(f.where(f"state = {LONG - 1}")), f.pEF(f.where("state = 0"))])
def test_long_chain_in_few_rounds(spark, q):
    checker = Checker(line(spark, LONG))
    assert checker.verify(q).count() == LONG
    assert checker.statistics().count() <= 40


def test_long_chain_with_goals_within_and_a_circle(spark):
    checker = Checker(line(spark, 1000))
    assert checker.verify(f.EF(f.where("state in (300, 700)"))).count() == 701
    assert checker.verify(f.EU(f.where("state <> 500"), f.where("state = 999"))).agg(F.min("state"), F.count("*")).first() == (501, 499)
    log = []
    circle = line(spark, 1000, closed=True)
    found = temporal.reach(spark.createDataFrame([(17, 0)], "state long, colour int"), circle.edges, log=log)
    assert found.count() == 1000 and len(log) <= 40


@pytest.mark.parametrize("seed", range(2))
def test_terminal_components_over_contracted_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(chains, "PLAIN", 1)
    g = graph(random.Random(40 + seed), n=9, colours=2)
    reach = {(s, c): {t for t in range(g.n) if (s, c) in Graph(g.n, g.colours, g.edges, {("t", t, c)}).sat(f.EF(f.atom("t")))} for s, c in g.space()}
    want = {(min(reach[s, c]), s, c) for s, c in g.space() if all(s in reach[t, c] for t in reach[s, c])}
    assert {tuple(r) for r in terminal_components(system(spark, g)).collect()} == want


@pytest.mark.parametrize("closed", [False, True])
def test_terminal_components_of_a_long_path_and_a_circle(spark, closed):
    log = []
    found = terminal_components(line(spark, 2000, closed), log)
    assert found.agg(F.min("component"), F.min("state"), F.count("*")).first() == ((0, 0, 2000) if closed else (1999, 1999, 1))
    assert len(log) <= 80


def test_ends_of_chains_and_circles(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 9, 0), (3, 8, 0), (5, 6, 0), (6, 5, 0), (4, 5, 0), (7, 7, 0), (9, 1, 1)], "src long, dst long, colour int")
    low = spark.createDataFrame([(n, c, -n) for n in range(1, 10) for c in range(2)], "src long, colour int, low long")
    made = chains.contracted(edges, "src", "dst", low=low)
    assert {tuple(r) for r in made.rows.select("src", "colour", "end", "low").collect()} == {(1, 0, 3, -2), (2, 0, 3, -2), (4, 0, None, -6), (5, 0, None, -6), (6, 0, None, -6), (9, 1, 1, -9)}
    assert {tuple(r) for r in made.edges.collect()} == {(3, 9, 0), (3, 8, 0), (7, 7, 0)}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_chains_across_batches(spark, size):
    """Trees, circles and lines of which batches of any size hold parts, by brute force; in order of number little is left to double."""
    rng = random.Random(size)
    after = {(i, c): rng.randrange(i + 1, 61) if c else (i + 1) % 60 if i < 40 else rng.randrange(60) for i in range(60) for c in range(2)}
    edges = spark.createDataFrame([(a, b, c) for (a, c), b in after.items()], "src long, dst long, colour int")
    low = spark.createDataFrame([(i, c, (i * 37 + 11) % 60) for i in range(60) for c in range(2)], "src long, colour int, low long")
    stops = spark.createDataFrame([(i, 0) for i in (20, 45)], "src long, colour int")
    inside = {k: b for k, b in after.items() if b != k[0] and k not in {(20, 0), (45, 0)}}
    want = set()
    for (a, c), b in inside.items():
        seen = {a}
        while (b, c) in inside and b not in seen:
            seen.add(b)
            b = inside[b, c]
        want.add((a, c, None if b in seen else b, min((i * 37 + 11) % 60 for i in seen)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        made = chains.contracted(edges, "src", "dst", stops=stops, low=low)
        assert {tuple(r) for r in made.rows.select("src", "colour", "end", "low").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_chain_in_order_leaves_a_row_a_batch(spark):
    made = chains.contracted(line(spark, 50_000).edges.select("src", "dst", "colour"), "src", "dst")
    assert made.rounds[0] == 49_999 and sum(made.rounds[1:]) < 100
    assert made.rows.where("end = 49999").count() == 49_999


def test_what_ends_somewhere_gets_no_labels(spark):
    log = []
    assert [tuple(r) for r in terminal_components(line(spark, 9), log).collect()] == [(8, 8, 0)]
    assert {name for name, _, _ in log} == {"lost"}
