"""Sets of real parameters against sets of the stretches between their ends."""

import random

import pytest
from pyspark.sql import functions as F

from tintwalk.functions.intervals import TYPE, Intervals
from tintwalk.operators import sets

HOW = Intervals(0, 20)


def stretches(intervals):
    """Half-unit stretches of a list of intervals, which must be sorted and apart."""
    pairs = [(x.low, x.high) for x in intervals]
    assert all(a < b for a, b in pairs) and all(p[1] < q[0] for p, q in zip(pairs, pairs[1:], strict=False))
    return {k for a, b in pairs for k in range(round(2 * a), round(2 * b))}


def drawn(rng, n):
    ends = sorted(rng.sample(range(41), 2 * n))
    return [(a / 2, b / 2) for a, b in zip(ends[::2], ends[1::2], strict=True)]


def test_algebra(spark):
    rng = random.Random(4)
    held = [[], [(0.0, 20.0)], [(0.0, 5.5)], [(5.5, 20.0)]] + [drawn(rng, rng.randint(1, 5)) for _ in range(12)]
    one = spark.createDataFrame([(i, x) for i, x in enumerate(held)], f"i int, a {TYPE}")
    pairs = one.crossJoin(one.select(F.col("i").alias("j"), F.col("a").alias("b")))
    a, b = F.col("a"), F.col("b")
    of = {i: {k for low, high in x for k in range(round(2 * low), round(2 * high))} for i, x in enumerate(held)}
    rows = pairs.select("i", "j", HOW.both(a, b).alias("both"), HOW.either(a, b).alias("either"), HOW.less(a, b).alias("less"), HOW.other(a).alias("other"), HOW.has_more(a, b).alias("more"), HOW.same(a, HOW.other(HOW.other(a))).alias("same"))
    for r in rows.collect():
        x, y = of[r.i], of[r.j]
        assert (stretches(r.both), stretches(r.either), stretches(r.less), stretches(r.other)) == (x & y, x | y, x - y, set(range(40)) - x)
        assert r.more == bool(x - y) and r.same
    assert stretches(one.where("i > 5").agg(HOW.union(a).alias("u")).first().u) == set().union(*(of[i] for i in of if i > 5))
    ends = spark.createDataFrame([(-3.0, 2.0), (4.0, 4.0), (7.0, 99.0), (None, 1.0), (float("nan"), 3.0), (1.0, float("nan")), (9.0, 2.0)], "low double, high double")
    assert [[(x.low, x.high) for x in r.s] for r in ends.select(HOW.between(F.col("low"), F.col("high")).alias("s")).collect()] == [[(0.0, 2.0)], [], [(7.0, 20.0)], [], [], [], []]
    with pytest.raises(ValueError, match="no parameters"):
        Intervals(1, 1)


def test_fixpoints(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(8), rng.randrange(8), drawn(rng, rng.randint(1, 3))) for _ in range(14)]
    edges = list({(a, b): (a, b, x) for a, b, x in edges}.values())
    df = spark.createDataFrame(edges, f"src long, dst long, colours {TYPE}")
    df = df.withColumn("going", F.col("colours"))
    enabled = {(a, b): {k for low, high in x for k in range(round(2 * low), round(2 * high))} for a, b, x in edges}
    goal, path = sets.full(spark.createDataFrame([(0,), (3,)], "state long"), HOW), sets.full(spark.range(7).withColumnRenamed("id", "state"), HOW)
    for every, run in ((False, sets.exists_until), (True, sets.every_until)):
        found = {r.state: stretches(r.colours) for r in run(path, goal, df, HOW).collect()}
        for k in range(40):
            now = {0, 3}
            while True:
                out = {s: [b for (a, b), ks in enabled.items() if a == s and k in ks] for s in range(7)}
                more = {s for s, to in out.items() if to and (all if every else any)(b in now for b in to)} - now
                if not more:
                    break
                now |= more
            assert {s for s, ks in found.items() if k in ks} == now
