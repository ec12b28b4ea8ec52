"""Temporal operators over relations ``(names..., state, colour)`` and edges ``(src, dst, dir_name, dir_facet, colour)``.

Open names ride along as further columns of every join key. Fixpoints are loops on the driver over written rounds; a round joins only what
the round before has added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintwalk.operators import chains
from tintwalk.operators.relations import KEY, conjunction, difference, names, widened
from tintwalk.written import Grown, cut

#: A known set of more rows is scanned for the rows that a round reached, instead of being joined as it is.
FEW = 1_000_000

#: Rows of an A fixpoint are told by the order of their numbers if at most one edge in so many goes against it.
TURNS = 8


def sources(edges: DataFrame) -> DataFrame:
    """(state, colour) with an edge."""
    return edges.select(F.col("src").alias("state"), "colour").distinct()


def targets(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("state"), "colour").distinct()


def step_back(rel: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """Where an edge leads into ``rel``; rows repeat, one for each edge. ``more`` columns of the edges are kept."""
    into = edges.select("src", F.col("dst").alias("state"), "colour", *more)
    return into.join(rel, KEY).select(*names(rel), F.col("src").alias("state"), "colour", *more)


def some_next(rel: DataFrame, edges: DataFrame, along: Column) -> DataFrame:
    return step_back(rel, edges.where(along)).distinct()


def every_next(rel: DataFrame, edges: DataFrame, along: Column) -> DataFrame:
    """Some edge, and every enabled edge goes along and into ``rel``: edges are counted, so no negation of ``rel`` is built."""
    each = edges.select("src", "dst", along.alias("goes"), "colour").distinct()
    need = each.groupBy(F.col("src").alias("state"), "colour").agg(F.count(F.lit(1)).alias("need"))
    got = step_back(rel, each.where("goes")).groupBy(*names(rel), *KEY).agg(F.count(F.lit(1)).alias("got"))
    return got.join(need, KEY).where("got = need").select(*names(rel), *KEY)


Step = Callable[[DataFrame], DataFrame]


def closure(
    seed: DataFrame, step: Step, name: str, log: list | None = None, shorten: Callable[[DataFrame], tuple[Step, chains.Chains]] | None = None
) -> DataFrame:
    """Least relation with the rows of ``seed`` (a set) and all that ``step`` makes of its rows.

    A round takes one step from the rows that the last one has added. What is known already is told from the rows reached: a large known
    set is scanned for them, and isn't shuffled as long as they can be broadcast.

    A fixpoint that isn't reached in :data:`chains.PLAIN` rounds is shortened, if that is given: what is found so far makes a step over fewer rows, and the chains
    that the others are in.
    """
    keys = seed.columns
    found = Grown(seed.sparkSession, seed.schema, name)
    new = found.add(seed)
    held: chains.Chains | None = None
    while new is not None:
        if shorten is not None and held is None and len(found.rounds) > chains.PLAIN:
            step, held = shorten(found.all())
            noted_rounds(log, "chains", held.rounds)
        rows = step(new).distinct()
        known = found.all()
        if found.rows > FEW:
            known = known.join(rows, keys, "left_semi")
        new = found.add(rows.join(known, keys, "left_anti"))
    noted_rounds(log, found.name, found.rounds)
    return found.all() if held is None else held.carried(found.all())


def exists_until(path: DataFrame | None, goal: DataFrame, edges: DataFrame, along: Column, states: DataFrame, weak: bool = False, log: list | None = None) -> DataFrame:
    """Least relation with ``goal`` and, of the rows of ``path`` (None: all), those with an edge that goes along and leads into it.

    ``weak``: (state, colour) with an enabled edge that doesn't go along count as goals.
    """
    if weak:
        goal = _also(goal, sources(edges.where(~along)), states)
    edges = edges.where(along).select("src", "dst", "colour").distinct()
    goal, edges, path = _prepared(path, goal, edges, states)

    def step(rel: DataFrame) -> DataFrame:
        back = step_back(rel, edges)
        return conjunction(back.distinct(), path) if path is not None else back

    try:
        return closure(goal, step, "exists-until", log, None if path is not None else shorter(edges, "src", "dst"))
    finally:
        edges.unpersist()


def every_until(
    path: DataFrame | None,
    goal: DataFrame,
    edges: DataFrame,
    along: Column,
    states: DataFrame,
    weak: bool = False,
    space: DataFrame | None = None,
    log: list | None = None,
) -> DataFrame:
    """Least relation with ``goal`` and, of the rows of ``path`` (None: all), those with enabled edges all of which go along and lead into it.

    Each edge is counted once, in the round that its target is added in: a row is added when all its edges are counted. An edge carries
    how many its source has, so that a round reads the counts of the rows it touches and nothing else. A fixpoint that isn't reached in
    :data:`chains.PLAIN` rounds is told by the order of the states where there is one, or has its chains contracted. A (state, colour) without edges is
    never added but as a goal; ``weak`` takes those of ``space`` without an edge that goes along for goals.
    """
    if weak:
        goal = _also(goal, difference(space, sources(edges.where(along))), states)
    goal = cut(goal, "goal")
    each = edges.select("src", "dst", along.alias("goes"), "colour").repartition("src", "colour").distinct()  # the one shuffle by source
    settled = not names(goal)
    if settled:  # nothing is asked of the edges of goals
        each = each.join(goal.withColumnRenamed("state", "src"), ["src", "colour"], "left_anti")
    beside = Window.partitionBy("src", "colour")
    each = each.select("src", "dst", "colour", F.count(F.lit(1)).over(beside).alias("need"), F.bool_and(F.col("goes") & (F.col("src") != F.col("dst"))).over(beside).alias("goes"))
    goal, each, path = _prepared(path, goal, each.where("goes").drop("goes"), states)  # what waits for itself is never added
    if settled and names(goal):
        goal = cut(goal, "goal")
    keys = goal.columns
    counted = Grown(goal.sparkSession, goal.select("*", F.lit(0).cast("long").alias("got"), F.lit(True).alias("done")).schema, "every-until")
    new: DataFrame | None = goal
    crossed: chains.Chains | None = None
    kept, tried = each, False
    while new is not None:
        if path is None and crossed is None and len(counted.rounds) >= chains.PLAIN * (1 + tried):
            found = goal.unionByName(counted.all().where("done").select(*keys))
            if not tried and keys == KEY and (order := _order(each)) is not None:
                decided, each = _decided(each, found, order, log)
                more = counted.add(decided.select(*KEY, F.lit(0).cast("long").alias("got"), F.lit(True).alias("done")))
                if each is None:
                    break
                new = new if more is None else new.unionByName(more)
                tried = True
            else:
                crossed = chains.contracted(each, "src", "dst", stops=found.select(F.col("state").alias("src"), "colour"))
                each = crossed.edges
                noted_rounds(log, "chains", crossed.rounds)
        hit = step_back(new.select(*keys), each, "need").groupBy(*keys).agg(F.count(F.lit(1)).alias("got"), F.max("need").alias("need"))
        before = counted.all().join(hit, keys, "left_semi").groupBy(*keys).agg(F.sum("got").alias("before"))
        hit = hit.join(before, keys, "left").withColumn("done", F.col("need") == F.col("got") + F.coalesce("before", F.lit(0)))
        counts = hit.select(*keys, "got", "done")
        counts = counts if settled else counts.join(goal, keys, "left_anti")
        counts = counts if path is None else counts.join(path, [*names(path), *KEY], "left_semi")
        new = counted.add(counts, F.col("done"))
    noted_rounds(log, counted.name, counted.rounds)
    kept.unpersist()
    done = goal.unionByName(counted.all().where("done").select(*keys))
    return done if crossed is None else crossed.carried(done)


def _order(each: DataFrame) -> bool | None:
    """Whether states mostly grow along edges (False: fall), None if neither goes for nearly all edges, or if most rows are in chains, which contraction takes."""
    n, single, up = each.agg(F.count(F.lit(1)), F.count_if(F.col("need") == 1), F.count_if(F.col("dst") > F.col("src"))).first()
    turns = min(up, n - up)
    return None if not n or 2 * single >= n or TURNS * turns > n else 2 * up >= n


def _decided(each: DataFrame, found: DataFrame, grows: bool, log: list | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``each(src, dst, colour, need)`` beside ``found`` that are told at once, and the edges of those that can't be (None if there are none).

    A row that isn't in the fixpoint reaches one that has no edge to go on by, or a circle of such rows. The first are followed backwards. A circle has an edge on which the
    number of the state turns, so rows that reach neither are in: where numbers only grow, or only fall, these are all.
    """
    rest = cut(difference(sources(each), found), "open")
    alive = rest.unionByName(found.select(*KEY)).withColumnRenamed("state", "dst")
    back = lambda rel: step_back(rel, each)
    lost = closure(sources(each.join(alive, ["dst", "colour"], "left_anti")), back, "lost", log, shorter(each, "src", "dst"))
    if not lost.isEmpty():
        rest = difference(rest, lost)
    turning = each.where("dst < src" if grows else "dst > src").select("src", "dst", "colour")
    for end in ("src", "dst"):
        turning = turning.join(rest.withColumnRenamed("state", end), [end, "colour"], "left_semi")
    doubtful = closure(sources(turning), back, "doubtful", log, shorter(each, "src", "dst"))
    if doubtful.isEmpty():
        return rest, None
    left = difference(doubtful, lost).withColumnRenamed("state", "src")
    edges = cut(each.join(left, ["src", "colour"], "left_semi").select(*each.columns), "edges")
    return difference(rest, doubtful), edges


def _also(goal: DataFrame, more: DataFrame, states: DataFrame) -> DataFrame:
    return goal.unionByName(widened(more, names(goal), states)).distinct()


def noted_rounds(log: list | None, name: str, rounds: list[int]) -> None:
    if log is not None:
        log += [(name, at, n) for at, n in enumerate(rounds)]


def shorter(edges: DataFrame, of: str, by: str, keys: tuple[str, ...] = ("colour",)) -> Callable[[DataFrame], tuple[Step, chains.Chains]]:
    """For :func:`closure`: over ``edges`` a row ``of`` is found from ``by``, and chains of such rows are crossed at once."""

    def shorten(found: DataFrame) -> tuple[Step, chains.Chains]:
        held = chains.contracted(edges, of, by, keys, found.select(F.col("state").alias(of), *keys))

        def step(rel: DataFrame) -> DataFrame:
            back = held.edges.withColumnRenamed(by, "state").join(rel, [*keys, "state"]).drop("state")
            return back.withColumnRenamed(of, "state").select(*rel.columns)

        return step, held

    return shorten


def _prepared(path: DataFrame | None, goal: DataFrame, edges: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Goal with the names of the path; edges kept in memory by target, so that no round shuffles them again.

    A path without open names is applied to the edges here, once.
    """
    if path is not None and not names(path):
        kept = edges.columns
        edges, path = edges.join(path.withColumnRenamed("state", "src"), ["src", "colour"], "left_semi").select(*kept), None
    if path is not None:  # read in every round
        path = cut(path, "path")
        goal = widened(goal, names(path), states)
    return goal, edges.repartition("dst", "colour").persist(), path


def reach(seed: DataFrame, edges: DataFrame, forward: bool = True, guard: DataFrame | None = None, log: list | None = None) -> DataFrame:
    """All that ``seed(state, colour)`` reaches over edges under one colour, through states of ``guard`` (the seed itself isn't guarded)."""
    out, into = ("src", "dst") if forward else ("dst", "src")
    edges = edges.select(out, into, "colour").distinct()
    if guard is not None:
        edges = edges.join(guard.select(F.col("state").alias(into), "colour"), [into, "colour"], "left_semi")
    edges = edges.repartition(out, "colour").persist()
    step = lambda rel: edges.join(rel.withColumnRenamed("state", out), [out, "colour"]).select(F.col(into).alias("state"), "colour")
    try:
        return closure(seed.select(*KEY).distinct(), step, "reach", log, shorter(edges, into, out))
    finally:
        edges.unpersist()
