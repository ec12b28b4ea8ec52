"""Terminal components: for each colour, sets of states that reach each other and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwalk.operators import chains
from tintwalk.operators.relations import KEY, difference
from tintwalk.operators.temporal import closure, noted_rounds, shorter, sources, targets
from tintwalk.system import TransitionSystem
from tintwalk.written import Grown, cut, dropped


def sinks(system: TransitionSystem) -> DataFrame:
    """(state, colour) without an edge to another state."""
    return difference(system.space(), system.edges.where("src <> dst").select(F.col("src").alias("state"), "colour"))


def least_reachable(space: DataFrame, edges: DataFrame, log: list | None = None) -> DataFrame:
    """``(state, colour, least)``: the smallest state that is reached over ``edges(src, dst, colour)``. Labels move backwards until none falls.

    A round follows the labels that fell and writes those that fall again; the label of a state is the smallest that was written for it. If they still fall
    after :data:`chains.PLAIN` rounds, chains are crossed at once: what leads into one is offered the least label on it, and labels move on between the others.
    """
    edges = kept = edges.select("src", F.col("dst").alias("state"), "colour").repartition("state", "colour").persist()
    first = space.select(*KEY, F.col("state").alias("least"))
    labels = Grown(first.sparkSession, first.schema, "labels")
    now = lambda: labels.all().groupBy(*KEY).agg(F.min("least").alias("least"))

    def falling(offered: DataFrame) -> DataFrame:
        before = labels.all().join(offered, KEY, "left_semi").groupBy(*KEY).agg(F.min("least").alias("now"))
        return offered.join(before, KEY).where("least < now").select(*KEY, "least")

    moved, held = labels.add(first), None
    while moved is not None:
        if held is None and len(labels.rounds) > chains.PLAIN:
            held = chains.contracted(edges, "src", "state", low=now().select(F.col("state").alias("src"), "colour", F.col("least").alias("low")))
            noted_rounds(log, "chains", held.rounds)
            into = held.rows.select(F.col("src").alias("state"), "colour", F.col("low").alias("least"))
            beside = edges.join(held.rows.select("src", "colour"), ["src", "colour"], "left_anti")
            labels.add(falling(beside.join(into, KEY).groupBy(F.col("src").alias("state"), "colour").agg(F.min("least").alias("least"))))
            edges, moved = held.edges, now()
        offered = edges.join(moved, KEY).where("least < src").groupBy(F.col("src").alias("state"), "colour").agg(F.min("least").alias("least"))
        moved = labels.add(falling(offered))
    kept.unpersist()
    noted_rounds(log, labels.name, labels.rounds)
    if held is None:
        return cut(now(), "least")
    ends = now().select(F.col("state").alias("end"), "colour", F.col("least").alias("of_end"))
    within = held.rows.join(ends, ["end", "colour"], "left").select(F.col("src").alias("state"), "colour", F.least("low", "of_end").alias("least"))
    found = cut(labels.all().unionByName(within).groupBy(*KEY).agg(F.min("least").alias("least")), "least")
    dropped(found.sparkSession, held.paths)
    return found


def terminal_components(system: TransitionSystem, log: list | None = None) -> DataFrame:
    """``(component, state, colour)``: the terminal components of all colours at once, each named by its smallest state.

    A (state, colour) without edges to others is one by itself, and what reaches it is in none; those go first. In the other components
    every state has the same smallest reachable state, its root. From each root the states that share
    its label are followed; a root from which an edge leads to another label belongs to no terminal component.
    """
    edges = cut(system.edges.where("src <> dst").select("src", "dst", "colour").distinct(), "edges")
    out = sources(edges)
    single = difference(system.space(), out).select(F.col("state").alias("component"), *KEY)
    back = edges.repartition("dst", "colour").persist()
    step = lambda rel: back.withColumnRenamed("dst", "state").join(rel, KEY).select(F.col("src").alias("state"), "colour")
    lost = closure(difference(targets(edges), out), step, "lost", log, shorter(back, "src", "dst"))
    rest = cut(edges.join(lost.withColumnRenamed("state", "src"), ["src", "colour"], "left_anti"), "edges")
    back.unpersist()
    if rest.isEmpty():
        return single
    least = least_reachable(sources(rest), rest, log)
    to = rest.join(least.select(F.col("state").alias("dst"), "colour", F.col("least").alias("to")), ["dst", "colour"])
    to = to.join(least.select(F.col("state").alias("src"), "colour", F.col("least").alias("component")), ["src", "colour"])
    stays = (F.col("to") == F.col("component")).alias("stays")
    to = cut(to.select("component", F.col("src").alias("state"), F.col("dst").alias("into"), "colour", stays), "edges")
    staying = to.where("stays").drop("stays").repartition("component", "state", "colour").persist()
    roots = least.where("state = least").select(F.col("state").alias("component"), *KEY)
    step = lambda rel: staying.join(rel, ["component", *KEY]).select("component", F.col("into").alias("state"), "colour")
    within = closure(roots, step, "components", log, shorter(staying, "into", "state", ("component", "colour")))
    staying.unpersist()
    open_ended = within.join(to.where("not stays"), ["component", *KEY], "left_semi").select("component", "colour").distinct()
    return single.unionByName(within.join(open_ended, ["component", "colour"], "left_anti").select("component", *KEY))


def on_circles(edges: DataFrame, log: list | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(state, colour)`` that reach themselves over ``edges(src, dst, colour)`` by at most :data:`chains.PLAIN` further edges than one, and those for which that is open (None: none).

    Walks start at every state, and a start that was met again is followed no further, so that of dense components few pairs of states are written.
    """
    edges = edges.select("src", "dst", "colour").distinct().repartition("src", "colour").persist()
    first = edges.select(F.col("src").alias("start"), F.col("dst").alias("state"), "colour", (F.col("src") == F.col("dst")).alias("closed"))
    walks = Grown(edges.sparkSession, first.schema, "circles")
    ahead, start = ~F.col("closed"), ["start", "colour"]
    met = lambda: walks.all().where("closed").select(*start)
    new = walks.add(first, ahead)
    while new is not None and len(walks.rounds) <= chains.PLAIN:
        on = new.join(met(), start, "left_anti").join(edges.withColumnRenamed("src", "state"), KEY)
        rows = on.select("start", F.col("dst").alias("state"), "colour", (F.col("dst") == F.col("start")).alias("closed")).distinct()
        new = walks.add(rows.join(walks.all(), ["start", *KEY], "left_anti"), ahead)
    edges.unpersist()
    noted_rounds(log, walks.name, walks.rounds)
    named = lambda rows: rows.withColumnRenamed("start", "state").distinct()
    left = None if new is None else cut(named(new.join(met(), start, "left_anti").select(*start)), "open")
    return named(met()), None if left is None or left.isEmpty() else left
