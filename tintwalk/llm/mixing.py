"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is its share of all words by weight, at most ``CAP`` times its own words, the excess shared among the others by
weight. A document of a source is to be copied target / words times: the whole part of that is certain, the fraction is rounded
so that the words of a source add up. Two documents meet, words are moved from one to the other in a random direction (drawn so that
both expectations are kept) until one of them is copied a whole number of times, and the other goes on. Groups of ``GROUP`` documents of
a source, neighbours by size, each leave one residual document; their residuals are grouped again, in a reduction tree whose depth is
the logarithm of the largest source. The last residual of a source is drawn by its share, so that every expectation is kept and a
source misses its target by less than that one document.

Defined cases: null texts have size 0 and are taken 0 times; a null source is a source, last in order; repeated rows are rounded each for
itself; an empty table gives no rows. Draws depend on places in the order of source, size and doc_id alone, so reruns agree.
Only built-in functions run here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import SPACE, cut, let, ranked, table

WEIGHTS, CAP, GROUP, SEED = (5, 2, 1), 3, 64, 17


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source of ``sizes(source, size)``: ``source, source_size, documents, target``. Weights repeat in the order of source, nulls last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    totals = ranked(totals, F.col("source").asc_nulls_last(), name="sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    totals = cut(totals.select("source", "source_size", "documents", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")), "sources")
    level, known = 0.0, -1
    while True:  # the level at which all words are shared rises as sources are found full; each turn but the last finds another one
        full = F.col("most") < level * F.col("weight")
        taken, weight = F.when(full, F.col("most")).otherwise(0.0), F.when(full, 0.0).otherwise(F.col("weight"))
        words, taken, weight, n = totals.agg(F.sum("source_size"), F.sum(taken), F.sum(weight), F.count(F.when(full, 1))).first()
        if n == known or not weight:
            break
        level, known = (words - taken) / weight, n
    return totals.select("source", "source_size", "documents", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _step(level: int, seed: int):
    return lambda state, x: _met(state, x, level, seed)


def _met(state: Column, x: Column, level: int, seed: int) -> Column:
    """Two documents meet: the undecided one so far (state.at) and ``x``; words move until one is whole."""

    def met(c: Column) -> Column:
        ways = {"c_up": (1 - c.share) * c.size, "c_down": c.share * c.size, "x_up": (1 - x.share) * x.size, "x_down": x.share * x.size}
        room = F.struct(*[way.alias(name) for name, way in ways.items()])
        most = lambda r: F.struct(F.least(r.c_up, r.x_down).alias("up"), F.least(r.c_down, r.x_up).alias("down"), r.alias("r"))
        return let(room, lambda r: let(most(r), lambda m: moved(c, m)))

    def moved(c: Column, m: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), c.place, x.place), 11) * (2.0**-53)
        decided = lambda d, k: F.struct(d.place.alias("place"), F.lit(k).alias("extra"))
        within = lambda share: F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        rest = lambda d, share: F.struct(d.place.alias("place"), d.size.alias("size"), within(share).alias("share"))
        pair = lambda done, left: F.struct(left.alias("at"), F.concat(state.done, F.array(done)).alias("done"))
        full, none = pair(decided(c, 1), rest(x, x.share - m.up / x.size)), pair(decided(x, 0), rest(c, c.share + m.up / c.size))
        up = F.when(m.r.c_up <= m.r.x_down, full).otherwise(none)
        none, full = pair(decided(c, 0), rest(x, x.share + m.down / x.size)), pair(decided(x, 1), rest(c, c.share - m.down / c.size))
        down = F.when(m.r.c_down <= m.r.x_up, none).otherwise(full)
        return F.when(draw * (m.up + m.down) < m.down, up).otherwise(down)

    return met(state.at)


def pivotal(units: DataFrame, largest: int, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """Round ``units(stratum long, place long, size double > 0, share double in [0, 1])`` to ``(stratum, place, extra 0 or 1)``.

    ``place`` numbers a stratum's units from 0, without gaps; ``largest`` is the number of units of the largest stratum. Per stratum the
    sum of size times extra is within one unit's size of the sum of size times share.
    """
    unit, decided = "struct<place: bigint, size: double, share: double>", []
    now = units.select("stratum", "place", F.struct("place", "size", "share").cast(unit).alias("unit"))
    level, width = 0, 1
    while True:
        width *= group
        last = width >= largest
        groups = now.groupBy("stratum", F.floor(F.col("place") / width).cast("long").alias("place")).agg(F.sort_array(F.collect_list("unit")).alias("units"))
        start = F.struct(F.get("units", F.lit(0)).alias("at"), F.array().cast("array<struct<place: bigint, extra: int>>").alias("done"))
        rounded = groups.withColumn("r", F.aggregate(F.slice("units", F.lit(2), F.size("units")), start, _step(level, seed)))
        rounded = cut(rounded.select("stratum", (F.col("place") * width).alias("place"), "r"), "mixing")
        decided.append(rounded.select("stratum", F.explode("r.done").alias("d")).select("stratum", "d.place", "d.extra"))
        now = rounded.select("stratum", "place", F.col("r.at").alias("unit"))
        level += 1
        if last:
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), "stratum", "unit.place"), 11) * (2.0**-53)
            decided.append(now.select("stratum", "unit.place", F.when(draw < F.col("unit.share"), 1).otherwise(0).alias("extra")))
            return reduce(DataFrame.unionByName, decided)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` (and the columns in ``keep``) for each row of ``docs(doc_id, text, source)``."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep), "sizes")
    rows = ranked(sizes, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), name="ranks")
    rows = cut(rows, "ranks")
    targets = source_targets(rows, weights, cap)
    firsts = rows.groupBy("source").agg(F.min("rank").alias("first"), F.min(F.when(F.col("size") > 0, F.col("rank"))).alias("first_sized"))
    targets = cut(targets.join(firsts, targets.source.eqNullSafe(firsts.source)).drop(firsts.source), "targets")
    rows = rows.join(targets, rows.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("wanted", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("wanted").cast("long"))
    rows = cut(rows.withColumn("share", F.col("wanted") - F.col("whole")), "wanted")
    sized = rows.where("size > 0").select(F.col("first").alias("stratum"), (F.col("rank") - F.col("first_sized")).alias("place"), F.col("size").cast("double").alias("size"), "share")
    largest = targets.agg(F.max("documents")).first()[0] or 1
    extra = pivotal(sized, largest, seed=seed).withColumnRenamed("stratum", "first").hint("merge")  # a row a document, which Spark sizes as one a group
    found = rows.withColumn("place", F.col("rank") - F.col("first_sized")).join(extra, ["first", "place"], "left")
    found = found.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *keep)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
