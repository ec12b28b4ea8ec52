"""Shared building blocks: written intermediate tables, global ranks, in-row helpers and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.written import cut, dropped, ranked, shared_folder, written

__all__ = ["SPACE", "WORD", "components", "cut", "cut_out", "dropped", "let", "lists", "pieces", "ranked", "running_in_row", "running_total", "shared_folder", "table", "written"]

#: ASCII white space as the contracts define it, and a word between such characters.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas, where Spark has no common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lists(rows: pa.Table, column: str) -> list[np.ndarray]:
    """The arrays of a list column, as views of one buffer rather than Python objects."""
    if not rows.num_rows:
        return []
    held = rows.column(column).combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    at = held.offsets.to_numpy() - held.offsets[0].as_py()
    return np.split(held.flatten().to_numpy(zero_copy_only=False), at[1:-1])


def running_total(df: DataFrame, value: Column, *order: Column, name: str = "running") -> DataFrame:
    """``df`` (written) with ``before``: the sum of ``value`` over all rows that precede in ``order``.

    As in :func:`ranked`, only one row per partition is broadcast; rows of one partition are summed in a window over that partition.
    """
    rows = cut(df.withColumn("_value", value.cast("long")).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_value").over(before(Window.partitionBy("_part").orderBy("_at"))), F.lit(0))
    return rows.withColumn("_inside", inside).join(F.broadcast(parts), "_part").withColumn("before", F.col("_base") + F.col("_inside")).drop("_value", "_at", "_part", "_inside", "_base")


def running_in_row(values: Column, plus: Callable[[Column, Column], Column] = lambda a, b: a + b, block: int = 64) -> Column:
    """Inclusive running sums of an array of ints (0 or more), or what ``plus`` makes of them, in blocks, so that the work stays near-linear in its length."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: plus(a, b))

    def whole(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))
        return F.when(F.size(a) < 1, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    def joined(blocks: Column) -> Column:
        offsets = let(F.transform(blocks, total), lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda b: total(F.slice(t, F.lit(1), b - 1))))
        return F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: plus(o, total(F.slice(x, F.lit(1), i))))))

    return let(values, whole)


#: Code points of a piece that a text is cut into, to get at places in it without a walk from its start.
PIECE = 1024


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut_out(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (0 is the first) of a text given as :func:`pieces`; "" if length isn't above 0."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((start + length - 1) / PIECE).cast("int") - first + 1)
    return F.when(length > 0, F.substring(F.array_join(some, ""), start - first * PIECE + 1, length)).otherwise("")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): ``(node, root)`` with the smallest id of each component, for every node in an edge.

    Alternating large-star and small-star steps (each a groupBy and a join on the node) until the edges no longer change; every
    step's edges are written to the shared folder. Hub nodes are aggregated map-side and their joins are plain sort-merge joins,
    which Spark splits where a key is hot.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, between = written(large.where("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.col("m")).where("x <> m")
        before = path
        now, path = written(small.union(least.select("a", "m")).toDF("a", "b").distinct(), name)
        dropped(spark, [before, between])
