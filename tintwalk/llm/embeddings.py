"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors collide on a line if their projections lie within a window centred on
either. Pairs that collide on a sorted line are candidates, their collisions over ``LINES`` further lines are counted, and those with enough of
them are verified by their cosine in double precision.

Windows on single lines alone hold a fixed share of all pairs, however many lines are counted, so the work would grow with the square of the table.
The sorted line is therefore laid within cells: vectors are first dealt by a few coarse projections, in several tables with shifted edges, so
that a pair parted in one meets in another. Cells, tables and the count are calibrated from the normal law of projections, so that a pair at the
threshold is found with probability ``RECALL`` at least; nearer pairs are found more surely. A row that is sent to its cell carries its
vector and its place on the line; whether a pair has met in an earlier table is told from projections made anew.

Exact copies are collapsed first and count by their number. A cell with more than ``BLOCK`` vectors is split into blocks that meet
pairwise in different tasks, so no case is dropped; a pair is taken in the first table in which it meets. Tasks give
link counts and connecting edges, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths don't link; repeated ids are vectors of their own; a null id has a null component and isn't kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import components, cut, ranked, table

THRESHOLD, RECALL, LINES, BLOCK, SEED = 0.9, 0.96, 32, 256, 7
#: Width of a coarse cell, half-widths of the windows that find candidates and that count collisions.
CELL, WINDOW, COUNTED = 2.0, 1.2, 0.6
#: Vectors of a cell that aren't near, aimed at.
CROWD = 128


def normal(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def in_cell(width: float, apart: float) -> float:
    """Probability that two points ``apart`` fall into one cell of a randomly shifted grid on a random line."""
    r = width / apart
    return 1 - 2 * normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def in_window(half: float, apart: float) -> float:
    return 2 * normal(half / apart) - 1


@dataclass(frozen=True)
class Plan:
    threshold: float
    cells: int  # coarse projections of a table
    tables: int
    least: int  # collisions, of LINES

    def lines(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coarse lines (tables, cells, dim) and shifts, sorting lines (tables, dim), counting lines (LINES, dim)."""
        rng = np.random.default_rng([SEED, dim])
        shape = (self.tables, self.cells, dim)
        return rng.normal(size=shape), rng.uniform(0, CELL, shape[:2]), rng.normal(size=(self.tables, dim)), rng.normal(size=(LINES, dim))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """Cells so fine that about ``CROWD`` unrelated vectors share one, and as many tables as ``recall`` needs at the threshold."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    cells = max(1, round(math.log(max(n, 1) / CROWD) / -math.log(in_cell(CELL, far)))) if n > CROWD else 1
    p = in_window(COUNTED, near)
    tail, least = 0.0, LINES + 1
    while tail < 0.99 + 0.01 * recall and least:
        least -= 1
        tail += math.comb(LINES, least) * p**least * (1 - p) ** (LINES - least)
    once = in_cell(CELL, near) ** cells * in_window(WINDOW, near)
    return Plan(threshold, cells, math.ceil(math.log(1 - recall / tail) / math.log(1 - once)), least)


def _projected(unit: np.ndarray, how: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Cells (rows, tables, cells) and places on the sorted lines (rows, tables); sums in a fixed order, so that a vector always has the same."""
    coarse, shift, sort, _ = how.lines(unit.shape[1])
    at = np.einsum("nd,tcd->ntc", unit, coarse, optimize=False) + shift
    return np.floor(at / CELL).astype(np.int64), np.einsum("nd,td->nt", unit, sort, optimize=False).astype(np.float32)


def _indexed(batches: Iterator[pa.RecordBatch], how: Plan) -> Iterator[pa.RecordBatch]:
    """(id, copies, vector) to (id, copies, vector, cells, axes); rows that can't link give empty arrays."""
    for batch in batches:
        cells, axes, units = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))], {}
        for i, v in enumerate(batch.column(2)):
            if (v := _unit(v.as_py())) is not None:
                units.setdefault(len(v), []).append((i, v))
        for dim, found in units.items():
            own = [i for i, _ in found]
            at, axis = _projected(np.stack([v for _, v in found]), how)
            for i, rows, places in zip(own, at.tolist(), axis, strict=True):
                cells[i] = [hash((dim, *row)) & 0x7FFFFFFFFFFFFFFF for row in rows]
                axes[i] = places
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64())), pa.array(axes, pa.list_(pa.float32()))], names=["id", "copies", "vector", "cells", "axes"])


def _unit(v: list | None) -> np.ndarray | None:
    if not v or None in v:
        return None
    v = np.array(v, dtype=np.float64)
    top = np.abs(v).max() if np.isfinite(v).all() else 0.0
    return _scaled(v[None])[0] if top > 0 else None


def _scaled(raw: np.ndarray) -> np.ndarray:
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
    return unit / np.sqrt(np.einsum("nd,nd->n", unit, unit, optimize=False))[:, None]


def _met(batches: Iterator[pa.RecordBatch], how: Plan) -> Iterator[pa.RecordBatch]:
    """Sorted rows (table, cell, one, other, axis, side, id, copies, vector) to edges (a, b, null) and counts (a, null, n)."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = np.stack([held.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(new):
            yield from _linked(held.slice(0, new[-1] + 1), how)
            held = held.slice(new[-1] + 1)
    if held is not None and held.num_rows:
        yield from _linked(held, how)


def _linked(rows: pa.RecordBatch, how: Plan) -> Iterator[pa.RecordBatch]:
    vectors = rows.column(8).to_pylist()
    for dim in {len(v) for v in vectors}:  # a cell's hash holds the length, so a group has one but for a collision of hashes
        own = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
        yield _linked_alike(rows.take(pa.array(own)), np.array([vectors[i] for i in own], dtype=np.float64), how)


def _linked_alike(rows: pa.RecordBatch, raw: np.ndarray, how: Plan) -> pa.RecordBatch:
    number, _, one, other, axis, side, ids, copies = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(8))
    keys = np.stack([rows.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
    unit = _scaled(raw)
    cells, axes = _projected(unit, how)
    lines = (unit @ how.lines(unit.shape[1])[3].T).astype(np.float32)
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
    root, n, edges = list(range(len(ids))), np.zeros(len(ids), dtype=np.int64), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step in range(1, len(ids)):
        i = np.flatnonzero((group[step:] == group[:-step]) & (np.abs(axis[step:] - axis[:-step]) <= WINDOW))
        if not len(i):
            break  # sorted by axis: none that is further away is within the window
        i = i[(one[i] == other[i]) | (side[i] != side[i + step])]
        for part in np.array_split(i, len(i) // 200_000 + 1):
            j = part + step
            enough = (np.abs(lines[part] - lines[j]) <= COUNTED).sum(axis=1) >= how.least
            a, b = part[enough], j[enough]
            true = np.einsum("ij,ij->i", unit[a], unit[b]) >= how.threshold
            a, b = a[true], b[true]
            before = np.arange(how.tables) < number[a][:, None]
            first = ~((cells[a] == cells[b]).all(axis=2) & (np.abs(axes[a] - axes[b]) <= np.float32(WINDOW)) & before).any(axis=1)
            a, b = a[first], b[first]
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((ids[x], ids[y]))
    some = np.flatnonzero(n)
    a, b = [np.array(x, dtype=np.int64) for x in (zip(*edges, strict=True) if edges else ((), ()))]
    none = np.zeros(len(some), dtype=np.int64)
    ends = pa.array(np.concatenate([b, none]), mask=np.arange(len(a) + len(some)) >= len(a))
    counts = pa.array(np.concatenate([np.zeros(len(a), dtype=np.int64), n[some]]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids[some]])), ends, counts], names=["a", "b", "n"])


def link(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``."""
    rows = ranked(vectors.select("vec_id", "embedding"), F.col("vec_id").asc_nulls_first(), name="vectors").withColumnRenamed("rank", "row")
    rows = cut(rows, "vectors")
    classes = cut(rows.groupBy("embedding").agg(F.min("row").alias("id"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")
    how = plan(classes.count(), threshold, recall)
    element = classes.schema["embedding"].dataType.simpleString()
    schema = f"id long, copies long, vector {element}, cells array<long>, axes array<float>"
    index = classes.select("id", "copies", F.col("embedding").alias("vector")).mapInArrow(lambda b: _indexed(b, how), schema)
    index = cut(index, "projections")
    places = index.select("id", F.posexplode("cells").alias("table", "cell"))
    crowded = places.groupBy("table", "cell").count().where(F.col("count") > block).select("table", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    spread = index.select("*", F.posexplode("cells").alias("table", "cell")).join(crowded, ["table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("one"), F.greatest("own", other).alias("other")))
    spread = spread.withColumn("m", F.explode(meets))
    keys = ["table", "cell", "one", "other"]
    axis, side = F.get("axes", F.col("table")).alias("axis"), (F.col("own") == F.col("m.other")).cast("int").alias("side")
    spread = spread.select("table", "cell", "m.one", "m.other", axis, side, "id", "copies", "vector")
    found = spread.repartition(*keys).sortWithinPartitions(*keys, "axis", "id").mapInArrow(lambda b: _met(b, how), "a long, b long, n long")
    found = cut(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"), "vectors")
    valid = index.select("id", (F.size("cells") > 0).alias("valid"))
    known = classes.join(valid, "id").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = cut(known, "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(smallest, "root").select("embedding", "valid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    joined = rows.join(known.withColumnRenamed("embedding", "e"), F.col("embedding").eqNullSafe(F.col("e")))
    component = F.when(F.col("valid") & F.col("vec_id").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    links = F.when(F.col("valid"), F.col("n")).otherwise(F.lit(0)).cast("long")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
