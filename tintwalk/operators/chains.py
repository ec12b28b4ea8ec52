"""Long chains: stretches of rows each of which hangs on one other row alone are ranked, so that a fixpoint crosses them in one round: first within batches of neighbouring rows,
then by pointer doubling between the rows at which a batch is entered.

An edge ``(of, by, keys...)`` says that ``of`` holds if ``by`` does: for EF and AF that is source and target, for reachability forwards target and source.
A row with one such edge, which isn't found yet, holds exactly if the row does in which its chain ends: one with no edge or several, or one found before.
So chains leave the graph, what led into them leads to their ends, and their rows are added when all else is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwalk.written import cut, dropped, written

#: Rounds that a fixpoint takes before its chains are looked for; most end before, and pay nothing.
PLAIN = 12


@dataclass
class Chains:
    """``rows(of, keys..., end[, low])``, one for each row in a chain; ``end`` is null where the chain runs into a circle. ``edges`` are those between all other rows."""

    of: str
    rows: DataFrame
    edges: DataFrame
    rounds: list[int]
    paths: list[str]

    def carried(self, found: DataFrame) -> DataFrame:
        """``found(..., state)`` (written) with the rows of chains that end in one of them. The chains are let go."""
        shared = [c for c in self.rows.columns if c in found.columns and c not in (self.of, "state")]
        back = self.rows.where("end is not null").select(F.col(self.of).alias("within"), *shared, F.col("end").alias("state"))
        more = found.join(back, ["state", *shared]).drop("state").withColumnRenamed("within", "state")
        done = cut(found.unionByName(more.select(*found.columns)), "chains")
        dropped(found.sparkSession, self.paths)
        return done


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(of, keys..., next[, low])`` sorted by keys, then ``of``: each with the first ``next`` outside its batch, null if it runs into a circle, and the least ``low`` before that."""
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        names = batch.schema.names
        at = names.index("next")
        column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
        of, after, keys = column(0), column(at).copy(), [column(i) for i in range(1, at)]
        low = column(at + 1).copy() if len(names) > at + 1 else None
        new = np.zeros(n, dtype=bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        values = np.unique(of)
        group = np.cumsum(new) * len(values)
        code, place = group + np.searchsorted(values, of), np.minimum(np.searchsorted(values, after), len(values) - 1)
        to = np.minimum(np.searchsorted(code, group + place), n - 1)
        to = np.where((values[place] == after) & (code[to] == group + place), to, -1)
        for _ in range(n.bit_length() + 1):
            on = np.flatnonzero(to >= 0)
            if not len(on):
                break
            over = to[on]
            after[on], then = after[over], to[over]
            if low is not None:
                low[on] = np.minimum(low[on], low[over])
            to[on] = then
        out = [batch.column(i) for i in range(at)] + [pa.array(after, batch.schema.field(at).type, mask=to >= 0)]
        yield pa.RecordBatch.from_arrays(out if low is None else [*out, pa.array(low, batch.schema.field(at + 1).type)], names=names)


def contracted(edges: DataFrame, of: str, by: str, keys: tuple[str, ...] = ("colour",), stops: DataFrame | None = None, low: DataFrame | None = None) -> Chains:
    """The chains of ``edges(of, by, keys..., ...)``, whose rows are distinct in these columns; further columns stay with the edge.

    No row of ``stops(of, keys...)`` is within a chain. With ``low(of, keys..., low)``, which has every row, a chain's row gets the least ``low`` from it to where the chain ends,
    that of the end not counted, and of all the circle that it runs into. Rows near each other in number are taken together first, in batches of Arrow's size, so that of a chain in the
    order of its numbers a row a batch is left; of one in no order all are. Those left are doubled: a round reads the rows whose chains go on, no others.
    Chains of ``n`` rows left take about log2(n) rounds; what then still goes on is in a circle.
    """
    lows = [] if low is None else ["low"]
    single = edges.groupBy(of, *keys).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("next")).where((F.col("n") == 1) & (F.col("next") != F.col(of))).drop("n")
    if stops is not None:
        single = single.join(stops, [of, *keys], "left_anti")
    if low is not None:
        single = single.join(low, [of, *keys])
    inside, first = written(single.select(of, *keys, "next", *lows), "chains")
    near = inside.repartitionByRange(*keys, of).sortWithinPartitions(*keys, of)
    near, path = written(near.mapInArrow(_within, inside.schema), "chains")
    dropped(edges.sparkSession, [first])
    entered = near.join(near.select(F.col("next").alias(of), *keys).distinct(), [of, *keys], "left_semi")
    entered, left = written(entered.select(of, *keys, "next", *lows), "chains")
    rounds, n = [near.count()], entered.count()
    end = entered.join(entered.select(F.col(of).alias("next"), *keys, F.lit(True).alias("on")), ["next", *keys], "left")
    at, now = written(end.select(of, *keys, "next", *lows, F.coalesce("on", F.lit(False)).alias("on")), "chains")
    dropped(edges.sparkSession, [left])
    while (going := at.where("on").count()) and 2 ** (len(rounds) - 1) <= n:
        rounds.append(going)
        ahead = at.select(F.col(of).alias("next"), *keys, F.col("next").alias("then"), F.col("on").alias("goes"), *[F.col(c).alias(f"{c}_then") for c in lows])
        least = [F.least(c, f"{c}_then").alias(c) for c in lows]
        moved = at.where("on").join(ahead, ["next", *keys]).select(of, *keys, F.col("then").alias("next"), *least, F.col("goes").alias("on"))
        before = now
        at, now = written(at.where("not on").unionByName(moved), "chains")
        dropped(edges.sparkSession, [before])
    ends = at.select(F.col(of).alias("next"), *keys, F.when(~F.col("on"), F.col("next")).alias("then"), F.lit(True).alias("far"), *[F.col(c).alias(f"{c}_then") for c in lows])
    rows = near.join(ends, ["next", *keys], "left").select(of, *keys, F.when(F.col("far"), F.col("then")).otherwise(F.col("next")).alias("end"), *[F.least(c, f"{c}_then").alias(c) for c in lows])
    rows, done = written(rows, "chains")
    dropped(edges.sparkSession, [path, now])
    rest = edges.join(rows.select(of, *keys), [of, *keys], "left_anti")
    into = rows.select(F.col(of).alias(by), *keys, "end", F.lit(True).alias("chained"))
    rest = rest.join(into, [by, *keys], "left").where("chained is null or end is not null").withColumn(by, F.coalesce("end", by))
    rest, path = written(rest.select(*edges.columns), "chains")
    return Chains(of, rows, rest, rounds, [done, path])
