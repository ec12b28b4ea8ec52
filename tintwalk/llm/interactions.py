"""Audit of how filters interact: what each removes, by source and by the order in which they are applied.

A document fails some of five filters, which makes one of 32 sets of failures. In an order, it goes at the first filter of the order that it fails: a table
of 32 by 120, made once, gives that step for each set and each order. Tasks look their documents up in it and count removals by order, step and label into
arrays, one a source, which are then summed. The rest of the audit follows from these sums: what fails a filter is what it removes when it
comes first, and what fails it alone is what it removes when it comes last.

Filters, on whole texts: A few words, B repeated words, C capitals, D symbols, E text of an earlier document.

Defined cases: null texts are empty, so that all null and empty texts are one text; null sources are the source ''; a document without an id is
earlier than none and has none before it, nor labels; rows of one id and text are all first or none; labels that repeat count if any row does;
other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.llm.common import SPACE, cut, table

FILTERS = "ABCDE"
ORDERS = tuple("".join(order) for order in permutations(FILTERS))
KEPT = len(FILTERS)
#: Parts counted at once in a task; a task that has met so many gives out what it has.
HELD = 256
WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def first_failures() -> np.ndarray:
    """``[failures, order]``: the step, from 0, of the first filter of the order that is among the failures, ``KEPT`` if none is; bit i of the failures is FILTERS[i]."""
    places = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS])
    fails = (np.arange(1 << len(FILTERS))[:, None, None] >> places) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), KEPT)


def failures(text: Column) -> Column:
    """What ``text`` fails of the filters that look at it alone, as bits."""
    words = F.array_remove(F.split(text, SPACE), "")
    few = F.size(words) < WORDS
    repeated = 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words)
    capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]++", "")) > CAPITAL_PERCENT * F.length(text)
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, repeated, capitals, text.rlike(SYMBOLS)))]
    return sum(bits[1:], bits[0])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, failures, good, toxic, n)`` from ``docs(doc_id, text, source)``; rows of one document, and of one text with equal labels, may share a row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("failures"), F.unhex(F.sha2(text, 256)).alias("name"))
    rows = cut(rows, "failures")
    # ids without a document can't meet; those that are null go by the text, so that they don't all meet in one task
    id_key = [F.coalesce("doc_id", F.hash("name").cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.lit(False).alias("no_id"))
    known = known.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.select("*", *id_key).join(known, ["id", "no_id"], "left").select("doc_id", "part", "failures", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    first = rows.groupBy("name").agg(F.min("doc_id").alias("first"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failed = F.col("failures") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, "name").select("part", failed.alias("failures"), "good", "toxic")


def removals(rows: DataFrame) -> DataFrame:
    """``(part, order, step, removed, good, toxic)`` for every part, order and step from 0; step ``KEPT`` has what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, orders, steps = first_failures(), len(ORDERS), KEPT + 1
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            cells = orders * steps
            order, step = (np.tile(x.ravel(), len(held)) for x in np.divmod(np.arange(cells), steps))
            sums = np.concatenate([x.reshape(3, cells) for x in held.values()], axis=1)
            part = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), cells)))
            arrays = [part, pa.array(order.astype(np.int32)), pa.array(step.astype(np.int32)), *map(pa.array, sums)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["part", "order", "step", "removed", "good", "toxic"])

        for batch in batches:
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False)
            fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for at, name in enumerate(part.dictionary.to_pylist()):
                here = np.flatnonzero(code == at)
                cells = lookup[fails[here]] + steps * np.arange(orders)  # a row for each document, a column for each order
                counts = [np.bincount(cells[chosen].ravel(), minlength=orders * steps) for chosen in (slice(None), good[here] == 1, toxic[here] == 1)]
                held[name] = held.get(name, 0) + np.stack(counts)
                if len(held) >= HELD:
                    yield given()
        if held:
            yield given()

    found = rows.mapInArrow(run, "part string, order int, step int, removed long, good long, toxic long")
    return found.groupBy("part", "order", "step").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: five rows for each part and order."""
    orders = F.array(*[F.lit(order) for order in ORDERS])
    rows = cut(removals(labelled(docs, labels)), "removals").withColumn("filter_order", F.get(orders, F.col("order"))).withColumn("filter", F.substring("filter_order", F.col("step") + 1, F.lit(1)))
    after = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    of_filter = Window.partitionBy("part", "filter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(of_filter)
    rows = rows.withColumn("kept", F.sum("removed").over(after)).where(F.col("step") < KEPT)
    return rows.select(
        "part",
        "filter_order",
        (F.col("step") + 1).alias("step"),
        "kept",
        "removed",
        (at(0) - F.col("removed")).alias("redundant"),
        at(KEPT - 1).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(of_filter).alias("shapley"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t LEFT JOIN l USING (doc_id)),
groups AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
lost AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM groups, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM lost"""
