"""Audit of how far the sources of a language differ in their words.

Each language keeps the terms that stand in ``LEAST`` of its documents. What a term has in each source is a sparse vector of counts, and terms of equal
vectors add the same to every pair of sources. So terms are grouped by their vector; every pair of sources is evaluated once for each distinct
vector, and counted as often as there are terms of it. The terms that set a source apart from its language are ranked one by one.

All arithmetic is on whole numbers. Of a group with N occurrences of the V kept terms, a term with ``count`` of them has the share p = 1 + floor(SCALE (count + 1)
/ (N + V)), and p differs from q by floor((p - q)^2 / q).

Defined cases: null texts, languages and sources are ''; a source of a language without kept terms differs from the others by 0; a language with one
source has no pairs; repeated rows count as documents; other columns are ignored; a sum beyond a long is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, table

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Distinct terms of sources that a task counts in memory before it gives them out; cells of vectors that are evaluated at once, and of sums that are held.
HELD, CELLS, SUMS = 1 << 18, 1 << 20, 1 << 22
#: In UTF-8, the bytes that aren't of a term are ASCII ones but letters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)`` (written) from ``docs(text, lang, source)``, and a row of null term for each lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, in_docs) in held.items():
                terms = [None, *(t.decode() for t in counts)]
                arrays = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                numbers = [pa.array([0, *x], pa.int64()) for x in (counts.values(), (in_docs[t] for t in counts))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(terms, pa.string()), *numbers], names=["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts, in_docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                before = len(counts)
                here = Counter((text or "").encode().translate(LETTERS).split())
                counts.update(here)
                in_docs.update(here.keys())
                size += len(counts) - before + 1  # so that sources without terms count too
                if size > HELD:
                    yield from given()
                    size = 0
        yield from given()

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return cut(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")


def _shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if counts.max(initial=0) < 1 << 33:
        return 1 + (counts + 1) * SCALE // sizes
    return np.array([1 + (int(c) + 1) * SCALE // int(n) for c, n in zip(counts, sizes, strict=True)], dtype=np.int64)


def _differences(shares: np.ndarray, repeats: np.ndarray) -> Iterator[np.ndarray]:
    """For each source, how far every other one's share differs from its own, over all vectors ``shares[vector, source]``, each as often as ``repeats`` says."""
    for a in range(shares.shape[1]):
        apart = shares[:, a : a + 1] - shares
        each = apart * apart // shares
        if int(each.max(initial=0)) * int(repeats.sum()) < 1 << 62:
            yield repeats @ each
        else:
            yield _fitting(repeats.astype(object) @ each.astype(object))


def _fitting(sums: np.ndarray) -> np.ndarray:
    if max(sums) >= 1 << 63:
        raise OverflowError("sources differ by more than a long can hold")
    return sums.astype(np.int64)


def pair_sums(vectors: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` by places in the language's list of sources, from distinct ``vectors(lang, places, counts, repeats, sizes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        cells = 0

        def given() -> pa.RecordBatch:
            lengths = [len(x) for x in sums.values()]
            keys = pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32())
            lang, a = (k.take(pa.array(np.repeat(np.arange(len(lengths)), lengths))) for k in keys)
            b = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            value = np.concatenate(list(sums.values()))
            sums.clear()
            return pa.RecordBatch.from_arrays([lang, a, pa.array(b), pa.array(value)], names=["lang", "a", "b", "value"])

        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)
            for at, name in enumerate(lang.dictionary.to_pylist()):
                here = batch.filter(pa.array(code == at))
                sizes = np.asarray(here.column(4)[0].as_py(), dtype=np.int64)
                rest = _shares(np.zeros(len(sizes), dtype=np.int64), sizes)
                step = max(CELLS // len(sizes), 1)
                for begin in range(0, here.num_rows, step):
                    part = here.slice(begin, step)
                    places, counts = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
                    shares = np.tile(rest, (part.num_rows, 1))
                    lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    shares[np.repeat(np.arange(part.num_rows), lengths), places] = _shares(counts, sizes[places])
                    for a, more in enumerate(_differences(shares, part.column(3).to_numpy(zero_copy_only=False))):
                        before = sums.get((name, a))
                        if before is None:
                            cells += len(more)
                        elif int(before.max()) + int(more.max()) < 1 << 63:
                            more = before + more
                        else:
                            more = _fitting(before.astype(object) + more.astype(object))
                        sums[name, a] = more
                        if cells > SUMS:
                            yield given()
                            cells = 0
        if sums:
            yield given()

    found = vectors.select("lang", "places", "counts", "repeats", "sizes").mapInArrow(run, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: Column, size: Column) -> Column:
    return 1 + F.floor(F.lit(SCALE).cast("decimal(11,0)") * (count + 1).cast("decimal(19,0)") / size.cast("decimal(19,0)")).cast("long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: in part 'pair' how far each other source differs, in part 'term' the ``top`` terms that set the source apart."""
    counts = counted(docs)
    vector = F.sort_array(F.collect_list(F.struct("source", "count"))).alias("vector")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(vector, F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = cut(kept.select("lang", "term", "vector"), "terms")
    each = kept.select("lang", "term", "vector", F.explode("vector").alias("of"))
    n = each.groupBy("lang", "of.source").agg(F.sum("of.count").alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = counts.where("term is null").select("lang", "source").join(n, ["lang", "source"], "left").join(v, "lang", "left")
    groups = cut(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    of_lang = F.sort_array(F.collect_list(F.struct("source", (F.col("n") + F.col("v")).alias("size"))))
    langs = groups.groupBy("lang").agg(of_lang.alias("s"), (F.sum("n") + F.max("v")).alias("size"))
    langs = cut(langs.select("lang", "size", F.col("s.source").alias("sources"), F.col("s.size").alias("sizes")), "langs")

    vectors = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("repeats")).join(langs, "lang")
    places = F.transform("vector", lambda x: (F.array_position("sources", x.source) - 1).cast("int"))
    sums = pair_sums(vectors.select("lang", places.alias("places"), F.col("vector.count").alias("counts"), "repeats", "sizes"))
    grid = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    pairs = grid.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["count"])
    words = each.select("lang", "term", "of.source", "of.count", whole.alias("whole")).join(langs.select("lang", "size"), "lang")
    words = words.join(groups.select("lang", "source", (F.col("n") + F.col("v")).alias("own")), ["lang", "source"])
    words = words.select("lang", "source", "term", _share(F.col("count"), F.col("own")).alias("p"), _share(F.col("whole"), F.col("size")).alias("q")).where("p > q")
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    few = words.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(few)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS count FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counts AS (SELECT lang, source, term, count(*) AS count FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(count) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT lang, source, sum(count) AS n FROM counts GROUP BY ALL) USING (lang, source)),
shares AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(counts.count, 0) AS count,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(counts.count, 0) + 1) // CAST(groups.n + v.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (kept.count + 1) // CAST(v.n + v.v AS HUGEINT) AS q
  FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source AND counts.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE count > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200"""
