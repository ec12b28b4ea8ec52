"""Removal of passages that an earlier document has, word for word.

A window is ``WINDOW`` consecutive words. Its minimiser is the run of ``RUN`` words in it with the smallest hash, the leftmost of equal ones, so that equal windows have
equal minimisers. Consecutive windows with one minimiser travel as one packed string of words to the bucket of that minimiser. There all windows of the
bucket are cut out and sorted, and those that an earlier document has too are told from the order. What such windows cover is removed.

Only what can repeat travels. Equal texts are collapsed first: of a text that an earlier document has whole, each window goes. Then minimisers alone are
counted, and windows sent if their minimiser stands in two texts or more. A minimiser that stands in more than ``BUCKET`` places would make a bucket too
large for a task. Its windows are compared by digests of 128 bits, each in a bucket of its own: first those of chunks, runs of such stretches that end at minimisers of a
kind, so that equal passages have equal chunks; then, of the earliest document of each chunk, single stretches; then, of the earliest of each stretch, single windows.
What an earlier document has whole is settled at each step, so that a passage in very many documents sends few rows for each.

Defined cases: null texts are empty; a document without an id is neither earlier nor later than any, so it loses nothing and takes nothing away; documents of one id
don't take from each other; texts shorter than a window keep all their words; repeated rows get equal results; words of over ``LONG`` bytes are compared by
a digest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, table

WINDOW, RUN, BUCKET = 50, 8, 4096
#: One minimiser in so many ends a chunk.
ENDS = 16
#: Longer words travel as their digest, behind a character that no word holds.
LONG = 64
#: Windows whose minimisers are found at a time, which bounds memory on very long texts.
CHUNK = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
NOTHING = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # on bytes: ASCII white space


def _digest(value: bytes) -> bytes:
    return hashlib.blake2b(value, digest_size=16).digest()


def packed(words: list[bytes]) -> bytes:
    return b" ".join(w if len(w) <= LONG else b"\t" + _digest(w).hex().encode() for w in words)


def stretches(words: list[bytes], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, minimiser)`` of each stretch of consecutive windows that share a minimiser in the same place."""
    import xxhash

    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    runs = hashes[: len(words) - run + 1].copy()
    for i in range(1, run):
        runs = runs * ODD + hashes[i : i + len(runs)]
    runs = (runs ^ runs >> np.uint64(32)) * ODD
    runs ^= runs >> np.uint64(29)
    across = window - run + 1
    places = np.concatenate([np.lib.stride_tricks.sliding_window_view(runs[at : at + CHUNK + across - 1], across).argmin(axis=1) + at for at in range(0, n, CHUNK)])
    places += np.concatenate([np.arange(min(CHUNK, n - at)) for at in range(0, n, CHUNK)])
    start = np.flatnonzero(np.diff(places, prepend=-1))
    return start, np.diff(start, append=n), runs[places[start]].view(np.int64)


def surveyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, n_words, whole, minimisers)`` (written) for each row: the text's digest, and its words', and a minimiser for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, wholes, found = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                counts.append(len(words))
                wholes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(stretches(words)[2])
            arrays = [pa.array(counts, pa.int64()), pa.array(wholes), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "name", "n_words", "whole", "minimisers"])

    schema = "doc_id long, name binary, n_words long, whole string, minimisers array<long>"
    return cut(docs.select("doc_id", _name(), "text").mapInArrow(run, schema), "surveyed")


def _name() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("name")


def suspects(docs: DataFrame, texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(name, doc_id, text, wanted, hot)`` (written): distinct texts that share minimisers with others, with those of small buckets and of large ones."""
    each = texts.select("name", "doc_id", F.explode("minimisers").alias("minimiser"))
    counts = each.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    counts = counts.where("low < high").select("minimiser", (F.col("n") > bucket).alias("large"))
    shared = texts.select("name", "doc_id", F.explode(F.array_distinct("minimisers")).alias("minimiser")).join(counts, "minimiser")
    lists = [F.collect_list(F.when(F.col("large") == large, F.col("minimiser"))).alias(name) for large, name in ((False, "wanted"), (True, "hot"))]
    shared = cut(shared.groupBy("name", "doc_id").agg(*lists), "shared")
    key = ["name", "doc_id"]  # met without the lists first, which is a small table as long as few texts share anything
    texts = docs.select("doc_id", _name(), "text").join(shared.select(*key), key, "left_semi").join(shared, key)
    return cut(texts.dropDuplicates(["name"]), "suspects")


def _pieces(rows: DataFrame, keep: list[str], made, schema: str) -> DataFrame:
    """``made(words, stretches)`` gives the tuples that follow ``name, doc_id``, from the stretches whose minimisers are in the column ``keep`` names, or, if it
    names two, which start within the ranges that these columns give by start and windows."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, doc_id, text, *wanted in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                words = words_of(text)
                found = stretches(words)
                if len(wanted) == 1:
                    chosen = np.isin(found[2], np.array(wanted[0], dtype=np.int64))
                else:
                    begins, lengths = np.array(sorted(zip(*wanted, strict=True)), dtype=np.int64).T
                    at = np.maximum(np.searchsorted(begins, found[0], side="right") - 1, 0)
                    chosen = (begins[at] <= found[0]) & (found[0] < begins[at] + lengths[at])
                pieces = [(name, doc_id, *piece) for piece in made(words, list(zip(*(x[chosen].tolist() for x in found), strict=True)))]
                for at in range(0, len(pieces), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pieces[at : at + CHUNK], strict=True)], names=names)

    return rows.where(F.size(keep[0]) > 0).select("name", "doc_id", "text", *keep).mapInArrow(run, schema)


def repeats(rows: Iterable[tuple[bytes, int, int, bytes]], window: int = WINDOW) -> list[tuple[bytes, int, int]]:
    """``(name, start, windows)``: which windows of a bucket's ``(name, doc_id, start, packed)`` an earlier document has too. Packed strings that
    an earlier document has whole are told apart by sorting them, windows of the others by sorting the windows."""
    found, cuts = [], []
    for string, same in groupby(sorted(rows, key=itemgetter(3, 1)), key=itemgetter(3)):
        ends = np.cumsum([len(w) + 1 for w in string.split(b" ")]).tolist()
        begins, first = [0, *ends], None
        for name, doc_id, start, _ in same:
            first = doc_id if first is None else first
            if doc_id > first:
                found.append((name, start, len(ends) - window + 1))
            else:
                cuts += [(string[begins[i] : ends[i + window - 1] - 1], doc_id, name, start + i) for i in range(len(ends) - window + 1)]
    cuts.sort(key=itemgetter(0, 1))
    for _, same in groupby(cuts, key=itemgetter(0)):
        first = None
        for _, doc_id, name, at in same:
            first = doc_id if first is None else first
            if doc_id > first:
                found.append((name, at, 1))
    return found


def _in_buckets(rows: DataFrame) -> DataFrame:
    """``(name, start, windows)`` that repeat, of stretches whose minimisers are in ``wanted``."""

    def whole(words: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple]:
        return [(minimiser, start, packed(words[start : start + windows + WINDOW - 1])) for start, windows, minimiser in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_order = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for _, bucket in groupby(in_order, key=itemgetter(0)):
            if found := repeats(row[1:] for row in bucket):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["name", "start", "windows"])

    strings = _pieces(rows, ["wanted"], whole, "name binary, doc_id long, minimiser long, start long, packed binary").select("minimiser", "name", "doc_id", "start", "packed")
    return strings.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, "name binary, start long, windows long")


def _by_digests(rows: DataFrame) -> DataFrame:
    """As :func:`_in_buckets`, of stretches whose minimisers are in ``hot``."""

    def chunks(words: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple]:
        made, end = [], None
        for start, windows, minimiser in found:
            if start == end:
                made[-1][1] += windows
            else:
                made.append([start, windows])
            end = start + windows if minimiser % ENDS else None
        return strings(words, made)

    def strings(words: list[bytes], found: list) -> list[tuple]:
        return [(_digest(b" ".join(words[start : start + windows + WINDOW - 1])), start, windows) for start, windows, *_ in found]

    def singles(words: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple]:
        return strings(words, [(at, 1) for start, windows, _ in found for at in range(start, start + windows)])

    def judged(rows: DataFrame, keep: list[str], made) -> DataFrame:
        pieces = cut(_pieces(rows, keep, made, "name binary, doc_id long, digest binary, start long, windows long"), "pieces")
        first = pieces.groupBy("digest").agg(F.min("doc_id").alias("first"))
        later = (F.col("doc_id") > F.col("first")).alias("later")
        return cut(pieces.join(first, "digest").select("name", "start", "windows", later), "judged")

    rows = rows.where(F.size("hot") > 0)
    found = judged(rows, ["hot"], chunks)
    repeated = found.where("later")
    for made in (strings, singles):
        own = found.where("not later").groupBy("name").agg(F.collect_list(F.struct("start", "windows")).alias("own"))
        rest = rows.select("name", "doc_id", "text").join(own.select("name", "own.start", "own.windows"), "name")
        found = judged(rest, ["start", "windows"], made)
        repeated = repeated.unionByName(found.where("later"))
    return repeated.drop("later")


def repeated(rows: DataFrame) -> DataFrame:
    """``(name, start, windows)``: windows of ``suspects`` that a document with a smaller doc_id has too."""
    return _in_buckets(rows).unionByName(_by_digests(rows))


def cleaned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(name, n_removed, kept)``: texts of ``suspects`` without what the windows in ``found(name, start, windows)`` cover; kept is a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for text, starts, windows in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = words_of(text)
                begins = np.bincount(starts, minlength=len(words) + 1)
                ends = np.bincount(np.add(starts, windows) + WINDOW - 1, minlength=len(words) + 1)
                stay = np.flatnonzero(np.cumsum(begins - ends)[:-1] == 0).tolist()
                counts.append(len(words) - len(stay))
                kept.append(hashlib.sha256(b" ".join(words[i] for i in stay)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=["name", "n_removed", "kept"])

    places = found.groupBy("name").agg(F.collect_list(F.struct("start", "windows")).alias("at"))
    rows = rows.select("name", "text").join(places, "name").select("name", "text", "at.start", "at.windows")
    return cut(rows.mapInArrow(run, "name binary, n_removed long, kept string"), "cleaned")


def without_repeats(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``."""
    all_rows = surveyed(docs)
    texts = cut(all_rows.where("doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.any_value("minimisers").alias("minimisers")), "texts")
    rows = suspects(docs, texts, bucket)
    changed = texts.select("name", F.col("doc_id").alias("first")).join(cleaned(rows, repeated(rows)), "name", "left")
    told = all_rows.drop("minimisers").join(changed, "name", "left")
    earlier = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    copy, own = earlier & (F.col("n_words") >= WINDOW), F.col("doc_id").isNotNull() & ~earlier & F.col("kept").isNotNull()
    pick = lambda if_copy, if_own, otherwise: F.when(copy, if_copy).when(own, if_own).otherwise(otherwise)
    n_removed = pick(F.col("n_words"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed")
    return told.select("doc_id", "n_words", n_removed, pick(F.lit(NOTHING), F.col("kept"), F.col("whole")).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT r, doc_id, k, array_to_string(words[k:k + 49], ' ') AS w FROM d, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS k)),
repeated AS (SELECT r, k FROM (SELECT r, k, doc_id > min(doc_id) OVER (PARTITION BY w) AS later FROM windows) WHERE later),
gone AS (SELECT DISTINCT r, k + i AS k FROM repeated, range(50) t(i)),
words AS (SELECT r, k, words[k] AS word FROM d, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS k)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
