"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at ``DISTANCE`` = 3 or fewer differing bits. Cut into ``SEGMENTS`` = 2, one of the halves of two linked
fingerprints differs by one bit at most, so they share a variant of it with that one bit deleted. Every distinct fingerprint is
indexed under each one-bit deletion of each half; fingerprints under one key are compared bit by bit.

Distinct fingerprints are collapsed first, so exact copies cost one index entry. A key with more than ``BLOCK`` fingerprints is split
into blocks that meet pairwise in different tasks; no case is dropped. A task gives, for each key and pair of blocks, edges that
connect what is linked, rather than all pairs; components are then the same.

Defined cases: null and empty texts and texts of white space have fingerprint 0, linked like any other; fewer words than a shingle give
one shingle; repeated rows have equal fingerprints; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import components, cut, table

DISTANCE, SEGMENTS, BITS, BLOCK = 3, 2, 64, 512
SHINGLE, SEED = 3, 42
#: Shingles hashed at a time, which bounds memory on very long texts.
CHUNK = 1 << 16


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    w = (text or "").encode().lower().split()  # on bytes: ASCII letters and ASCII white space
    n = max(len(w) - words + 1, min(len(w), 1))
    lanes = np.zeros((8, 256), dtype=np.int64)  # how often each byte value stands in each byte of the hashes
    for at in range(0, n, CHUNK):
        part = (b" ".join(w[i : i + words]) for i in range(at, min(n, at + CHUNK)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=min(n, at + CHUNK) - at)
        for lane, values in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            lanes[lane] += np.bincount(values, minlength=256)
    ones = lanes @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)  # by byte, then bit
    return sum(1 << bit for bit in np.flatnonzero(ones.ravel() * 2 > n).tolist())


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(text.as_py(), words) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, one, other, side, fp) sorted by (key, one, other): edges that connect linked fingerprints, for each key and pair of blocks."""
    held = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
        held = rows if held is None else np.concatenate([held, rows])
        new = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1))
        if len(new):
            yield _edges(held[: new[-1] + 1], distance)
            held = held[new[-1] + 1 :]
    if held is not None and len(held):
        yield _edges(held, distance)


def _edges(rows: np.ndarray, distance: int) -> pa.RecordBatch:
    group = np.concatenate([[0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(axis=1))])
    fp, side, same_block, segment, bit = rows[:, 4].view(np.uint64), rows[:, 3], rows[:, 1] == rows[:, 2], rows[:, 0] >> 40 & 1, rows[:, 0] >> 32 & 0xFF
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for step in range(1, len(rows)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        j = i + step
        apart = fp[i] ^ fp[j]
        half = np.where(segment[i] == 0, apart & np.uint64(0xFFFFFFFF), apart >> np.uint64(32))
        first = (half == 0) & (bit[i] == 0) | (half == np.uint64(1) << bit[i].astype(np.uint64))  # once, of the keys that the pair shares in this half
        ok = first & (np.bitwise_count(apart) <= distance) & (same_block[i] | (side[i] != side[j]))
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((rows[a, 4], rows[b, 4]))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` that connect the fingerprints of ``distinct(fp)`` linked at ``distance`` (3 at most) or fewer bits."""
    if distance > 2 * SEGMENTS - 1:
        raise ValueError("two segments find three differing bits at most")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    bits = [(segment, bit) for segment in range(SEGMENTS) for bit in range(BITS // SEGMENTS)]
    key = lambda segment, bit: F.lit(segment << 40 | bit << 32).bitwiseOR((high if segment else low).bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit)))
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # each row becomes 64
    index = spread.select("fp", F.explode(F.array(*[key(*x) for x in bits])).alias("key"))
    counts = index.groupBy("key").count().where(F.col("count") > 1)
    counts = counts.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    index = index.hint("merge").join(counts, "key")  # Spark sizes an explode as one row for each, and would broadcast all 64
    index = index.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("one"), F.greatest("own", other).alias("other")))
    rows = index.select("key", "fp", "own", F.explode(meets).alias("m")).select("key", "m.one", "m.other", (F.col("own") == F.col("m.other")).cast("int").alias("side"), "fp")
    rows = rows.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return rows.mapInArrow(lambda batches: _links(batches, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: the smallest doc_id reachable over links, itself included."""
    found = cut(fingerprints(docs, words), "simhash")
    least = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    groups = components(links(least.select("fp"), distance), "simhash")
    rooted = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(rooted, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
