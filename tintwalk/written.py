"""Written intermediate tables: what a fixpoint has found so far lives in the cluster's shared folder, not in executors' memory."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own if all tasks run in this machine's one process, as in tests."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return folder
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(paths: list[str]) -> Iterator[list[str]]:
    """Add to ``paths`` the tables that are written meanwhile, so that they can be :func:`dropped` once nothing reads them any more."""
    before = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(before)


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, with the path, so that a table which nothing reads any more can be dropped."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that were written here."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Grown:
    """A relation that a fixpoint adds to: each round writes its new rows, and all rounds are read as one table.

    The lineage of a round ends at the tables written before, so a lost executor costs the tasks it ran and no more. Rows are counted
    while they are written, so a round is one job. Rounds that were merged are deleted.
    """

    #: Written rounds that are read one by one before they are merged into one table.
    MERGED_AT = 16

    def __init__(self, spark: SparkSession, schema: StructType, name: str):
        self.spark, self.schema, self.name = spark, schema, name
        self.paths: list[str] = []
        self.rows = 0
        self.rounds: list[int] = []

    def _write(self, df: DataFrame, ahead: Column) -> tuple[str, int, int]:
        path = _path(self.spark, self.name)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(ahead, 1)).alias("ahead")).write.parquet(path)
        return path, seen.get["n"], seen.get["ahead"]

    def add(self, rows: DataFrame, ahead: Column | None = None) -> DataFrame | None:
        """Write ``rows`` (none of which is in the relation) and return those for which ``ahead`` holds (None: all) as read back, or None if there are none."""
        ahead = F.lit(True) if ahead is None else ahead
        path, n, on = self._write(rows.select(*self.schema.names), ahead)
        self.rounds.append(n)
        if not n:
            dropped(self.spark, [path])
            return None
        self.rows += n
        self.paths.append(path)
        if len(self.paths) > self.MERGED_AT:  # but for the last round, which is read on
            merged = self._write(self.spark.read.schema(self.schema).parquet(*self.paths[:-1]), F.lit(True))[0]
            dropped(self.spark, self.paths[:-1])
            self.paths = [merged, path]
        return self.spark.read.schema(self.schema).parquet(path).where(ahead) if on else None

    def all(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def ranked(df: DataFrame, *order: Column, name: str = "ranked") -> DataFrame:
    """``df`` (written) with ``rank``: 0-based position in ``order``, gapless over the whole table.

    One range-partitioned sort; positions inside a partition are added to the totals of the partitions before it, a table of one
    row per partition, which is all that is broadcast.
    """
    order = order or tuple(F.col(c) for c in df.columns)
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("_part")).count()
    parts = parts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn("rank", rank).drop("_at", "_part", "_base")
