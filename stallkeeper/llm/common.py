"""Shared helpers: stored intermediate tables, bounded Arrow batches, small column helpers."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallkeeper.functions import checkpoint_dir
from stallkeeper.plans.session import tune as tune_plans

BLANK = r"[^\x20\x09-\x0D]+"  # a word: a run without ASCII white space


def tune(spark: SparkSession) -> SparkSession:
    """Session settings: adaptive plans that split skewed joins, and Arrow batches of few rows, so that
    a Python task holds a bounded number of long texts at a time."""
    tune_plans(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run inside, whose rows are narrow."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, rows: int | None = None, each: int = 50_000) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage is cut, lost executors cost
    nothing, and several branches read one result.

    If at most ``rows`` rows go into the frame, a task writes what comes of ``each`` of them (but no core is left
    idle), so that a small frame does not become one file of a few rows for every shuffle partition."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))
    path = scratch_path(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that no column of a caller's table can clash with one of ours.
    ``select("row.*")`` brings the columns back."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def words_in(text: str | Column) -> Column:
    """Number of words of a text, 0 for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(BLANK)), F.lit(0)).cast("bigint")


class Memo(dict):
    """What a pure function gave for recent keys: two generations of at most ``limit`` keys each, so that the
    frequent keys survive and memory is bounded. Long keys are not kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Spill:
    """A list of byte strings: the first ``limit`` bytes in memory, the rest as files below ``folder``, which all
    machines share and the application deletes when it ends. Every object has names of its own, so a task that runs
    twice does not meet its first run's files; ``clear`` removes them as soon as they are not needed."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held = folder, limit, 0
        self.parts: list[bytes | str | None] = []
        self.store = None

    def _path(self, name: str) -> str:
        if self.store is None:
            from pyarrow import fs
            self.store, root = fs.FileSystem.from_uri(self.folder)
            self.root = f"{root}/spill-{uuid.uuid4().hex}"
            self.store.create_dir(self.root, recursive=True)
        return f"{self.root}/{name}"

    def __len__(self) -> int:
        return len(self.parts)

    def append(self, data: bytes) -> None:
        if self.held + len(data) <= self.limit:
            self.held += len(data)
            self.parts.append(data)
        else:
            name = str(len(self.parts))
            path = self._path(name)
            with self.store.open_output_stream(path) as out:
                out.write(data)
            self.parts.append(name)

    def __getitem__(self, i: int) -> bytes:
        part = self.parts[i]
        if isinstance(part, str):
            with self.store.open_input_stream(self._path(part)) as source:
                return source.read()
        return part

    def clear(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.root)
        self.parts, self.held, self.store = [], 0, None
