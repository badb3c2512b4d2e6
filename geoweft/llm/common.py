"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What Python workers are started with: memory that a task has freed goes back to the system, not to a pool of a worker that lives on.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "262144"}
#: Bytes of an Arrow batch, of which a task holds several on both sides, and rows of it that are taken at once.
BATCH_BYTES, BATCH_ROWS = "4m", 256
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package. Where the session leaves the size of Arrow batches at Spark's 64 MB, it becomes BATCH_BYTES."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Applies ``fn`` to the columns of each Arrow batch, given and returned as lists."""
    return map_task(df, lambda batches: map(fn, batches), schema)


def map_task(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """The same with a function of all batches of a task."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        parts = (batch.slice(i, BATCH_ROWS).to_pydict() for batch in batches for i in range(0, batch.num_rows, BATCH_ROWS))
        try:
            for out in fn(parts):
                yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in arrow}, schema=arrow)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives a worker's free memory back, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def streamed(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Runs ``fn`` over the rows of each task, one Arrow batch at a time; it yields columns as lists."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        try:
            for out in fn(rows):
                yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in arrow}, schema=arrow)
        finally:
            trim()

    return df.mapInArrow(run, schema)


#: Rows of a few columns that may be broadcast: about 10 MB.
BROADCAST_ROWS = 200_000
#: Parts of each key where a table is too large for that.
SALTS = 16


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` with the one row of ``right`` for each value of ``key``.

    A small right side is broadcast, by its count. A larger one is repeated for each of SALTS parts of a key, so that no value of any
    frequency gathers in one task. The part is a function of the row, so a task that runs twice deals alike.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salt = unused("salt", left, right)
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(many, [key, salt], how).drop(salt)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it. In a local session that names none it is a temporary folder; elsewhere it must be set."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return given or sc._jsc.sc().getCheckpointDir().get()


def collect_garbage(spark: SparkSession) -> None:
    """Spark removes shuffle files once the driver has collected the frames that made them; this asks it to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate Parquet tables of one call in the shared folder: as safe from lost executors as checkpoints, and smaller.

    ``forget`` removes one that is no longer read; ``last`` writes a result and removes all others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, sweep: bool = True) -> DataFrame:
        """Writes ``df`` and reads it again; sweep asks for the shuffle files behind it to be removed at once."""
        path = f"{checkpoint_dir(self.spark)}/geoweft-{uuid.uuid4().hex}"
        df.write.parquet(path)
        schema = df.schema
        del df
        if sweep:
            collect_garbage(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def forget(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[0])

    def last(self, df: DataFrame) -> DataFrame:
        before = list(self.paths.values())
        out = self.write(df)
        for path, _ in before:
            remove(self.spark, path)
        self.paths = {}
        return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
