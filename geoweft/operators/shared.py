"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. In a local session that names none it is a temporary one; elsewhere it must be set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Parquet tables of one computation.

    Read again, a table has neither a lineage nor estimates of what it was made from, so that rounds over it plan alike however many there
    are. As a context, it removes the tables that haven't been ``kept`` when it is left, by an error too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/geoweft-{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                remove(self.spark, self.paths.pop(id(t))[0])

    def kept(self, table: DataFrame) -> DataFrame:
        """Lets a table live on after the computation, until ``release``."""
        self.paths.pop(id(table), None)
        return table

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(*(t for _, t in list(self.paths.values())))


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, for good."""
    tables = Tables(df.sparkSession)
    return tables.kept(tables.write(df))


def release(spark: SparkSession) -> None:
    """Removes all tables that graphs of this application stand on; frames that read them can't be used any more."""
    remove(spark, f"{shared_folder(spark)}/geoweft-{spark.sparkContext.applicationId}")
