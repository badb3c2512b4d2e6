"""Growth in the order in which nodes show up in a stream.

``first_arrivals`` keeps one row of state for each key and takes late events as
they come: the earliest event time counts, whenever it is read. ``arrived`` runs
a stream over all that its source has and leaves its state as a table;
``arrival_order`` makes of it an order of nodes, as growth by preferential
attachment takes one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.operators.frame import GeoFrame, as_nodes, numbered
from geoweft.operators.shared import shared_folder


def first_arrivals(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, arrived): the earliest time of each key of a stream (or table) of events; events without a key or time don't count."""
    some = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return some.groupBy(F.col(key).alias("key")).agg(F.min(time).alias("arrived"))


def arrived(spark: SparkSession, arrivals: DataFrame) -> DataFrame:
    """The table that a stream of arrivals has come to once its source is read to the end. A run that breaks off goes on where it was."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/table-{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    run = arrivals.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(last[0]) if last else spark.createDataFrame([], arrivals.schema)


def arrival_order(frame: GeoFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """(rank, node_pos): nodes by the time of arrival of their ``key``; those that never arrived come last, ties by position."""
    nodes = as_nodes(frame).select("node_pos", F.col(f"`{key}`").alias("key")).join(arrivals, "key", "left")
    return numbered(nodes.select("node_pos", "arrived"), [F.col("arrived").asc_nulls_last(), F.col("node_pos")], "rank").select("rank", "node_pos")
