"""Facts arriving over time. No analysis here is over event time, so this is just a fold of new facts into tables.

A stream of messages or property values is merged batch by batch with ``foreachBatch``: the state table keeps one
value per element and property, and a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.lattice import DELAY


def folded(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(elem, property, v): a value once known stays; of a batch's values the least counts; delays give way to values."""
    new = batch.where(F.col("v") != DELAY).groupBy("elem", "property").agg(F.min("v").alias("_n"))
    waiting = batch.where(F.col("v") == DELAY).select("elem", "property").distinct().withColumn("_d", F.lit(DELAY))
    both = state.select("elem", "property", "v").join(new, ["elem", "property"], "full").join(waiting, ["elem", "property"], "full")
    return both.select("elem", "property", F.coalesce(F.when(F.col("v") != DELAY, F.col("v")), "_n", "v", "_d").alias("v"))


def fold_stream(values: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at ``path`` up to date with a stream of (elem, property, v); each version is a folder of its own."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 1}")
        there = number > 0 and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        schema = "elem string, property string, v int"
        state = spark.read.schema(schema).parquet(f"{path}/version={number - 1}") if there else spark.createDataFrame([], schema)
        folded(state, batch).write.mode("overwrite").parquet(f"{path}/version={number}")

    return values.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
