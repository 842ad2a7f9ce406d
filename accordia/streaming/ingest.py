"""Records that arrive as JSON lines are added to a run once each, also after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(records: DataFrame, key: str = "item_id", arrived: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first record of each key, by a state that holds keys, on the executors that their hashes name.

    arrived: a timestamp column; a key is then forgotten `delay` after the latest arrival less the delay has passed it, so
    that the state holds the keys of that time alone. Without it, the state holds every key that was ever met. Records
    without a key are of one key; those without an arrival, or later than the delay, may come again.
    """
    if arrived is None:
        return records.dropDuplicates([key])
    return records.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "item_id", arrived: str | None = None, delay: str = "7 days", done: DataFrame | None = None) -> StreamingQuery:
    """Appends each record whose key has not come before to the Parquet folder target. Runs until the source is read.

    A batch reads its own records and the state, never the target. Files and state are committed together: a restart with
    the same checkpoint neither loses nor repeats a record. done: records of earlier runs (column key) to be left out; it
    alone is read anew for each batch. A line that is no object of the schema is an error.
    """
    records = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    if done is not None:
        old = done.select(F.col(key).alias("_done")).where("_done is not null").distinct()
        records = records.join(old, F.col(key) == F.col("_done"), "left_outer").where("_done is null").drop("_done")
    return once(records, key, arrived, delay).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
