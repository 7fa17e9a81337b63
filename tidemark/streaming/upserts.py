"""Keyed upserts of a stream into a Parquet table, once per change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of largest version for each key; one aggregate, combined before the shuffle.

    Equal versions are decided by the other columns in order, so the row is certain.
    """
    rest = [c for c in df.columns if c not in key and c not in version]
    picked = F.max(F.struct(*version, *rest)).alias("row")
    return df.groupBy(*key).agg(picked).select(*key, "row.*").select(*df.columns)


def upsert_available(stream: DataFrame, target: str, checkpoint: str, key: list[str], version: list[str]) -> None:
    """Write the changes of all files not loaded yet, a folder for each micro-batch.

    A batch that is repeated after a failure writes its own folder again, so no
    change counts twice. Within a batch only the newest row of a key is written.
    A new checkpoint numbers batches from 0 again and overwrites folders, so it is
    safe only where all files are still there to be loaded again.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, version).write.mode("overwrite").parquet(f"{target}/batch={number}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def current(spark: SparkSession, target: str, key: list[str], version: list[str]) -> DataFrame:
    """The table as of now: the newest row of each key over all batches.

    A change that arrives late, with a smaller version than what is stored, changes nothing.
    """
    return latest(spark.read.parquet(target).drop("batch"), key, version)
