"""Incremental forms of the append load and of the monthly incident counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregate import rows
from tidemark.sources.tables import CSV_READ, schema_of


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV exports arriving in a folder; the header of each is checked against the schema."""
    return spark.readStream.schema(schema_of(schema)).options(**CSV_READ).csv(folder)


def _stored(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers; none if it is not there yet."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise


def append_available(stream: DataFrame, target: str, checkpoint: str) -> int:
    """Append all files not loaded yet to a Parquet table; rows added.

    The checkpoint remembers the loaded files, so that a repeated or resumed
    run adds each of them once. The receipt is the table's growth, whatever the
    number of micro-batches.
    """
    before = _stored(stream.sparkSession, target)
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _stored(stream.sparkSession, target) - before


def monthly_counts(stream: DataFrame, date: str, key: str, lateness: str = "7 days") -> DataFrame:
    """Running incident counts per month, each key counted once.

    Repeats are dropped while they arrive within the allowed lateness; the key
    state is released behind the watermark.
    """
    first = stream.withWatermark(date, lateness).dropDuplicatesWithinWatermark([key])
    return first.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(rows().alias("crashes"))
