"""Row-local operators over streams: the same functions on an unbounded table, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.fingerprint import fingerprint


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def fingerprint_stream(docs: DataFrame, out: str, checkpoint: str):
    """Fingerprints of all documents there are, appended to a table; a restart goes on behind the last batch."""
    rows = fingerprint(docs)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
