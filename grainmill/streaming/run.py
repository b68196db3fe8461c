"""Run a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is available to parquet, then stop.

    ``checkpoint`` holds offsets and state: started again with the same folder, the stream
    goes on after the input that it has already used.
    """
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``start_to_table``, wait for the end, and read the written table."""
    start_to_table(df, path, checkpoint).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
