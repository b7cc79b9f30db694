"""A frozen pipeline on a stream: it keeps no state and drops no row, so it is the same projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import PrepModel


def prepared_stream(model: PrepModel, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("prepared_stream takes a streaming DataFrame; transform() takes others.")
    return model.transform(stream)


def write_stream(model: PrepModel, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the prepared rows of a stream to Parquet files, each row once."""
    return (
        prepared_stream(model, stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )
