"""Splitting documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import Splitter


def stream_documents(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def split_stream(docs: DataFrame, splitter: Splitter, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends the chunks of each new document to `out`, each exactly once. A splitter looks at one row at a time, so no
    state is kept. Ends when all that is there has been split."""
    return (
        splitter.transform(docs).writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
