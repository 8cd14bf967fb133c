"""The per-text operators over arriving files: each is a projection, so the batch plan is the streaming plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.sources.files import utf8_text


def arriving_texts(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id (the path) and text of text files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.col("path").alias("doc_id"), utf8_text(F.col("content")).alias("text"))


def write_analyzed(texts: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that applies operator (docs to rows, without a shuffle) and appends to path; processes what is there, then ends."""
    return operator(texts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
