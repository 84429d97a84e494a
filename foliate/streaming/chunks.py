"""Chunking of streams. The pattern path is row-local, so it needs no state, watermark or shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliate.plans.chunker import Chunker


def chunk_stream(docs: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """The chunks of a stream of (source_id, text), as a stream."""
    chunker = chunker or Chunker()
    if chunker.config and chunker.config.inherit_parent_keywords:
        raise ValueError("keywords of parents need a join of chunks; run it on the written chunks")
    return chunker.process(docs).chunks


def read_documents(spark: SparkSession, path: str, schema: str = "source_id string, text string", format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to a Parquet table, each chunk exactly once; the checkpoint remembers what has been read."""
    writer = chunks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
