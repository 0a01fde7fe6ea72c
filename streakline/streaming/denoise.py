"""Structured Streaming: images arrive as rows of slices and are denoised one by one, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..kernels.images import Params
from ..plans import denoise


def slice_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(denoise.SLICES.format("double")).option("maxFilesPerTrigger", max_files).parquet(path)


def denoise_stream(stream: DataFrame, mode: str = "streak", params: Params | None = None, multiscale: bool = False) -> DataFrame:
    """Normalisation is by slice: the ends of a whole stack are not known in a stream."""
    return denoise.remove_streaks(stream, mode, params, multiscale, "slice")


def write_stream(result: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
