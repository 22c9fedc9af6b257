"""Frames as they arrive: a file stream of TIFF files whose results are appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringlake.functions.naming import base_name, scan_value
from ringlake.sources.results import save_results
from ringlake.sources.tiff import READ, _decoded

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def frame_stream(spark: SparkSession, path: str, files_a_batch: int = 500) -> DataFrame:
    """A stream of frames, ``files_a_batch`` files a batch at most."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("maxFilesPerTrigger", files_a_batch).load(path)
    decoded = files.select("path", "content").mapInPandas(lambda batches: (_decoded(b) for b in batches), READ)
    name = base_name(F.col("path"))
    return decoded.select(F.xxhash64("path").alias("frame_id"), "path", name.alias("filename"), scan_value(name).alias("xps_value"), "height", "width", "dtype", "pixels", "error")


def append_results(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, bins: int, checkpoint: str) -> StreamingQuery:
    """Process each batch of the stream and write its results; a restart goes on where the last one ended.

    A batch has a folder of its own, ``out/batch_id=N``, which it overwrites: one that was
    written and then failed to be committed is replaced when Spark runs it again.
    """

    def write(batch: DataFrame, number: int) -> None:
        save_results(process(batch), f"{out}/batch_id={number}", bins, mode="overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
