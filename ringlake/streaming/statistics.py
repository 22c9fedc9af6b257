"""Statistics of a stream: each batch is merged into the state of those before it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringlake.operators.moments import merged, moments


def state_folder(folder: str, number: int) -> str:
    return f"{folder}/batch_id={number}"


def latest_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state after the last batch that was merged; None before the first."""
    try:
        states = spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    last = states.agg(F.max("batch_id")).first()[0]
    return None if last is None else spark.read.parquet(state_folder(folder, last))


def merge_batches(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Merge the `moments` of each batch into the state in ``folder``; a restart goes on where the last one ended.

    Batch N writes ``batch_id=N`` from ``batch_id=N-1`` and its own rows, so that one that
    was written and then failed to be committed is made again from the same state, and no
    row counts twice. A state has a row a key, however many rows there were. A batch without
    rows keeps the state as it is.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = moments(prepare(batch), keys, columns)
        if number > 0:
            state = merged(spark.read.schema(state.schema).parquet(state_folder(folder, number - 1)).unionByName(state), keys, columns)
        state.write.mode("overwrite").parquet(state_folder(folder, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
