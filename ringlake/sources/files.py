"""A sink of small files: one for each row, made by the task that holds it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ringlake.sources.formats import pieces, save_files


def write_files(rows: DataFrame, path: str, name: str, content: Callable[..., bytes], overwrite: bool = False) -> int:
    """Write ``content(row)`` of each row to the file in its column ``name`` in the folder ``path``, a URI; returns the number of rows.

    Files appear when all tasks are done, or not at all; a task that is run again replaces
    what it wrote. Two rows of one name are an error, as is a name that is there already
    unless it is to be overwritten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = [(getattr(row, name), content(row)) for row in part.to_pandas().itertuples(index=False)]
                names, contents = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    return save_files(rows.mapInArrow(run, "name string, content binary"), path, overwrite)
