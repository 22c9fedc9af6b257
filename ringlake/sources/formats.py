"""Python data sources: frames read from files that are chosen by name, and files that appear all at once."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ringlake.functions.naming import SCAN_TOKEN

FRAMES, FILES = "ringlake_frames", "ringlake_files"
SCHEMA = "path string, filename string, xps_value double, page int, height int, width int, dtype string, pixels array<double>, error string"
SUFFIXES = (".tif", ".tiff")
#: Bytes of files that a partition is planned to have.
PARTITION_BYTES = 64 << 20
#: Bytes that opening a file counts as: small files fill a partition by their number.
OPEN_BYTES = 32 << 10
#: Bytes of pixels that a task holds as one Arrow batch, one frame at least.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: Filters on what a file's name tells, and how they judge it.
JUDGES = {
    EqualTo: lambda x, y: x == y, EqualNullSafe: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, y: y in x,
}
NAMED = ("path", "filename", "xps_value")


def located(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return FileSystem.from_uri(path if ":" in path else f"file://{path}")


def scan_of(name: str) -> float | None:
    """The scan position in a file name, as `scan_value` gives it."""
    found = re.search(SCAN_TOKEN, name)
    return float(found.group(1)) if found else None


@dataclass(frozen=True)
class Files(InputPartition):
    paths: tuple[str, ...]


def _batch(frames: list[tuple[tuple, np.ndarray | None]]) -> pa.RecordBatch:
    """Frames as the columns of SCHEMA."""
    *before, error = zip(*(row for row, _ in frames))
    sizes = [0 if p is None else len(p) for _, p in frames]
    starts = pa.array([*(None if p is None else at for (_, p), at in zip(frames, np.cumsum([0, *sizes]).tolist())), sum(sizes)], pa.int32())
    flat = np.concatenate([np.zeros(0), *(p for _, p in frames if p is not None)])
    types = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    columns = [*map(pa.array, before, types), pa.ListArray.from_arrays(starts, pa.array(flat)), pa.array(error, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


class FrameReader(DataSourceReader):
    """Plans partitions over the files of a folder that the pushed filters let through; only those are opened."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pages = options["path"], options.get("pages", "false").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters on a file's path, name and scan position; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in NAMED and isinstance(f, IsNotNull):
                self.pushed.append((column, IsNotNull, None))
            elif column in NAMED and type(f) in JUDGES:
                self.pushed.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        known = {"path": path, "filename": name, "xps_value": scan_of(name)}
        for column, kind, value in self.pushed:
            own = known[column]
            if kind is EqualNullSafe and own is None and value is None:
                continue
            if own is None or (kind is not IsNotNull and (value is None or not JUDGES[kind](own, value))):
                return False
        return True

    def partitions(self) -> Sequence[Files]:
        """Runs of files of about ``partitionbytes`` together, each counted as OPEN_BYTES at least, in order of their names."""
        system, folder = located(self.path)
        prefix = self.path.rstrip("/")
        found = [f for f in system.get_file_info(FileSelector(folder)) if f.type == FileType.File and f.base_name.lower().endswith(SUFFIXES)]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.base_name):
            if self.wanted(f"{prefix}/{f.base_name}"):
                held.append(f"{prefix}/{f.base_name}")
                size += max(f.size or 0, OPEN_BYTES)
                if size >= self.size:
                    out.append(Files(tuple(held)))
                    held, size = [], 0
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Arrow batches of about BATCH_BYTES of pixels."""
        rows, held = [], 0
        for row, pixels in self._frames(partition):
            size = 0 if pixels is None else pixels.nbytes
            if rows and (held + size > BATCH_BYTES or len(rows) == BATCH_ROWS):
                yield _batch(rows)
                rows, held = [], 0
            rows.append((row, pixels))
            held += size
        if rows:
            yield _batch(rows)

    def _frames(self, partition: Files) -> Iterator[tuple[tuple, np.ndarray | None]]:
        """All columns of each frame but its pixels, and these."""
        from ringlake.sources.tiff import decode, decode_pages

        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            own = path, name, scan_of(name)
            try:
                system, place = located(path)
                with system.open_input_file(place) as f:
                    data = f.read()
                images = decode_pages(data) if self.pages else [decode(data)]
                made = [((*own, i, *a.shape, str(a.dtype), None), a.astype(np.float64).ravel()) for i, a in enumerate(images)]
            except Exception as e:  # any broken file is a failed row, not a failed job
                made = [((*own, 0, None, None, None, f"{type(e).__name__}: {e}"), None)]
            yield from made


class Frames(DataSource):
    """TIFF files of a folder as frames. Options: path, pages (each image of a file, not the first), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FRAMES

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder and the names in it."""

    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Tasks write to folders of their attempts; the commit moves the files to where they belong, an abort removes them all."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        self.waiting = f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        attempt = f"{self.waiting}/{task.partitionId()}-{task.taskAttemptId()}"
        system, folder = located(attempt)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"not a name for a file: {name!r}")
                with system.open_output_stream(f"{folder}/{len(names)}") as f:
                    f.write(content or b"")
                names.append(name)
        return Written(attempt, names)

    def _end(self) -> None:
        system, folder = located(self.waiting)
        if system.get_file_info(folder).type == FileType.Directory:
            system.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the tasks that count; refuse, before any is moved, if a name is there twice or already."""
        try:
            done = [m for m in messages if m is not None]
            system, folder = located(self.path)
            system.create_dir(folder, recursive=True)
            seen: set[str] = set()
            for name in (n for m in done for n in m.names):
                if name in seen:
                    raise ValueError(f"two rows have the name {name}")
                seen.add(name)
            there = {f.base_name for f in system.get_file_info(FileSelector(folder))}
            if not self.overwrite and seen & there:
                raise FileExistsError(f"{min(seen & there)} is there already")
            for m in done:
                source = located(m.folder)[1]
                for i, name in enumerate(m.names):
                    system.move(f"{source}/{i}", f"{folder}/{name}")
            with system.open_output_stream(f"{folder}/_committed-{self.job}.json") as f:
                f.write(json.dumps({"files": len(seen)}).encode())
        finally:
            self._end()

    def abort(self, messages: list[Written | None]) -> None:
        self._end()


class NamedFiles(DataSource):
    """A sink of rows (name, content): each becomes the file of that name in the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.dataType.simpleString() for f in schema] != ["string", "binary"]:
            raise AnalysisException("rows of (name string, content binary) are needed")
        return FileWriter(dict(self.options), overwrite)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about BATCH_BYTES, one row at least."""
    rows = max(1, int(BATCH_BYTES * batch.num_rows / max(batch.nbytes, 1)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def frame_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """The frames of a folder through the data source; filters on path, filename and xps_value are pushed into its planning."""
    spark.dataSource.register(Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FRAMES).options(path=path, **options).load()


def save_files(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """Write rows (name, content) as files, all or none of them; returns their number. Names that are there already are an error unless overwritten."""
    job = uuid.uuid4().hex
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.write.format(FILES).mode("overwrite" if overwrite else "append").options(path=path, job=job).save()
    system, folder = located(path)
    with system.open_input_file(f"{folder}/_committed-{job}.json") as f:
        return json.loads(f.read())["files"]
