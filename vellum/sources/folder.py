"""A folder of mixed files as a Python data source: spark.read.format("mixed_folder") and spark.readStream.

Files are dealt to tasks by bytes, not by number; a filter on the suffix reaches the listing, so other files aren't opened.
A stream takes the files that are new since the last batch, in the order of their times of change and paths: files must
be moved into the folder whole. The folder must be mounted on the driver and all executors; loaders.py reads stores that
only Spark can open. A file that can't be read is a row with an error.
"""

from __future__ import annotations

import importlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .docx import document_text

SCHEMA = "path string, suffix string, size long, text string, error string"
#: Bytes of files that a task reads.
SPLIT = 64 << 20


def decoded(content: bytes) -> tuple[str | None, str | None]:
    try:
        return content.decode("utf-8-sig"), None
    except UnicodeDecodeError as why:
        return None, str(why)


#: Readers by suffix; all other files are text. The option reader.<suffix> names one more, as module:function.
READERS: dict[str, Callable[[bytes], tuple[str | None, str | None]]] = {".docx": document_text}


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def listed(path: str) -> Iterator[tuple[int, str, int]]:
    """(time of change, path, bytes) of the files below a folder, hidden and unfinished ones left out."""
    for top, folders, names in os.walk(local(path)):
        folders[:] = [f for f in folders if not f.startswith((".", "_"))]
        for name in names:
            if not name.startswith((".", "_")):
                own = os.stat(f"{top}/{name}")
                yield own.st_mtime_ns, f"{top}/{name}", own.st_size


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


def dealt(files: list[tuple[str, int]], split: int) -> list[Files]:
    """Files in their order, cut into partitions of about `split` bytes."""
    out, room = [], 0
    for path, size in files:
        if not out or room < size:
            out.append(Files([]))
            room = split
        out[-1].files.append((path, size))
        room -= size
    return out


class _Rows:
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths:
            raise ValueError("mixed_folder needs a path")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.own = {k.removeprefix("reader"): v for k, v in options.items() if k.startswith("reader.")}
        suffixes = options.get("suffixes")
        self.suffixes = {s.strip().lower() for s in suffixes.split(",")} if suffixes else None

    def wanted(self, path: str) -> bool:
        return self.suffixes is None or os.path.splitext(path)[1].lower() in self.suffixes

    def read(self, partition: Files) -> Iterator[tuple]:
        readers = dict(READERS)
        for suffix, name in self.own.items():
            module, function = name.split(":")
            readers[suffix.lower()] = getattr(importlib.import_module(module), function)
        for path, size in partition.files:
            suffix = os.path.splitext(path)[1].lower()
            try:
                with open(path, "rb") as f:
                    text, error = readers.get(suffix, decoded)(f.read())
            except OSError as why:
                text, error = None, str(why)
            yield path, suffix, size, text, error


class FolderReader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of the suffix; gives back all others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                some = {f.value}
            elif isinstance(f, In) and f.attribute == ("suffix",):
                some = set(f.value)
            else:
                yield f
                continue
            self.suffixes = some if self.suffixes is None else self.suffixes & some

    def partitions(self) -> list[Files]:
        return dealt(sorted((p, n) for top in self.paths for _, p, n in listed(top) if self.wanted(p)), self.split) or [Files([])]


class FolderStream(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((t, p) for top in self.paths for t, p, _ in listed(top) if self.wanted(p)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        new = sorted((t, p, n) for top in self.paths for t, p, n in listed(top) if self.wanted(p) and after < (t, p) <= upto)
        return dealt([(p, n) for _, p, n in new], self.split) or [Files([])]


class MixedFolder(DataSource):
    """Options: path (one or more, by commas), suffixes (.txt,.md; all by default), splitBytes, reader.<suffix> (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "mixed_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source's name, and with filters of Python sources switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MixedFolder)
    return spark


def put(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) as files below root, each whole or not at all, and gives (path, bytes). A task that runs again writes the same."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = os.path.join(local(root), path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = os.path.join(os.path.dirname(to), f"_{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, to)
            sizes = pa.array([len(c) for c in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
