"""Data sources of this engine's own formats, registered with a session.

`contours` reads a directory of contour files, many files a task, one row a file with an error column. `named_files` writes rows of (file, value) as one text file each.
Both reach what pyarrow's file systems reach (local and shared folders, HDFS, object stores); `files.load_contours` reads whatever Spark itself can read.

    register(spark)
    spark.read.format("contours").option("pattern", "dive*").load(directory)
    table.write.format("named_files").mode("append").save(directory)
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from undula.sources import files

#: Bytes and files that one task reads; each file counts as TOUCH bytes at least.
TASK_BYTES, TOUCH = 64 << 20, 256 << 10


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class ContourSource(DataSource):
    """Options: path, format (auto, ctr, csv, txt), pattern of names, frequency_column."""

    @classmethod
    def name(cls) -> str:
        return "contours"

    def schema(self) -> str:
        return files.PARSED

    def reader(self, schema) -> DataSourceReader:
        return _ContourReader(self.options)


class _ContourReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.pattern, self.column = options["path"], options.get("pattern", "*"), int(options.get("frequency_column", 0))
        kind = options.get("format", "auto")
        if kind != "auto" and kind not in files.FORMATS:
            raise ValueError(f"unknown format {kind!r}")
        self.kinds = files.FORMATS if kind == "auto" else (kind,)

    def partitions(self) -> list[InputPartition]:
        """Files by format, then path, as many together as a task reads."""
        fs, root = _place(self.root)
        at = fs.get_file_info(root)
        if at.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if at.type != pafs.FileType.Directory:
            raise NotADirectoryError(self.root)
        found = []
        for f in fs.get_file_info(pafs.FileSelector(root)):
            stem, ext = posixpath.splitext(f.base_name)
            if f.is_file and ext[1:].lower() in self.kinds and fnmatch.fnmatchcase(stem, self.pattern):
                found.append((self.kinds.index(ext[1:].lower()), f.path, f.size or 0))
        if not found:
            raise ValueError(f"no contour file in {self.root}")
        out: list[_Files] = []
        room = 0
        for _, path, size in sorted(found):
            room -= max(size, TOUCH)
            if not out or room < 0:
                out.append(_Files([]))
                room = TASK_BYTES - max(size, TOUCH)
            out[-1].paths.append(path)
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.root)
        for at in range(0, len(partition.paths), 64):
            paths = partition.paths[at : at + 64]
            contents = []
            for p in paths:
                with fs.open_input_stream(p) as f:
                    contents.append(f.read())
            yield files.parse(paths, contents, self.column)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NamedFiles(DataSource):
    """Options: path. Columns: file (name below path), value (text). append replaces files of the same names, overwrite also removes all others."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["file", "value"]:
            raise ValueError("the columns must be file and value")
        return _NamedFileWriter(self.options["path"], overwrite)


class _NamedFileWriter(DataSourceWriter):
    """Tasks write under names of their own; only what the tasks that count report is moved into place, so a task that runs twice leaves nothing twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staged = path, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        fs, root = _place(self.path)
        own = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        done = []
        for row in rows:
            if "/" in row.file or row.file in ("", ".", ".."):
                raise ValueError(f"{row.file!r} is not a file name")
            if not done:
                fs.create_dir(own)
            at = f"{own}/{len(done)}"
            with fs.open_output_stream(at) as out:
                out.write((row.value or "").encode())
            done.append((at, row.file))
        return _Written(done)

    def commit(self, messages) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root)
        done = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file:
                    fs.delete_file(f.path)
        for at, name in done:
            fs.move(at, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, root = _place(self.path)
        if fs.get_file_info(f"{root}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staged}")


def register(spark: SparkSession) -> None:
    for source in (ContourSource, NamedFiles):
        spark.dataSource.register(source)
