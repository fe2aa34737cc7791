"""Data sources in Python: a user's file as a parallel reader, and a writer of one file a record.

``register(spark)`` makes both known to a session, as ``plugin`` and ``record_files``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def plugin_source(spec: str) -> tuple[str, str]:
    """The text of the file and the name of the function that 'path/to/file.py:function' means; the function is ``rows`` if none is named."""
    path, colon, name = spec.rpartition(":")
    path, name = (path, name) if colon else (spec, "rows")
    if not path.endswith(".py"):
        raise ValueError(f"a plug-in is written file.py:function, not {spec!r}")
    with open(path, encoding="utf-8") as file:
        return file.read(), name


def plugin_function(source: str, name: str):
    space: dict = {"__name__": "chronoloom_plugin"}
    exec(compile(source, "plug-in", "exec"), space)
    if name not in space:
        raise ValueError(f"the plug-in has no function {name!r}")
    return space[name]


@dataclass
class _Part(InputPartition):
    number: int


class _PluginReader(DataSourceReader):
    def __init__(self, source: str, name: str, config: dict, split: str, parts: int, columns: list[str]):
        self.source, self.name, self.config, self.split, self.parts, self.columns = source, name, config, split, parts, columns

    def partitions(self) -> list[_Part]:
        return [_Part(k) for k in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for row in plugin_function(self.source, self.name)(self.config, self.split, partition.number, self.parts):
            yield tuple(row.get(c) for c in self.columns) if isinstance(row, dict) else tuple(row)


class PluginSource(DataSource):
    """``spark.read.format("plugin").schema(...).option("file", "own.py:rows").option("split", "train").option("parts", 8).load()``.

    The file's function is called as ``rows(config, split, part, parts)`` in a task for each part and
    gives that part's rows, tuples in the schema's order or dicts by column; ``config`` is the option
    of that name, a JSON object. The file is read on the driver and reaches the tasks as text.
    """

    @classmethod
    def name(cls) -> str:
        return "plugin"

    def schema(self) -> str:
        raise ValueError("a plug-in is read with a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        source, name = plugin_source(self.options["file"])
        plugin_function(source, name)  # a mistake in the file shows here
        parts = int(self.options.get("parts", "8"))
        if parts < 1:
            raise ValueError("a plug-in has one part at least")
        return _PluginReader(source, name, json.loads(self.options.get("config", "{}")), self.options.get("split", "train"), parts, schema.fieldNames())


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _RecordWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.drafts = path, overwrite, f"_drafts-{uuid.uuid4().hex}"
        if overwrite:
            files, root = self._root()
            files.delete_dir_contents(root, missing_dir_ok=True)

    def _root(self):
        return pafs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> _Written:
        files, root = self._root()
        drafts = f"{root}/{self.drafts}"
        files.create_dir(drafts, recursive=True)
        n = 0
        for row in iterator:
            name = str(row["name"])
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"{name!r} is no file name")
            draft = f"{drafts}/{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write((row["value"] or "").encode())
            files.move(draft, f"{root}/{name}")
            n += 1
        return _Written(n)

    def _clean(self) -> None:
        files, root = self._root()
        if files.get_file_info(f"{root}/{self.drafts}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.drafts}")

    def commit(self, messages: list[_Written | None]) -> None:
        self._clean()
        files, root = self._root()
        files.create_dir(root, recursive=True)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()


class RecordFiles(DataSource):
    """``df.select("name", "value").write.format("record_files").mode("append").save(path)``: the file ``name`` below the path holds ``value``.

    A file is written beside its place and renamed, so it is there whole or not at all, and a task
    that is run again renames the same file again. Drafts go with the job's end, ``_SUCCESS`` marks a
    whole one. Names must differ; of equal ones the last that is written stays. The path is one that
    every executor can reach by Arrow's file systems (file, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"name", "value"} <= set(schema.fieldNames()):
            raise ValueError("record files are written from the columns name and value")
        return _RecordWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (PluginSource, RecordFiles):
        spark.dataSource.register(source)
