"""Formats of Spark's own: evaluation cases in TOML, and export files with a commit step.

After ``register`` (spark): ``spark.read.format("memory_cases").option("table", "case").load(path)`` and
``lines.write.format("memory_export").mode("overwrite").save(path)``. Paths are those that pyarrow's file systems open, the
same from the driver and from every executor.
"""

from __future__ import annotations

import tomllib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CASES = {
    "memory": "path string, ordinal int, content string, category string, subcategory string, tags array<string>",
    "case": "path string, ordinal int, name string, kind string, query string, expect array<string>, categories array<string>, tags array<string>, subcategories array<string>",
}
#: The lists among a table's columns, empty where a file leaves them out.
LISTS = ("tags", "expect", "categories", "subcategories")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclass
class OneFile(InputPartition):
    path: str


class CasesReader(DataSourceReader):
    """A partition a file; an unreadable file is an error that names it."""

    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table
        self.columns = [c.split(" ")[0] for c in CASES[table].split(", ")][2:]

    def partitions(self) -> list[OneFile]:
        system, at = place(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [OneFile(at)]
        return [OneFile(x.path) for x in sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda x: x.path) if x.path.endswith(".toml")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        system, _ = place(self.path)
        with system.open_input_stream(partition.path) as f:
            try:
                spec = tomllib.loads(f.read().decode())
            except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                raise ValueError(f"{partition.path}: {e}") from e
        for i, row in enumerate(spec.get(self.table, [])):
            yield (partition.path, i, *(row.get(c, [] if c in LISTS else None) for c in self.columns))


class CasesSource(DataSource):
    """``memory_cases``: option ``table`` is memory (what is stored before) or case (what is asked)."""

    @classmethod
    def name(cls) -> str:
        return "memory_cases"

    @property
    def table(self) -> str:
        table = self.options.get("table", "case")
        if table not in CASES:
            raise ValueError(f"table {table!r} is not one of {', '.join(CASES)}")
        return table

    def schema(self) -> str:
        return CASES[self.table]

    def reader(self, schema) -> CasesReader:
        return CasesReader(self.options["path"], self.table)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, as (where it is, where it belongs)."""

    files: list[tuple[str, str]]


class ExportWriter(DataSourceArrowWriter):
    """Writes the lines of sorted (user_id, ..., value) rows to a file a user and task, which count from the commit on.

    A user of any size is several files, ``user=<id>/<task>-<n>.<suffix>``, in the order of their names.
    """

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, at = place(self.path)
        task = TaskContext.get().partitionId()
        folder = f"{at}/_temporary/{self.job}/{task}-{uuid.uuid4().hex}"
        files, user, out = [], None, None
        try:
            for batch in iterator:
                ids, lines = batch.column("user_id").to_pylist(), batch.column("value").to_pylist()
                for own, line in zip(ids, lines, strict=True):
                    if out is None or own != user:
                        if out is not None:
                            out.close()
                        else:
                            system.create_dir(folder)
                        user, name = own, f"{folder}/{len(files)}"
                        out = system.open_output_stream(name)
                        files.append((name, f"{at}/user={own}/{task:06}-{len(files):06}.{self.suffix}"))
                    out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Old files go, and those of the tasks that count take their places; files of repeated tasks are left behind and dropped."""
        system, at = place(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if info.type == fs.FileType.Directory and info.base_name.startswith("user="):
                    system.delete_dir(info.path)
        for message in messages:
            for source, target in message.files if message else []:
                system.create_dir(target.rpartition("/")[0])
                system.move(source, target)
        self._clear(system, at)
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/_temporary/{self.job}")


class ExportSource(DataSource):
    """``memory_export``: option ``suffix`` is that of the files, md by default."""

    @classmethod
    def name(cls) -> str:
        return "memory_export"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        missing = {"user_id", "value"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"an export needs the columns {', '.join(sorted(missing))}")
        return ExportWriter(self.options["path"], self.options.get("suffix", "md"), overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(CasesSource)
    spark.dataSource.register(ExportSource)
