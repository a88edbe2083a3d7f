"""Schematic files as a Spark data source: ``spark.read.format("schematic")`` and ``df.write.format("schematic")``.

Reading: files are listed on the driver and dealt out in partitions of about ``partitionBytes``; a file is a row. Writing:
a row is a file, named by its ``name``. Each task attempt writes into a folder of its own under a staging folder; commit
moves the folders of the attempts that Spark kept, one move each, and abort removes them all, so that a failed or repeated
attempt leaves nothing.

Options: ``path`` (a folder, by any URI that Arrow's file systems know), ``form`` (schem or litematic), ``partitionBytes``,
and ``mode``: ``failfast`` raises at a broken file, ``permissive`` gives its row an error and no states.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gatefold.sources.schematics import FORMATS

READ = "name string, width int, height int, length int, states array<string>, error string"
STAGING, PART = "_staging", "part-"
#: Bytes of files that a task reads, rows of a batch.
PARTITION_BYTES, ROWS = 8 << 20, 64


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class SchematicReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.form = options["path"], options.get("form", "schem")
        self.suffix, _, self.read_one = FORMATS[self.form]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[Files]:
        """Files in the order of their paths; those being written, or of another format, aren't there."""
        system, top = _place(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.path.endswith(self.suffix) and not any(p.startswith(("_", ".")) for p in f.path[len(top) :].strip("/").split("/")[:-1])]
        out: list[Files] = []
        size = self.most
        for f in sorted(found, key=lambda f: f.path):
            if size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for at in range(0, len(partition.paths), ROWS):
            rows = []
            for path in partition.paths[at : at + ROWS]:
                with system.open_input_stream(path) as f:
                    blob = f.read()
                name = unquote(path.rpartition("/")[2].removesuffix(self.suffix))
                try:
                    rows.append((name, *self.read_one(blob), None))
                except (ValueError, KeyError, TypeError) as e:
                    if not self.permissive:
                        raise ValueError(f"{path}: {e}") from e
                    rows.append((name, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "width", "height", "length", "states", "error"])


class SchematicWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, form = options["path"], options.get("form", "schem")
        self.suffix, self.write_one, _ = FORMATS[form]
        if not {"name", "tokens"} <= set(schema.names) or schema["name"].dataType != T.StringType() or schema["tokens"].dataType != T.BinaryType():
            raise ValueError("a schematic has a name, a string, and tokens, binary")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A null name or grid, and two rows of one name in a task, raise: a sink loses no rows."""
        system, top = _place(self.path)
        own, seen = f"{PART}{uuid.uuid4().hex}", set()
        folder = f"{top.rstrip('/')}/{STAGING}-{self.job}/{own}"
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, tokens in zip(batch.column("name").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if not name or tokens is None or name in seen:
                    raise ValueError(f"no name, no grid, or a second one of its name: {name}")
                seen.add(name)
                with system.open_output_stream(f"{folder}/{quote(name, safe='')}{self.suffix}") as f:
                    f.write(self.write_one(tokens, name))
        return Written(own, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _place(self.path)
        top = top.rstrip("/")
        if self.overwrite and system.get_file_info(top).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(top)):
                if old.base_name.startswith(PART):
                    system.delete_dir(old.path)
        for m in messages:
            if m and m.files:
                system.move(f"{top}/{STAGING}-{self.job}/{m.folder}", f"{top}/{m.folder}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, top = _place(self.path)
        if system.get_file_info(staging := f"{top.rstrip('/')}/{STAGING}-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(staging)


class SchematicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "schematic"

    def schema(self) -> str:
        return READ

    def reader(self, schema: T.StructType) -> SchematicReader:
        return SchematicReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SchematicWriter:
        return SchematicWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SchematicSource)
