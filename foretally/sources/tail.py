"""The last lines of many files, without reading the files.

A Python data source: a partition a file, which is opened at its end and read backwards, block by block, until it has
lines enough.  Files are opened by pyarrow's file systems, so that local and remote stores both work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES, BLOCK = 40, 4096


@dataclass
class File(InputPartition):
    path: str
    size: int


def last_lines(file, size: int, lines: int, block: int = BLOCK) -> tuple[str, int]:
    """(the last lines, the bytes read) of an open file: line ends as they are, but for one at the end; bytes that aren't UTF-8 are replaced."""
    at, held, read = size, b"", 0
    # one line end more than lines: the first line may have begun before what is held
    while at > 0 and held.rstrip(b"\r\n").count(b"\n") < lines:
        step = min(block, at)
        at -= step
        file.seek(at)
        held = file.read(step) + held
        read += step
    rows = held.decode("utf-8", "replace").splitlines()
    return "\n".join(rows[-lines:]), read


class Tails(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.lines, self.block = int(options.get("lines", LINES)), int(options.get("block", BLOCK))
        self.suffix = options.get("suffix", "")
        if not self.path or self.lines < 1 or self.block < 1:
            raise ValueError("tails needs a path, and lines and block of 1 or more")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(top)) if system.get_file_info(top).type == fs.FileType.Directory else [system.get_file_info(top)]
        files = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]
        return [File(f.path, f.size) for f in sorted(files, key=lambda f: f.path)] or [File("", 0)]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as f:
            text, read = last_lines(f, partition.size, self.lines, self.block)
        yield partition.path.rsplit("/", 1)[-1], text, partition.size, read


class TailSource(DataSource):
    """Options: path (a folder or a file), lines, block (bytes read at a time), suffix (of the names that count)."""

    @classmethod
    def name(cls) -> str:
        return "tails"

    def schema(self) -> str:
        return "file_name string, tail string, n_bytes long, n_read long"

    def reader(self, schema) -> DataSourceReader:
        return Tails(self.options)


def tails(spark: SparkSession, path: str, lines: int = LINES, suffix: str = "") -> DataFrame:
    """file_name, tail (the last lines), n_bytes, n_read (bytes that were read for it): a row a file; an empty file has an empty tail."""
    spark.dataSource.register(TailSource)
    return spark.read.format("tails").options(path=path, lines=str(lines), suffix=suffix).load()
