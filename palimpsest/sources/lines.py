"""A data source for folders of line archives that grow: batch reads of byte ranges, and a stream whose offset is a position in each file.

`register(spark)`, then spark.read or spark.readStream with format "archive_lines" and a path gives rows (file, position, line). A
file is split into ranges of `rangeBytes`; a line belongs to the range in which it begins. The stream takes lines once they
have their line break: a line that is still being written waits for the next batch, so an append between two runs gives its new
lines and no other. Offsets are kept in the query's checkpoint and are as large as the number of files. Files are read by
pyarrow's file systems, so a folder may be in any store that these know. Lines that are not UTF-8 come with replacement signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "archive_lines"
RANGE_BYTES = 64 << 20
_STEP = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at begin or later and before end."""

    file: str
    begin: int
    end: int


def _folder(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Lines:
    """Listing and reading, for both kinds of readers."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def files(self) -> dict[str, int]:
        """Sizes of the files by their path below the folder."""
        system, root = _folder(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {i.path[len(root.rstrip("/")) + 1 :]: i.size for i in infos if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith(("_", "."))}

    def complete(self, file: str, known: int, size: int) -> int:
        """Where the last line break of a file ends, not before `known`."""
        system, root = _folder(self.path)
        with system.open_input_file(f"{root}/{file}") as f:
            end = size
            while end > known:
                begin = max(known, end - _STEP)
                found = f.read_at(end - begin, begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                end = begin
        return known

    def ranges(self, file: str, begin: int, end: int) -> list[Range]:
        return [Range(file, at, min(at + self.range_bytes, end)) for at in range(begin, end, self.range_bytes)]

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        system, root = _folder(self.path)
        with system.open_input_file(f"{root}/{part.file}") as f:
            at = part.begin
            if at:  # the line that covers the byte before belongs to the range before, unless it ends there
                f.seek(at - 1)
                at += len(self._line(f)) - 1
            f.seek(at)
            while at < part.end:
                line = self._line(f)
                if not line:
                    return
                yield part.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def _line(self, f) -> bytes:
        """The bytes up to the next line break, with it; whatever is left at the end of a file."""
        held, start = [], f.tell()
        while block := f.read(_STEP if held else 8192):
            cut = block.find(b"\n") + 1
            if cut:
                held.append(block[:cut])
                break
            held.append(block)
        line = b"".join(held)
        f.seek(start + len(line))
        return line


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.lines = _Lines(options)

    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(self.lines.files().items()) for r in self.lines.ranges(file, 0, size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.lines.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.lines, self.known = _Lines(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {file: self.lines.complete(file, self.known.get(file, 0), size) for file, size in self.lines.files().items()}
        self.known = self.known | {file: end for file, end in now.items() if end}
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, upto in sorted(end.items()) for r in self.lines.ranges(file, start.get(file, 0), upto)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.lines.read(partition)

    def commit(self, end: dict) -> None:
        self.known = self.known | end


class ArchiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, position long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveLines)
