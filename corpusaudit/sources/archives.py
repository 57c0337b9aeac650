"""Archive files in a store as a table of members, of which only those asked for are read.

``spark.read.format("archives").load(folder)`` gives a row for each stored member. An archive ends in a
directory of what it holds and where, so a reader gets that by range and then only the ranges of the
members that pass the filters on the name; those are pushed into the source by Spark.
"""

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from corpusaudit.session import register
from corpusaudit.sources.buckets import opened

SCHEMA = (
    "path string, ord int, name string, byte_size long, packed_size long, current boolean, content binary, problem string"
)
#: Packed bytes of a task: smaller archives are read together, a larger one by several tasks.
SPLIT_BYTES = 64 << 20
#: What reading one member may raise.
UNREADABLE = (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError, EOFError)

PUSHED = {
    EqualTo: lambda f: lambda name: name == f.value,
    In: lambda f: lambda name: name in f.value,
    StringStartsWith: lambda f: lambda name: name.startswith(f.value),
    StringEndsWith: lambda f: lambda name: name.endswith(f.value),
    StringContains: lambda f: lambda name: f.value in name,
}


@dataclass
class Slice(InputPartition):
    """Members ``first`` to ``last`` of each archive; None for all that follow."""

    parts: list[tuple[str, int, int | None]]


def members_of(file, wanted, first: int = 0, last: int | None = None, inflate: bool = True) -> Iterator[tuple]:
    """(ord, name, byte_size, packed_size, current, content, problem) of members whose name is wanted.

    ``file`` is any seekable file: only its directory and the wanted members are read. What is no archive
    is one row with ord -1. A member that cannot be read is a row that says so.
    """
    try:
        archive = zipfile.ZipFile(file)
    except UNREADABLE:
        if first == 0 and wanted(""):
            yield -1, "", None, None, True, None, "not-a-zip-archive"
        return
    entries = archive.infolist()
    final = {info.filename: place for place, info in enumerate(entries)}
    for place, info in enumerate(entries[first:last], first):
        if not wanted(info.filename):
            continue
        content, problem = None, None
        if inflate:
            try:
                content = archive.read(info)
            except UNREADABLE:
                problem = "unreadable"
        yield place, info.filename, info.file_size, info.compress_size, final[info.filename] == place, content, problem


class ArchiveReader(DataSourceReader):
    """Plans slices of archives and reads the wanted members of one."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.ending = options.get("ending", "")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.inflate = options.get("content", "true") == "true"
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take filters on the member's name; Spark applies all others."""
        for f in filters:
            if type(f) in PUSHED and getattr(f, "attribute", None) == ("name",):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        store, folder = opened(self.folder)
        found = store.get_file_info(stores.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(self.ending))
        slices, held, size = [], [], 0
        for path, n in files:
            if n > self.split:
                slices += [Slice([(path, a, b)]) for a, b in self._ranges(store, path)]
                continue
            if held and size + n > self.split:
                slices.append(Slice(held))
                held, size = [], 0
            held.append((path, 0, None))
            size += n
        if held:
            slices.append(Slice(held))
        return slices

    def _ranges(self, store, path: str) -> list[tuple[int, int | None]]:
        """Runs of members of about ``split`` packed bytes, from the directory alone."""
        try:
            with store.open_input_file(path) as file:
                sizes = [info.compress_size for info in zipfile.ZipFile(file).infolist()]
        except UNREADABLE:
            return [(0, None)]
        ranges, first, size = [], 0, 0
        for place, n in enumerate(sizes):
            if size and size + n > self.split:
                ranges.append((first, place))
                first, size = place, 0
            size += n
        return [*ranges, (first, None)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        store, _ = opened(self.folder)
        tests = [PUSHED[type(f)](f) for f in self.tests]
        for path, first, last in partition.parts:
            with store.open_input_file(path) as file:
                for row in members_of(file, lambda name: all(t(name) for t in tests), first, last, self.inflate):
                    yield (path, *row)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def archives(spark: SparkSession, folder: str, ending: str = "", inflate: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Members of all archive files under a folder: path, ord, name, sizes, current, content, problem.

    Filters on ``name`` (equal, in a list, with a start, an end or a part) decide which members are read
    at all. Without ``inflate`` only directories are read, content is null and no member has a problem.
    An archive of more than ``split_bytes`` is read by several tasks. A file that is no archive is one
    row with an empty name and a problem, an empty folder gives no row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register(spark, ArchiveSource)
    return (
        spark.read.format("archives")
        .option("ending", ending)
        .option("content", str(inflate).lower())
        .option("splitBytes", str(split_bytes))
        .load(folder)
    )
