"""Lines of block-compressed gzip files, read by many tasks a file.

A blocked file is a row of small gzip members, each with its own length in an extra header field. A
task gets a range of the file's bytes, finds the first member that begins there - a header whose
lengths lead to further headers - and inflates all members that begin in its range. A line belongs to the task in
whose members the line feed before it lies (the first line to the first task), so a task drops what
comes before its first line feed and reads on past its end until the line it has begun is whole.
A gzip file of one member has no such starts and is read by one task.

Paths are opened by the tasks themselves, through pyarrow's file systems: local or mounted folders, and
the remote ones pyarrow knows by their scheme.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from callscope.session import ship

# Fixed values of the format: start of a member with extra fields, the tag of the field with its length.
MEMBER = b"\x1f\x8b\x08\x04"
TAG = b"BC"
LONGEST_MEMBER = 1 << 16
#: Bytes of a file per task; members that have to follow each other for a start to be believed.
SPLIT = 64 << 20
CHAIN = 4
BATCH_LINES = 10_000
SCHEMA = "line string, file string"


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int | None  # None: a file of one member


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member_size(data: bytes, at: int) -> int | None:
    """The length of the member at ``at``, from its header; None if there is no header of a blocked file."""
    if data[at : at + 4] != MEMBER or len(data) < at + 12:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    field, stop = at + 12, at + 12 + extra
    while field + 4 <= min(stop, len(data)):
        size = struct.unpack_from("<H", data, field + 2)[0]
        if data[field : field + 2] == TAG and size == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def first_member(data: bytes, whole_rest: bool) -> int | None:
    """The first place in ``data`` from which members follow each other; ``whole_rest``: data ends with the file."""
    at = data.find(MEMBER)
    while at >= 0:
        here, steps = at, 0
        while steps < CHAIN:
            size = member_size(data, here)
            if size is None:
                break
            here, steps = here + size, steps + 1
            if here >= len(data):
                # Beyond what was read nothing speaks against it; at the end of the file it must fit.
                steps = CHAIN if here == len(data) or not whole_rest else 0
                break
        if steps >= CHAIN:
            return at
        at = data.find(MEMBER, at + 1)
    return None


def inflated(file, begin: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members from ``begin`` on."""
    file.seek(begin)
    data, at = b"", begin
    while True:
        while (size := member_size(data, 0)) is None or len(data) < size:
            more = file.read(4 * LONGEST_MEMBER)
            if not more:
                if data:
                    raise ValueError(f"the file is cut off or no blocked gzip at byte {at}")
                return
            data += more
        yield at, zlib.decompress(data[:size], wbits=31)
        data, at = data[size:], at + size


def _start(file, begin: int, size: int) -> int | None:
    """The first member that begins at ``begin`` or later."""
    if begin == 0:
        return 0
    file.seek(begin)
    data = b""
    while True:
        more = file.read(2 * LONGEST_MEMBER)
        data += more
        found = first_member(data, begin + len(data) >= size)
        # A start counts when the chain behind it was read, or the file is at its end.
        if found is not None and (len(data) - found >= CHAIN * LONGEST_MEMBER or not more):
            return begin + found
        if not more:
            return None


def lines_of(path: str, begin: int, end: int | None) -> Iterator[bytes]:
    """The lines, without line feeds, that belong to a range of a file's bytes."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        if end is None:
            yield from _of_one_member(file)
            return
        at = _start(file, begin, file.size())
        if at is None or at >= end:
            return
        rest, begun = [], begin == 0  # pieces of the open line; whether it is ours
        for place, text in inflated(file, at):
            if place >= end:
                # The line that is open here is ours up to its line feed.
                if not begun:
                    return
                cut = text.find(b"\n")
                rest.append(text if cut < 0 else text[:cut])
                if cut >= 0:
                    yield b"".join(rest)
                    return
                continue
            pieces = text.split(b"\n")
            rest.append(pieces[0])
            if len(pieces) > 1:
                if begun:
                    yield b"".join(rest)
                begun = True
                yield from pieces[1:-1]
                rest = [pieces[-1]]
            elif not begun:
                rest = []
        if begun and any(rest):
            yield b"".join(rest)


def _of_one_member(file) -> Iterator[bytes]:
    """Lines of a plain gzip file, member after member."""
    unpack, rest = zlib.decompressobj(wbits=31), b""
    while data := file.read(1 << 20):
        while data:
            pieces = (rest + unpack.decompress(data)).split(b"\n")
            rest = pieces.pop()
            yield from pieces
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(wbits=31)
    if rest:
        yield rest


class BlockedReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> Sequence[Range]:
        out = []
        for path in self.paths:
            system, name = _open(path)
            chosen = system.get_file_info(name)
            if chosen.type == fs.FileType.Directory:
                inside = system.get_file_info(fs.FileSelector(name))
                files = [x for x in sorted(inside, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", "."))]
            elif chosen.is_file:
                files = [chosen]
            else:
                raise FileNotFoundError(path)
            for info in files:
                own = info.path if isinstance(system, fs.LocalFileSystem) else f"{system.type_name}://{info.path}"
                own = path if len(files) == 1 and chosen.is_file else own
                with system.open_input_file(info.path) as file:
                    blocked = member_size(file.read(LONGEST_MEMBER), 0) is not None
                if blocked:
                    out += [Range(own, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
                elif info.size:
                    out.append(Range(own, 0, None))
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held: list[str] = []
        names = ["line", "file"]
        for line in lines_of(partition.path, partition.begin, partition.end):
            held.append(line.decode("utf-8", "replace"))
            if len(held) >= BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([partition.path] * len(held), pa.string())], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([partition.path] * len(held), pa.string())], names)


class BlockedGzip(DataSource):
    """Options: path (one, or several separated by line feeds), split (bytes per task)."""

    @classmethod
    def name(cls) -> str:
        return "blocked_gzip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockedReader:
        return BlockedReader(self.options["path"].split("\n"), int(self.options.get("split", SPLIT)))


def read_lines(spark: SparkSession, path: str | Sequence[str], split: int = SPLIT) -> DataFrame:
    """``line, file`` of gzip files or folders of them; blocked files are read by a task per ``split`` bytes."""
    ship(spark)
    spark.dataSource.register(BlockedGzip)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("blocked_gzip").option("path", "\n".join(paths)).option("split", str(split)).load()
