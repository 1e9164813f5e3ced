"""A streaming source for text files that grow in place.

The offset is ``{file: [identity, bytes]}``: the driver only lists files and their sizes.  A
line belongs to the micro-batch in whose byte range its end lies, so executors find line
ends by themselves and a line that is still being written waits for its end.  A changed
identity (rotation) or a smaller size (truncation) starts the file again; a file that is
gone leaves the offset.  Executors read byte ranges of bounded size and hand over Arrow
batches.

``seq`` orders lines: by file, then by place in it; it does not depend on which batch or task
reads a line.  Paths may be local (visible on all nodes under the same name) or URIs of any
file system that Arrow reads (``hdfs://``, ``s3://``); the identity of a local file is its
inode, elsewhere a file is known by its name and size only.  Register with
``spark.dataSource.register(GrowingText)``.
"""

from __future__ import annotations

import fnmatch
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 64 << 20  # bytes of one task's range
STEP = 4 << 20  # bytes read at once
PLACE_BITS = 40  # of a line's place in its file, below the file's rank in ``seq``
SCHEMA = "value string, file string, position bigint, seq bigint"


@dataclass
class Piece(InputPartition):
    path: str
    identity: int
    start: int
    end: int
    rank: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def identity(path: str) -> int:
    """The inode of a local file; 0 elsewhere."""
    return 0 if "://" in path and not path.startswith("file:") else os.stat(opened(path)[1]).st_ino


def listed(pattern: str) -> dict[str, int]:
    """Sizes of the files a wildcard names, by path; ``**`` also crosses folders."""
    store, inner = opened(pattern)
    prefix = pattern[: len(pattern) - len(inner)] if pattern.endswith(inner) else "file://"
    fixed = re.split(r"[*?\[]", inner, maxsplit=1)[0]
    if fixed == inner:
        infos = store.get_file_info([inner])
    else:
        root = fixed.rpartition("/")[0] or "/"
        infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive="**" in inner or "/" in inner[len(root) + 1 :]))
    from palisade.sources.lines import wildcard_regex

    want = re.compile(wildcard_regex(inner) + "$")
    return {f"{prefix}{i.path}": i.size for i in infos if i.type == fs.FileType.File and want.match(i.path)}


def file_rank(path: str, ident: int) -> int:
    """A number for a file (each generation of it) that no other run chooses differently."""
    return zlib.crc32(f"{path}\0{ident}".encode()) >> 9


def pieces(start: dict, end: dict, size: int = PIECE) -> list[Piece]:
    """Byte ranges between two offsets."""
    found = []
    for path, (ident, until) in sorted(end.items()):
        old, begin = start.get(path, (ident, 0))
        if old != ident or begin > until:
            begin = 0
        for at in range(begin, until, size):
            found.append(Piece(path, ident, at, min(at + size, until), file_rank(path, ident)))
    return found


def line_start(handle, position: int) -> int:
    """Where the line begins that the byte at ``position`` belongs to."""
    while position > 0:
        begin = max(0, position - STEP // 64)
        handle.seek(begin)
        cut = handle.read(position - begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        position = begin
    return 0


def _text(lines: list[bytes]) -> pa.Array:
    raw = pa.array([x.removesuffix(b"\r") for x in lines], pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 are dropped
        return pa.array([x.decode("utf-8", errors="ignore") for x in raw.to_pylist()], pa.string())


def piece_lines(piece: Piece) -> Iterator[pa.RecordBatch]:
    """Lines that end inside a piece; the first one may begin before it."""
    try:
        if identity(piece.path) != piece.identity:
            return  # rotated since it was listed: these bytes are gone
        store, inner = opened(piece.path)
        handle = store.open_input_file(inner)
    except FileNotFoundError:
        return
    with handle:
        at = line_start(handle, piece.start)
        handle.seek(at)
        rest, left = b"", piece.end - at
        while left > 0:
            block = handle.read(min(STEP, left))
            if not block:
                break
            left -= len(block)
            *lines, rest = (rest + block).split(b"\n")
            if not lines:
                continue
            sizes = [len(x) + 1 for x in lines]
            places, place = [], at
            for n in sizes:
                places.append(place)
                place += n
            at = place
            yield pa.RecordBatch.from_arrays([
                _text(lines), pa.array([piece.path] * len(lines), pa.string()), pa.array(places, pa.int64()),
                pa.array([(piece.rank << PLACE_BITS) + p for p in places], pa.int64()),
            ], ["value", "file", "position", "seq"])


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.patterns = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.from_end = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"

    def latestOffset(self) -> dict:
        found: dict[str, int] = {}
        for pattern in self.patterns:
            found |= listed(pattern)
        named = {}
        for path, size in sorted(found.items()):
            if any(fnmatch.fnmatch(os.path.basename(path), x) for x in self.exclude):
                continue
            try:
                named[path] = [identity(path), size]
            except FileNotFoundError:  # went away since it was listed
                continue
        return named

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return piece_lines(partition)


class GrowingText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)
