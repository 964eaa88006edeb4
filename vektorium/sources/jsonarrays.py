"""JSON arrays read by ranges of bytes: a large uncompressed array is many tasks.

Where a range starts inside the array's text - within a string or not, and how deep - follows from the
ranges before it. So there are two passes: each range tells what it changes, whatever precedes it; then
each, told where it starts, gives the elements that begin in it and reads on to the end of its last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import LABELLED
from ..storage import file_system

#: Bytes of a range, of what is read at once, and of elements handed on at once.
RANGE_BYTES, PIECE, BATCH = 64 << 20, 1 << 20, 4 << 20
#: Bytes that are read at once beyond a range's end, at first; then twice as many each time.
BEYOND = 1 << 14
#: Names that mark compressed files, which are one range each.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")

_ESCAPED = re.compile(rb"\\.", re.S)
_QUOTE, _COMMA, _OPEN, _CLOSE = b'",[]'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_BOM = b"\xef\xbb\xbf"


@dataclass
class Range(InputPartition):
    """Bytes of a file, and what their start is in; ``end`` is None for the whole of a compressed file."""

    path: str
    start: int
    end: int | None
    depth: int = 0
    quoted: bool = False
    begun: bool = False

    def __post_init__(self):
        super().__init__(None)


def plan(path: str, range_bytes: int) -> list[list[Range]]:
    """The ranges of each file of a folder, or of one file. Names that start with a dot or an underscore are no data."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File and f.base_name[0] not in "._"]
    scheme = path[: path.index(root)] if root in path else ""
    out = []
    for f in sorted(files, key=lambda f: f.path):
        name = scheme + f.path
        if f.base_name.endswith(COMPRESSED):
            out.append([Range(name, 0, None)])
        else:
            out.append([Range(name, at, min(at + range_bytes, f.size)) for at in range(0, f.size, range_bytes)])
    return out


def _blank(piece: bytes, escaped: bool) -> tuple[bytes, bool]:
    """The piece with escaped characters as spaces, and whether it escapes the byte that follows."""
    if escaped:
        piece = b" " + piece[1:]
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"  ", piece)
    return piece, piece.endswith(b"\\")


def _escapes(file, at: int) -> bool:
    """Whether the byte at a place is escaped: an odd number of backslashes precedes it."""
    n = 0
    while at > 0:
        size = min(at, 4096)
        file.seek(at - size)
        before = file.read(size)
        run = size - len(before.rstrip(b"\\"))
        n += run
        if run < size:
            break
        at -= size
    return n % 2 == 1


def shape(file, start: int, end: int) -> tuple[bool, int, int, bool]:
    """What a range changes: whether its quotes are odd in number, its depth if it starts outside a string and inside one, whether it is blank."""
    escaped, quoted, change, blank = _escapes(file, start), 0, [0, 0], True
    file.seek(start)
    while start < end:
        piece = file.read(min(PIECE, end - start))
        if start == 0 and piece.startswith(_BOM):
            piece = b"   " + piece[3:]
        start += len(piece)
        piece, escaped = _blank(piece, escaped)
        b = np.frombuffer(piece, np.uint8)
        blank = blank and bool(_SPACE[b].all())
        inside = (np.cumsum(b == _QUOTE, dtype=np.int32) + quoted) & 1
        step = _STEP[b]
        within = int(step[inside == 1].sum(dtype=np.int64))
        change[1] += within
        change[0] += int(step.sum(dtype=np.int64)) - within
        quoted = int(inside[-1])
    return bool(quoted), change[0], change[1], blank


def placed(ranges: list[Range], shapes: list[tuple[bool, int, int, bool]]) -> None:
    """Tells each of a file's ranges where it starts; shapes are of all but the last."""
    depth, quoted, begun = 0, False, False
    for r, (odd, outside, inside, blank) in zip(ranges[1:], shapes, strict=True):
        depth += inside if quoted else outside
        quoted ^= odd
        begun = begun or not blank
        r.depth, r.quoted, r.begun = depth, quoted, begun


def elements(file, r: Range) -> Iterator[bytes]:
    """The texts of the elements whose opening bracket or comma lies in the range.

    Raises for anything but one whole array a file, and for a place without an element. A file
    without any text has none; a byte order mark is skipped.
    """

    def bad(what: str, at: int) -> ValueError:
        return ValueError(f"{r.path}: {what} at byte {at}")

    whole = r.end is None
    at, depth, quoted, begun = r.start, r.depth, int(r.quoted), r.begun
    escaped = False
    if not whole:
        escaped = _escapes(file, at)
        file.seek(at)
    held: list[bytes] | None = None  # the text so far of an element
    first, beyond = False, BEYOND
    while whole or at < r.end or held is not None:
        if whole or at < r.end:
            size = PIECE if whole else min(PIECE, r.end - at)
        else:
            size, beyond = beyond, min(2 * beyond, PIECE)
        text = file.read(size)
        if not text:
            break
        if at == 0 and text.startswith(_BOM):
            text = b"   " + text[3:]
        plain, escaped = _blank(text, escaped)
        b = np.frombuffer(plain, np.uint8)
        inside = (np.cumsum(b == _QUOTE, dtype=np.int32) + quoted) & 1
        step = np.where(inside == 1, 0, _STEP[b])
        level = np.cumsum(step, dtype=np.int64) + depth
        outside = inside == 0
        opens, closes = outside & (b == _OPEN) & (level == 1) & (step == 1), outside & (b == _CLOSE) & (level == 0)
        stray = outside & ~_SPACE[b] & ~closes & (level <= 0) | outside & (level == 1) & (step == 1) & ~opens
        if whole or at < r.end:  # beyond the range only the last element counts
            if (wrong := np.flatnonzero(stray)).size:
                raise bad("no JSON array", at + int(wrong[0]))
        done = 0
        for k in np.flatnonzero(opens | closes | outside & (b == _COMMA) & (level == 1)):
            k, kind = int(k), b[k]
            if kind == _OPEN:
                if begun:
                    raise bad("a second array", at + k)
                begun = True
            if held is not None:
                held.append(text[done:k])
                found = b"".join(held).strip()
                if found:
                    yield found
                elif not (first and kind == _CLOSE):
                    raise bad("no element", at + k)
                held = None
            if kind != _CLOSE and (whole or at + k < r.end):
                held, first, done = [], kind == _OPEN, k + 1
            elif not whole and at + k >= r.end:
                return
        if held is not None:
            held.append(text[done:])
        at, depth, quoted = at + len(text), int(level[-1]), int(inside[-1])
    if held is not None or whole and depth or quoted and not depth:
        raise bad("text without an end", at)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = [Range(*x) for x in json.loads(options["plan"])] if "plan" in options else [r for f in plan(options["path"], 1 << 62) for r in f]

    def partitions(self) -> list[Range]:
        return self.ranges


class _Elements(_Reader):
    def read(self, partition: Range | None):
        import pyarrow as pa

        if partition is None:  # no files
            return
        fs, path = file_system(partition.path)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts], pa.string())], ["value"])
        with fs.open_input_stream(path) if partition.end is None else fs.open_input_file(path) as file:
            texts, size = [], 0
            for t in elements(file, partition):
                texts.append(t)
                size += len(t)
                if size >= BATCH:
                    yield batch()
                    texts, size = [], 0
            if texts:
                yield batch()


class _Shapes(_Reader):
    def read(self, partition: Range):
        fs, path = file_system(partition.path)
        with fs.open_input_file(path) as file:
            yield (partition.path, partition.start, *shape(file, partition.start, partition.end))


class JsonArrays(DataSource):
    """Format "json_arrays": a row with ``value``, its text, for each element of the arrays at path.

    read_json_arrays() plans ranges; without its plan each file is one. Files are opened with
    pyarrow's file systems, by a path or URI that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def schema(self) -> str:
        return "path string, start long, odd boolean, outside long, inside long, blank boolean" if self.options.get("what") == "shapes" else "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Shapes if self.options.get("what") == "shapes" else _Elements)(dict(self.options))


def _option(ranges: list[Range]) -> str:
    return json.dumps([(r.path, r.start, r.end, r.depth, r.quoted, r.begun) for r in ranges])


def read_json_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``value``, the text of each element. UTF-8 alone is read.

    The driver holds a few numbers for each range, as it does for each task.
    """
    spark.dataSource.register(JsonArrays)
    files = plan(path, range_bytes)
    split = [r for ranges in files for r in ranges[:-1]]
    if split:
        found = spark.read.format("json_arrays").option("what", "shapes").option("plan", _option(split)).load().collect()
        shapes = {(r["path"], r["start"]): (r["odd"], r["outside"], r["inside"], r["blank"]) for r in found}
        for ranges in files:
            placed(ranges, [shapes[r.path, r.start] for r in ranges[:-1]])
    return spark.read.format("json_arrays").option("plan", _option([r for ranges in files for r in ranges])).load()


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str = LABELLED, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of JSON arrays, one array a file. Unknown keys are dropped, broken input fails."""
    return read_json_texts(spark, path, range_bytes).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
