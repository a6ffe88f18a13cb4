"""Capture files as a Spark data source: read in byte ranges by many tasks, followed as a stream while they grow, and written by tasks.

A classic capture has no marks between its records, so a task that starts inside a file reads back from there: of all places where a record's header could stand it
follows each, and takes the first record that all of these readings lead to. Bytes of a capture that another capture carries as payload are readings
that end or join the true one, so they mislead no task. Blocks of the next-generation format depend on sections before them; such a file is one task's, read
piece by piece. Paths are those that pyarrow's file systems open: local ones, file, hdfs, s3, gs.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

FRAME_SCHEMA = "path string, position long, link int, ts double, wirelen long, frame binary"
_ARROW = pa.schema([("path", pa.string()), ("position", pa.int64()), ("link", pa.int32()), ("ts", pa.float64()), ("wirelen", pa.int64()), ("frame", pa.binary())])
#: Fixed values of the classic format: a file's magic number, its byte order and its ticks a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
#: Fixed values of the next-generation format: block types, the byte-order mark, and the options that set an interface's clock.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET, BYTE_ORDER, RESOLUTION, OFFSET = 0x0A0D0D0A, 1, 2, 3, 6, 0x1A2B3C4D, 9, 14
#: Link types.
ETHERNET, RAW, COOKED = 1, 101, 113
#: Bytes of a range by default, of the longest record, of a read, and of a batch of frames.
SPLIT, LONGEST, READ, BATCH = 64 << 20, 262_144, 4 << 20, 4 << 20
YEAR = 365 * 86_400


def _open(path: str):
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri(f"file://{posixpath.abspath(path)}")
    return fs, at


def capture_files(paths: str) -> dict[str, int]:
    """The files that a path names (a file, a folder with all below, or a pattern for names in a folder), with their sizes; hidden ones are left out."""
    from pyarrow.fs import FileSelector, FileType

    head, _, name = paths.rstrip("/").rpartition("/")
    pattern = name if any(c in name for c in "*?[") else None
    fs, at = _open(head if pattern else paths)
    parts = urlsplit(paths)
    prefix = f"{parts.scheme}://{parts.netloc if at.startswith('/') else ''}" if "://" in paths else ""
    info = fs.get_file_info(at)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at, recursive=pattern is None, allow_not_found=True))
    out = {}
    for f in found:
        inside = f.path[len(at) :].strip("/").split("/")
        if f.type == FileType.File and not any(x[:1] in ("_", ".") for x in inside) and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)):
            out[prefix + f.path] = f.size
    return dict(sorted(out.items()))


class _Bytes:
    """A file as it is up to `size`, read in pieces."""

    def __init__(self, path: str, size: int):
        fs, at = _open(path)
        self.file, self.path, self.size, self.start, self.data = fs.open_input_file(at), path, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes, or what there is of them."""
        n = max(0, min(n, self.size - at))
        if at < self.start or at + n > self.start + len(self.data):
            self.start, self.data = at, self.file.read_at(max(n, min(READ, self.size - at)), at)
        return self.data[at - self.start : at - self.start + n]


class _Classic:
    head = 24

    def __init__(self, data: _Bytes, longest: int):
        self.data, self.longest = data, longest
        head = data.get(0, 24)
        self.order, self.ticks = MAGIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0] & 0x0FFFFFFF
        self.near = struct.unpack(self.order + "I", data.get(24, 4))[0] if data.size >= 28 else 0

    def next(self, at: int, strict: bool) -> int | None:
        """Where the record ends whose header would stand there; None if no header can. strict: a usual one, of less than a year from the first, nothing added."""
        head = self.data.get(at, 16)
        if len(head) < 16:
            return None
        seconds, part, held, wire = struct.unpack(self.order + "4I", head)
        if held > self.longest or part >= self.ticks or strict and (wire < held or abs(seconds - self.near) > YEAR):
            return None
        return at + 16 + held

    def boundary(self, a: int) -> int:
        """The start of a record at or before a. No false reading stays usual for longer than a record, unless it joins the true one; where the true one is
        unusual, readings of any plausible headers have to agree."""
        reach = self.longest + 16
        back = 4 * reach
        while a - back > self.head:
            for strict in (True, False):
                if (found := self._agreed(a - back, a - back + reach, a, strict)) is not None:
                    return found
            back *= 4
        return self.head

    def _agreed(self, lo: int, hi: int, a: int, strict: bool) -> int | None:
        """A place up to a that the readings from all of lo to hi lead to: one of these starts is true, as no record is longer."""
        raw = np.frombuffer(self.data.get(lo, hi - lo + 16), np.uint8).astype(np.uint32)
        number = lambda k: sum(raw[k + (i if self.order == "<" else 3 - i) : len(raw) - 15 + k + (i if self.order == "<" else 3 - i)] << np.uint32(8 * i) for i in range(4))[: hi - lo]
        starts = lo + np.flatnonzero((number(8) <= self.longest) & (number(4) < self.ticks))
        first: dict[int, int] | None = None
        ended: set[int] = set()
        agreed = -1
        for start in starts.tolist():
            path, at = [], start
            while at is not None and at <= a and at not in ended and not (first and at in first):
                path.append(at)
                at = self.next(at, strict)
            if at is None or at in ended:
                ended.update(path)
            elif first is None:
                first, agreed = dict.fromkeys(path), start
            elif at in first:
                agreed = max(agreed, at)
            else:
                return None  # two readings that don't meet before a
        return None if first is None else min((x for x in first if x >= agreed), default=None)

    def frames(self, a: int, b: int) -> Iterator[tuple]:
        """position, link, ticks, ticks a second, wire length, bytes of the records that end after a and not after b."""
        at = self.head if a <= self.head else self.boundary(a)
        while len(head := self.data.get(at, 16)) == 16:
            seconds, part, held, wire = struct.unpack(self.order + "4I", head)
            if held > self.longest:
                raise ValueError(f"{self.data.path}: a record of {held} bytes at {at}; the file is damaged")
            end = at + 16 + held
            if end > b:
                break  # the next range's, or cut off
            if end > a:
                yield at, self.link, seconds, part, self.ticks, wire, self.data.get(at + 16, held)
            at = end


class _Blocks:
    """The next-generation format."""

    def __init__(self, data: _Bytes, longest: int):
        self.data, self.longest = data, longest

    def frames(self, a: int, b: int) -> Iterator[tuple]:
        at, order, interfaces = 0, "<", []
        while len(head := self.data.get(at, 12)) == 12:
            if head[:4] == struct.pack("<I", SECTION):
                order, interfaces = ("<" if struct.unpack_from("<I", head, 8)[0] == BYTE_ORDER else ">"), []
            kind, size = struct.unpack_from(order + "2I", head)
            if size < 12 or size % 4:
                raise ValueError(f"{self.data.path}: a block of {size} bytes at {at}; the file is damaged")
            end = at + size
            if end > b:
                break
            if kind == INTERFACE:
                interfaces.append(self._interface(self.data.get(at + 8, size - 12), order))
            elif kind in (PACKET, OLD_PACKET, SIMPLE_PACKET) and end > a:
                body = self.data.get(at + 8, size - 12)
                if kind == SIMPLE_PACKET:
                    wire = struct.unpack_from(order + "I", body)[0]
                    own, skip, ticks = 0, 4, 0
                    held = min(wire, interfaces[0][3] or wire) if interfaces else wire
                else:
                    own, high, low, held, wire = struct.unpack_from(order + ("5I" if kind == PACKET else "Hxx4I"), body)
                    skip, ticks = 20, high << 32 | low
                if own >= len(interfaces):
                    raise ValueError(f"{self.data.path}: a packet of interface {own} at {at}, which no block describes")
                link, per, offset, _ = interfaces[own]
                yield at, link, ticks // per + offset if ticks else 0, ticks % per, per, wire, body[skip : skip + held]
            at = end

    @staticmethod
    def _interface(body: bytes, order: str) -> tuple[int, int, int, int]:
        """link, ticks a second, seconds to add, longest capture."""
        link, longest = struct.unpack_from(order + "HxxI", body)
        per, offset, at = 1_000_000, 0, 8
        while at + 4 <= len(body):
            code, n = struct.unpack_from(order + "2H", body, at)
            if code == RESOLUTION and n >= 1:
                per = 2 ** (body[at + 4] & 127) if body[at + 4] & 128 else 10 ** body[at + 4]
            elif code == OFFSET and n >= 8:
                offset = struct.unpack_from(order + "q", body, at + 4)[0]
            elif code == 0:
                break
            at += 4 + (n + 3) // 4 * 4
        return link, per, offset, longest


def _reader(data: _Bytes, longest: int) -> _Classic | _Blocks:
    magic = data.get(0, 4)
    if magic in MAGIC:
        return _Classic(data, longest)
    if magic == struct.pack("<I", SECTION):
        return _Blocks(data, longest)
    raise ValueError(f"{data.path} is no capture file")


@dataclass
class _Range(InputPartition):
    """The records of a file, of which `size` bytes are there, that end after a and not after b."""

    path: str
    a: int
    b: int
    size: int


def _ranges(files: dict[str, tuple[int, int]], split: int, longest: int) -> list[_Range]:
    """files: from where to where. What has not even a file's head yet waits."""
    out = []
    for path, (a, b) in files.items():
        if b <= a or b < 24:
            continue
        classic = isinstance(_reader(_Bytes(path, b), longest), _Classic)
        step = split if classic else b - a
        out += [_Range(path, at, min(at + step, b), b) for at in range(a, b, step)]
    return out


def _batches(r: _Range, longest: int, since: float, until: float) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for position, link, seconds, part, per, wire, frame in _reader(_Bytes(r.path, r.size), longest).frames(r.a, r.b):
        ts = seconds + part / per
        if since <= ts <= until:
            rows.append((r.path, position, link, ts, wire, frame))
            size += len(frame) + 100
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types, strict=True)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types, strict=True)], schema=_ARROW)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split, self.longest = int(options.get("splitBytes", SPLIT)), int(options.get("longestRecord", LONGEST))


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.since, self.until = _Options(options), float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ts are kept here, so that no frame outside them is copied; strict ones are tested again."""
        for f in filters:
            own = getattr(f, "attribute", None) == ("ts",)
            if own and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since, f.value)
            if own and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = min(self.until, f.value)
            if not own or not isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo, IsNotNull)):  # no ts is null
                yield f

    def partitions(self) -> list[InputPartition]:
        files = {p: (0, n) for p, n in capture_files(self.options.path).items()}
        return _ranges(files, self.options.split, self.options.longest) or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.longest, self.since, self.until) if partition.path else iter(())


class CaptureStream(DataSourceStreamReader):
    """Offsets are how far each file was read, so a file that grows is followed; a record that is not yet whole waits for the batch in which it ends.

    Files that left the folder leave the offsets. A file must only grow."""

    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return capture_files(self.options.path)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges({p: (start.get(p, 0) if start.get(p, 0) >= 24 else 0, n) for p, n in end.items()}, self.options.split, self.options.longest)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.longest, float("-inf"), float("inf"))

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay, and Spark's checkpoint holds the offsets."""


@dataclass
class _Written(WriterCommitMessage):
    name: str


class CaptureWriter(DataSourceArrowWriter):
    """A file for each task that has frames, under a hidden name until the job commits. Columns ts, wirelen and frame are needed."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.link, self.kind = options["path"].rstrip("/"), int(options.get("link", ETHERNET)), options.get("kind", "pcap")
        if overwrite or self.kind not in ("pcap", "pcapng"):
            raise ValueError("captures are appended as pcap or pcapng")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        name, file = f"_part-{uuid.uuid4().hex}.{self.kind}", None
        for batch in iterator:
            for ts, wire, frame in zip(*(batch.column(c).to_pylist() for c in ("ts", "wirelen", "frame")), strict=True):
                if file is None:
                    file = fs.open_output_stream(f"{at}/{name}")
                    file.write(self._head())
                micros = round(ts * 1_000_000)
                if self.kind == "pcap":
                    file.write(struct.pack("<4I", micros // 1_000_000, micros % 1_000_000, len(frame), wire) + frame)
                else:
                    pad = -len(frame) % 4
                    size = 32 + len(frame) + pad
                    file.write(struct.pack("<7I", PACKET, size, 0, micros >> 32, micros & 0xFFFFFFFF, len(frame), wire) + frame + bytes(pad) + struct.pack("<I", size))
        if file is not None:
            file.close()
        return _Written(name if file is not None else "")

    def _head(self) -> bytes:
        if self.kind == "pcap":
            return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, self.link)
        return struct.pack("<3IHHqI", SECTION, 28, BYTE_ORDER, 1, 0, -1, 28) + struct.pack("<2IHHII", INTERFACE, 20, self.link, 0, LONGEST, 20)

    def commit(self, messages: list) -> None:
        fs, at = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{at}/{m.name}", f"{at}/{m.name[1:]}")

    def abort(self, messages: list) -> None:
        fs, at = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{at}/{m.name}")


class Captures(DataSource):
    """spark.read.format("captures"), spark.readStream, df.write.mode("append"). Options: path; splitBytes and longestRecord to read; kind and link to write."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def register_captures(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Captures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
