"""Data sources over files that Spark has no format for: fixed records cut into byte ranges, and numbered frames as a
stream that keeps their order."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

PACKETS = "source string, packet_no long, ptr long, descriptor array<float>"
FRAMES = "frame_id long, path string, data binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or an address of one, and the path there."""
    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files of a folder, of a name with stars in a folder, or the one file, by path; those that begin with _ or .
    are not seen."""
    fs, at = opened(path)
    folder, _, name = at.rstrip("/").rpartition("/")
    if "*" in name:
        found = [i for i in fs.get_file_info(pafs.FileSelector(folder or "/")) if fnmatchcase(i.base_name, name)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return fs, sorted((i for i in found if i.type == pafs.FileType.File and i.base_name[0] not in "_."), key=lambda i: i.path)


def record_of(dim: int) -> np.dtype:
    """An 8-byte pointer and `dim` floats, little-endian."""
    return np.dtype([("ptr", "<i8"), ("x", "<f4", (dim,))])


@dataclass
class Records(InputPartition):
    file: str
    first: int
    count: int


class PacketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.record = options["path"], record_of(int(options["dim"]))
        self.each = max(1, int(options.get("splitbytes", 64 << 20)) // self.record.itemsize)

    def partitions(self) -> list[Records]:
        """Ranges of whole records; what is known of a file on the driver is its length."""
        out = []
        for info in listed(self.path)[1]:
            n, rest = divmod(info.size, self.record.itemsize)
            if rest:
                raise ValueError(f"{info.path}: not a whole number of packets of {self.record['x'].shape[0]} floats")
            out += [Records(info.path, i, min(self.each, n - i)) for i in range(0, n, self.each)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        size, dim = self.record.itemsize, self.record["x"].shape[0]
        with opened(self.path)[0].open_input_file(part.file) as f:
            f.seek(part.first * size)
            for at in range(part.first, part.first + part.count, 8192):
                n = min(8192, part.first + part.count - at)
                rows = np.frombuffer(f.read(n * size), self.record, n)
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, np.ascontiguousarray(rows["x"]).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.file] * n), pa.array(np.arange(at, at + n)), pa.array(np.ascontiguousarray(rows["ptr"])), vectors],
                    names=["source", "packet_no", "ptr", "descriptor"],
                )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PacketWriter(DataSourceArrowWriter):
    """A task writes a file for each source it holds, under a hidden name; they get their names once all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.dim = options["path"], int(options["dim"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        run, out = uuid.uuid4().hex, {}
        try:
            for b in batches:
                rows = np.zeros(b.num_rows, record_of(self.dim))
                rows["ptr"] = b.column("ptr").to_numpy(zero_copy_only=False)
                values = b.column("descriptor").flatten().to_numpy(zero_copy_only=False)
                if len(values) != b.num_rows * self.dim or {len(v) for v in b.column("descriptor")} - {self.dim}:
                    raise ValueError(f"a descriptor has not {self.dim} numbers")
                rows["x"] = values.reshape(-1, self.dim)
                source = np.array(b.column("source").to_pylist(), object)
                for s in dict.fromkeys(source.tolist()):
                    if s not in out:
                        out[s] = fs.open_output_stream(f"{folder}/_{s}-{run}.bin")
                    out[s].write(rows[source == s].tobytes())
        finally:
            for f in out.values():
                f.close()
        return Written([f"{s}-{run}.bin" for s in out])

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(f"{folder}/_{name}")


class PacketSource(DataSource):
    """Format `packets`: options `path`, `dim` and `splitBytes` (64 MiB). Appends when written to."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> PacketReader:
        return PacketReader(self.options)

    def writer(self, schema, overwrite: bool) -> PacketWriter:
        if overwrite:
            raise ValueError("packets are appended only")
        return PacketWriter(self.options)


@dataclass
class Numbers(InputPartition):
    frames: list[tuple[int, str]]


class FrameStream(DataSourceStreamReader):
    """Offsets are the number of the next frame. A frame comes once all before it are there, so what arrives late or
    out of order is waited for, and a restart goes on where the last batch ended."""

    def __init__(self, options: dict):
        self.path, self.first = options["path"], int(options.get("first", 0))
        self.last = int(options["last"]) if "last" in options else None
        self.name = re.compile(re.escape(options.get("prefix", "")) + r"(\d+)\." + re.escape(options.get("suffix", "bmp")))
        self.each, self.next = int(options.get("framespertask", 16)), None

    def _found(self) -> dict[int, str]:
        at = ((self.name.fullmatch(i.base_name), i.path) for i in listed(self.path)[1])
        numbers = {int(m[1]): p for m, p in at if m}
        return {n: p for n, p in numbers.items() if n >= self.first and (self.last is None or n <= self.last)}

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        found = self._found()
        if self.next is None or self.next == self.first:  # begins with the first number that exists
            self.next = min(found, default=self.first)
        while self.next in found:
            self.next += 1
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        self.next = max(self.next or 0, end["next"])
        due = sorted((n, p) for n, p in self._found().items() if start["next"] <= n < end["next"])
        return [Numbers(due[i : i + self.each]) for i in range(0, len(due), self.each)]

    def read(self, part: Numbers) -> Iterator[tuple]:
        fs = opened(self.path)[0]
        for n, path in part.frames:
            with fs.open_input_stream(path) as f:
                yield n, path, f.read()

    def commit(self, end: dict) -> None:
        self.next = max(self.next or 0, end["next"])


class FrameSource(DataSource):
    """Format `frames`, for streams: options `path`, `prefix`, `suffix`, `first`, `last`, `framesPerTask`."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)
