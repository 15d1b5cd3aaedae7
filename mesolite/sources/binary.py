"""Binary trajectories as Spark data sources: a partition for each run of frames, found by an index of offsets.

The driver reads only headers, by seeking from frame to frame; each task opens the
file and reads its own byte ranges.  Files are opened through Arrow's file
systems, so paths may be local ones or URIs (hdfs:, s3:) that all executors reach.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of frames that a partition takes (option ``partitionBytes``); a larger frame is a partition of its own.
PARTITION_BYTES = 64 << 20


def opened(path: str):
    """The file system and the files of a path: itself, or those of a folder, in order of their names."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [inner]
    found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return system, sorted(found)


@dataclass
class Frames(InputPartition):
    """Frames of one file: (number in the file, offset, further facts) of each."""

    path: str
    frames: list

    def __init__(self, path: str, frames: list):
        super().__init__(0)
        self.path, self.frames = path, frames


def runs(path: str, frames: list, sizes: list[int], most: int) -> list[Frames]:
    """Successive frames of up to ``most`` bytes together."""
    out, own, total = [], [], 0
    for f, size in zip(frames, sizes, strict=True):
        if own and total + size > most:
            out.append(Frames(path, own))
            own, total = [], 0
        own.append(f)
        total += size
    return [*out, Frames(path, own)] if own else out


class _Reader(DataSourceReader):
    """``index`` lists a file's frames and their sizes, ``rows`` gives a frame's record batches."""

    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.arrow, self.most = options["path"], schema, int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Frames]:
        system, files = opened(self.path)
        out = []
        for f in files:
            with system.open_input_file(f) as file:
                out += runs(f, *self.index(file), self.most)
        return out

    def read(self, partition: Frames | None):
        if partition is None:  # there is no frame
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            for frame in partition.frames:
                for table in self.rows(file, partition.path, *frame):
                    yield from table.select(self.arrow.names).cast(self.arrow).to_batches()


DUMP = "file string, frame int, timestep long, time double, idx long, values array<double>, columns array<string>, box array<double>, tilt array<double>, boundary array<int>"
_DUMP = pa.schema([("file", pa.string()), ("frame", pa.int32()), ("timestep", pa.int64()), ("time", pa.float64()), ("idx", pa.int64()), ("values", pa.list_(pa.float64())), ("columns", pa.list_(pa.string())), ("box", pa.list_(pa.float64())), ("tilt", pa.list_(pa.float64())), ("boundary", pa.list_(pa.int32()))])


def dump_header(file, at: int) -> dict | None:
    """A frame's header at an offset; none at the end of the file or where the frame is cut off."""
    file.seek(at)
    raw = file.read(1 << 16)
    for order in "<>":
        place = 0

        def take(kind: str, n: int = 1):
            nonlocal place
            size = struct.calcsize("<" + kind) * n
            if place + size > len(raw):
                raise EOFError
            got = struct.unpack_from(f"{order}{n}{kind}", raw, place)  # noqa: B023
            place += size
            return got if n > 1 else got[0]

        try:
            revision, step, columns, time = 0, take("q"), None, None
            if step < 0:
                if not 0 < -step < 64:
                    continue
                place += -step
                if take("i") != 1:
                    continue
                revision, step = take("i"), take("q")
            atoms, triclinic, boundary = take("q"), take("i"), take("i", 6)
            if atoms < 0 or step < 0 or any(not 0 <= b <= 3 for b in boundary):
                continue
            box, tilt = take("d", 6), take("d", 3) if triclinic else (0.0, 0.0, 0.0)
            width = take("i")
            if not 0 < width < 10_000:
                continue
            if revision > 1:
                units = take("i")
                place += max(0, units)
                if take("b"):
                    time = take("d")
                size = take("i")
                if place + size > len(raw):
                    raise EOFError
                columns = raw[place : place + size].decode().split()
                place += size
            chunks = take("i")
        except EOFError:
            return None
        return {"order": order, "step": step, "time": time, "atoms": atoms, "boundary": list(boundary), "box": list(box), "tilt": list(tilt), "width": width, "columns": columns, "chunks": chunks, "start": at + place}
    raise ValueError(f"no header of a binary dump at byte {at}")


class _DumpReader(_Reader):
    def index(self, file) -> tuple[list, list[int]]:
        frames, sizes, at, end = [], [], 0, file.size()
        while at < end:
            h = dump_header(file, at)
            if h is None:
                break
            place = h["start"]
            for _ in range(h["chunks"]):
                if place + 4 > end:
                    return frames, sizes
                file.seek(place)
                place += 4 + 8 * struct.unpack(h["order"] + "i", file.read(4))[0]
            if place > end:  # a frame that is cut off is left out
                break
            frames.append((len(frames), at))
            sizes.append(place - at)
            at = place
        return frames, sizes

    def rows(self, file, path: str, frame: int, at: int):
        h = dump_header(file, at)
        place, first = h["start"], 0
        for _ in range(h["chunks"]):
            file.seek(place)
            n = struct.unpack(h["order"] + "i", file.read(4))[0]
            values = np.frombuffer(file.read(8 * n), h["order"] + "f8").astype(np.float64)
            place += 4 + 8 * n
            count = n // h["width"]
            same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(count, np.int32)))  # noqa: E731, B023
            data = {"file": same(path, pa.string()), "frame": same(frame, pa.int32()), "timestep": same(h["step"], pa.int64()), "time": same(h["time"], pa.float64()), "idx": pa.array(np.arange(first, first + count))}
            data["values"] = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * h["width"]), pa.array(values))
            for name, key in (("columns", "columns"), ("box", "box"), ("tilt", "tilt"), ("boundary", "boundary")):
                data[name] = same(h[key], self.arrow.field(name).type)
            first += count
            yield pa.table(data)


class BinaryDump(DataSource):
    """``spark.read.format("binary_dump").load(path)``: a row for each atom of binary dump files.

    Both byte orders, 64-bit counts, with or without the header that names columns.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_dump"

    def schema(self) -> str:
        return DUMP

    def reader(self, schema) -> _DumpReader:
        return _DumpReader(self.options, _DUMP)


GSD = "file string, frame int, step long, idx long, type string, position struct<x: double, y: double, z: double>, orientation array<double>, diameter double, mass double, box array<double>"
_GSD = pa.schema([("file", pa.string()), ("frame", pa.int32()), ("step", pa.int64()), ("idx", pa.int64()), ("type", pa.string()), ("position", pa.struct([(c, pa.float64()) for c in "xyz"])), ("orientation", pa.list_(pa.float64())), ("diameter", pa.float64()), ("mass", pa.float64()), ("box", pa.list_(pa.float64()))])
#: Fixed values of the format: its mark, entry layout and number types.
MAGIC = 0x65DF65DF65DF65DF
_ENTRY = np.dtype([("frame", "<u8"), ("n", "<u8"), ("location", "<i8"), ("m", "<u4"), ("id", "<u2"), ("type", "u1"), ("flags", "u1")])
_TYPES = {1: "u1", 2: "<u2", 3: "<u4", 4: "<u8", 5: "i1", 6: "<i2", 7: "<i4", 8: "<i8", 9: "<f4", 10: "<f8"}


class _GsdReader(_Reader):
    def index(self, file) -> tuple[list, list[int]]:
        file.seek(0)
        head = struct.unpack("<5Q2I", file.read(48))
        if head[0] != MAGIC:
            raise ValueError("not a GSD file")
        _, index_at, entries, names_at, name_rows, _, version = head
        file.seek(index_at)
        raw = file.read(int(entries) * _ENTRY.itemsize)
        index = np.frombuffer(raw[: len(raw) // _ENTRY.itemsize * _ENTRY.itemsize], _ENTRY)
        index = index[index["location"] != 0]
        file.seek(names_at)
        raw = file.read(int(name_rows) * 64)
        if version >> 16 < 2:  # older files have a name in each row of 64 bytes
            names = [raw[k : k + 64].split(b"\0")[0].decode() for k in range(0, len(raw), 64)]
        else:
            names = [x.decode() for x in raw.split(b"\0")]
        count = int(index["frame"].max()) + 1 if len(index) else 0
        first, frames, sizes = {}, [], []
        for f in range(count):
            own = {names[e["id"]]: (int(e["location"]), int(e["n"]), int(e["m"]), int(e["type"])) for e in index[index["frame"] == f]}
            if f == 0:
                first = own
            # what a frame lacks is as in the first one
            frames.append((f, {**first, **own}))
            sizes.append(sum(n * m * np.dtype(_TYPES[t]).itemsize for _, n, m, t in own.values()))
        return frames, sizes

    def rows(self, file, path: str, frame: int, chunks: dict):
        def chunk(name: str, default=None):
            if name not in chunks:
                return default
            at, n, m, kind = chunks[name]
            file.seek(at)
            kind = np.dtype(_TYPES[kind])
            got = np.frombuffer(file.read(n * m * kind.itemsize), kind)
            return got.reshape(n, m) if m > 1 else got

        # a frame without a number of particles has none; a chunk of another length belongs to another number
        n = int(chunk("particles/N", np.zeros(1))[0])
        whole = lambda name, default: x if (x := chunk(name)) is not None and len(x) == n else default
        names = chunk("particles/types")
        names = [bytes(r.astype(np.uint8)).split(b"\0")[0].decode() for r in (names if names.ndim == 2 else names[:, None])] if names is not None else ["A"]
        kinds = whole("particles/typeid", np.zeros(n, int)).astype(int)
        position = whole("particles/position", np.zeros((n, 3))).astype(float)
        turn = whole("particles/orientation", np.tile([1.0, 0, 0, 0], (n, 1))).astype(float)
        box = chunk("configuration/box", np.array([1, 1, 1, 0, 0, 0], float)).astype(float).tolist()
        same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(n, np.int32)))
        data = {"file": same(path, pa.string()), "frame": same(frame, pa.int32()), "step": same(int(chunk("configuration/step", np.zeros(1))[0]), pa.int64()), "idx": pa.array(np.arange(n))}
        data["type"] = pa.array([names[k] if 0 <= k < len(names) else str(k) for k in kinds.tolist()], pa.string())
        data["position"] = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(position[:, k])) for k in range(3)], names=list("xyz"))
        data["orientation"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(turn.ravel()))
        data |= {c: pa.array(whole(f"particles/{c}", np.ones(n)).astype(float)) for c in ("diameter", "mass")}
        data["box"] = same(box, pa.list_(pa.float64()))
        yield pa.table(data)


class Gsd(DataSource):
    """``spark.read.format("gsd").load(path)``: a row for each particle of GSD files, what a frame lacks taken from the first."""

    @classmethod
    def name(cls) -> str:
        return "gsd"

    def schema(self) -> str:
        return GSD

    def reader(self, schema) -> _GsdReader:
        return _GsdReader(self.options, _GSD)


def binary_dump(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(BinaryDump)
    return spark.read.format("binary_dump").option("partitionBytes", partition_bytes).load(path)


def gsd(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Gsd)
    return spark.read.format("gsd").option("partitionBytes", partition_bytes).load(path)
