"""A data source for containers of still frames: `spark.read.format("stills").load(folder)`.

A container (*.stills) holds a video's frames, encoded one by one, and an index of their places, sizes and times, so frames can be read by byte ranges
without decoding what lies before them:

    b"STILLS1\\n"  frame*  index  f64 duration  u64 frames  u64 place of the index  b"STILLS1\\n"
    index: for each frame u64 place, u64 size, f64 seconds

Columns: video_id (the file's stem), frame_idx, ts, n_bytes, duration, content. Only the index is read for planning, and a split takes frames of SPLIT bytes
or one frame. Where the reader's schema leaves content out, no frame is read: `.schema("video_id string, ts double")`. A container without frames gives
no rows; a file that is no container is an error that names it.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAGIC, SPLIT = b"STILLS1\n", 16 << 20
INDEX = np.dtype([("at", "<u8"), ("size", "<u8"), ("ts", "<f8")])
TAIL = struct.Struct("<dQQ8s")
SCHEMA = "video_id string, frame_idx bigint, ts double, n_bytes bigint, duration double, content binary"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def write(path: str, frames: Iterable[tuple[float, bytes]], duration: float) -> None:
    """Writes one container; frames are (seconds, encoded bytes) in order."""
    where, name = filesystem(path)
    index, at = [], len(MAGIC)
    with where.open_output_stream(name) as f:
        f.write(MAGIC)
        for ts, body in frames:
            index.append((at, len(body), ts))
            f.write(body)
            at += len(body)
        f.write(np.array(index, INDEX).tobytes() + TAIL.pack(duration, len(index), at, MAGIC))


def index_of(where, name: str) -> tuple[np.ndarray, float]:
    """(index, duration) of a container, by two reads at its end."""
    with where.open_input_file(name) as f:
        size = f.size()
        if size < TAIL.size + len(MAGIC):
            raise ValueError(f"{name} is no container of stills")
        duration, n, at, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or at + n * INDEX.itemsize + TAIL.size != size:
            raise ValueError(f"{name} is no container of stills")
        return np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX), duration


class Split(InputPartition):
    """Frames [first, last) of a container, which lie side by side."""

    def __init__(self, uri: str, video: str, first: int, last: int):
        self.uri, self.video, self.first, self.last = uri, video, first, last


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.split = schema.fieldNames(), options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        where, name = filesystem(self.path)
        info = where.get_file_info(name)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".stills")), key=lambda f: f.path):
            index, _ = index_of(where, f.path)
            upto = np.cumsum(index["size"].astype(np.int64))
            first = 0
            while first < len(index):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + self.split, "right")))
                out.append(Split(f.path, os.path.splitext(os.path.basename(f.path))[0], first, last))
                first = last
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(self.path)
        index, duration = index_of(where, split.uri)
        part = index[split.first : split.last]
        with where.open_input_file(split.uri) as f:
            for i in range(0, len(part), 64):
                rows = part[i : i + 64]
                n = len(rows)
                have = {
                    "video_id": lambda: pa.array([split.video] * n), "frame_idx": lambda: pa.array(np.arange(n) + split.first + i, pa.int64()), "ts": lambda: pa.array(rows["ts"]), "n_bytes": lambda: pa.array(rows["size"].astype(np.int64)),
                    "duration": lambda: pa.array(np.full(n, duration)), "content": lambda: pa.array([f.read_at(int(r["size"]), int(r["at"])) for r in rows], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([have[c]() for c in self.names], names=self.names)


class Stills(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stills"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        unknown = set(schema.fieldNames()) - {c.split(" ")[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"stills have no {', '.join(sorted(unknown))}")
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Stills)
