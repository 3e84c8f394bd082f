"""A data source for arrays in NumPy files: cells with their indices, one task for each run of chunks. Options ``from`` and ``to`` bound the first index, so that only those chunks are read."""

from __future__ import annotations

import ast
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


@dataclass
class Header:
    dtype: np.dtype
    shape: tuple[int, ...]
    start: int
    fortran: bool


def read_header(path: str) -> Header:
    """The header of a NumPy file, without its data."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is not an array file")
        major, _ = f.read(2)
        n = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
        spec = ast.literal_eval(f.read(n).decode("latin1"))
        return Header(np.dtype(spec["descr"]), tuple(spec["shape"]), f.tell(), spec["fortran_order"])


class Rows(InputPartition):
    """A run of the array's first index."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, low: int = 0, high: int | None = None):
        self.path, self.chunk = path, chunk
        self.header = read_header(path)
        if self.header.fortran:
            raise ValueError("only row-major arrays")
        size = self.header.shape[0] if self.header.shape else 1
        self.low, self.high = max(0, low), size if high is None else min(size, high)

    def partitions(self):
        return [Rows(a, min(a + self.chunk, self.high)) for a in range(self.low, self.high, self.chunk)] or [Rows(0, 0)]

    def read(self, part):
        shape = self.header.shape or (1,)
        width = int(np.prod(shape[1:], dtype=np.int64))
        with open(self.path, "rb") as f:
            f.seek(self.header.start + part.low * width * self.header.dtype.itemsize)
            data = np.frombuffer(f.read((part.high - part.low) * width * self.header.dtype.itemsize), self.header.dtype)
        for at, value in enumerate(data.tolist()):
            index = np.unravel_index(at, (part.high - part.low, *shape[1:])) if width else ()
            yield (int(index[0]) + part.low, *(int(i) for i in index[1:]), float(value))


@dataclass
class Written(WriterCommitMessage):
    cells: int


class ArrayWriter(DataSourceWriter):
    """Each task writes its cells of a two-dimensional array as one file of (i0, i1, value) records."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        found = np.array([tuple(map(float, r)) for r in rows])
        if len(found):
            np.save(f"{self.path}/part-{uuid.uuid4().hex}.npy", found)
        return Written(len(found))

    def commit(self, messages):
        with open(f"{self.path}/_SUCCESS", "w") as f:
            f.write(str(sum(m.cells for m in messages if m)))


class ArraySource(DataSource):
    """``spark.read.format("arrayfile").option("chunk", rows).load(path)``: i0, i1, ..., value."""

    @classmethod
    def name(cls):
        return "arrayfile"

    def schema(self):
        shape = read_header(self.options["path"]).shape or (1,)
        return ", ".join([*(f"i{k} bigint" for k in range(len(shape))), "value double"])

    def reader(self, schema):
        o = self.options
        return ArrayReader(o["path"], int(o.get("chunk", "1024")), int(o.get("from", "0")), int(o["to"]) if "to" in o else None)

    def writer(self, schema, overwrite):
        return ArrayWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)
