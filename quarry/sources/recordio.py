"""Length-prefixed binary records of a key and a value, as a Python data source "recordio".

A record is a 32-bit little-endian length and a protocol message with two optional byte
fields, the key (1) and the value (2). One input partition a file; files are streamed
through pyarrow's file systems, so a path may be an address. The sink writes one shard
a partition under the shard naming of quarry.sources.shards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.sources.shards import shard_name

#: Fixed value: the largest record.
LARGEST = 64 << 20


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return n, at


def encode_pair(key: bytes, value: bytes) -> bytes:
    return b"\x0a" + varint(len(key)) + key + b"\x12" + varint(len(value)) + value


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a message; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't supported")
        yield tag >> 3, kind, value


def decode_pair(data: bytes) -> tuple[bytes, bytes]:
    key = value = b""
    for number, _, x in fields(data):
        if number == 1:
            key = bytes(x)
        elif number == 2:
            value = bytes(x)
    return key, value


def read_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a binary stream; a stream that ends within a record ends there, a record over the limit is an error."""
    while len(head := stream.read(4)) == 4:
        (size,) = struct.unpack("<I", head)
        if size > LARGEST:
            raise ValueError(f"a record of {size} bytes is over the limit of {LARGEST}")
        if len(data := stream.read(size)) < size:
            return
        yield decode_pair(data)


def write_record(stream, key: bytes, value: bytes) -> None:
    data = encode_pair(key, value)
    if len(data) > LARGEST:
        raise ValueError(f"a record of {len(data)} bytes is over the limit of {LARGEST}")
    stream.write(struct.pack("<I", len(data)) + data)


def _system(path: str):
    from pyarrow import fs

    if path.startswith("sftp://"):
        raise ValueError(f"no file system for {path}: sftp isn't read here; copy the files to a folder that all hosts share")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import fnmatch

        from pyarrow import fs

        system, path = _system(self.path)
        folder, _, name = path.rpartition("/")
        found = system.get_file_info(path) if not any(c in name for c in "*?[") else None
        if found is not None and found.type == fs.FileType.File:
            paths = [path]
        else:
            if found is not None:
                folder, name = path, "*"
            infos = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
            paths = sorted(x.path for x in infos if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, name) and x.base_name[0] not in "._")
        if not paths:
            raise FileNotFoundError(f"no file matches {self.path}")
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(prefix + p) for p in paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, path = _system(partition.path)
        with system.open_input_stream(path, compression=None) as stream:
            yield from read_records(stream)


@dataclass
class _Written(WriterCommitMessage):
    part: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, base: str):
        self.path, self.base = path, base

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from uuid import uuid4

        from pyspark import TaskContext

        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        # the number comes first, so that names sort as partitions do
        part = f"_{context.partitionId():05d}-{context.taskAttemptId()}-{uuid4().hex}"
        with system.open_output_stream(f"{path}/{part}") as stream:
            for row in rows:
                write_record(stream, bytes(row[0]), bytes(row[1]))
        return _Written(part)

    def commit(self, messages: list) -> None:
        system, path = _system(self.path)
        parts = sorted(m.part for m in messages if m)
        for k, part in enumerate(parts):
            system.move(f"{path}/{part}", f"{path}/{shard_name(self.base, k, len(parts))}")

    def abort(self, messages: list) -> None:
        system, path = _system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{path}/{m.part}")


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordio"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("base", "part"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key and value of every record of a file, a folder or a glob."""
    register(spark)
    return spark.read.format("recordio").load(path)


def write(rows: DataFrame, path: str, base: str = "part") -> None:
    """One shard a partition of (key, value); strings are written as UTF-8, null as empty."""
    from pyspark.sql import functions as F

    register(rows.sparkSession)
    data = rows.select(*[F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias(c) for c in ("key", "value")])
    data.write.format("recordio").option("base", base).mode("append").save(path)


def read_any_store(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's own file reader, for stores that only Spark opens; a file is held whole in its task."""

    def parse(batches: Iterator) -> Iterator:
        import io

        import pandas as pd

        for frame in batches:
            for data in frame["content"]:
                yield pd.DataFrame(list(read_records(io.BytesIO(bytes(data)))), columns=["key", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "key binary, value binary")
