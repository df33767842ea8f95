"""Sharded files: names, addresses, and text with or without the place of each line."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Shard names, and the port of an address that names none.
SHARD_NAME = "%s-%05d-of-%05d"
DEFAULT_PORT = 22


def shard_name(base: str, shard: int, shards: int) -> str:
    return SHARD_NAME % (base, shard, shards)


def shard_pattern(base: str) -> str:
    """A glob over all shards of a base name."""
    return f"{base}-[0-9][0-9][0-9][0-9][0-9]-of-[0-9][0-9][0-9][0-9][0-9]"


def _before(text: Column, mark: str) -> Column:
    """What stands before the first mark, all where there is none."""
    return F.substring_index(text, mark, 1)


def _after(text: Column, part: Column) -> Column:
    """The text behind a part that it begins with."""
    return F.substring(text, F.length(part) + 1, F.length(text))


def parse_address(address: Column) -> Column:
    """protocol, user, password, host, port and path of an address; this machine's names make it a local file.

    "protocol://user:password@host#port:path", where all but the path may be missing: the
    protocol ends at "://" if no colon is before it, the login at the first "@", the host at "#"
    or at the last colon, the port at the next colon.
    """
    nothing = F.lit("")
    scheme = _before(address, ":")
    protocol = F.when(F.startswith(_after(address, scheme), F.lit("://")), F.concat(scheme, F.lit("://"))).otherwise(nothing)
    rest = _after(address, protocol)
    login = _before(rest, "@")
    login = F.when((login != rest) & (_before(login, ":") != ""), login).otherwise(nothing)
    rest = _after(rest, F.when(login != "", F.concat(login, F.lit("@"))).otherwise(nothing))
    named = _before(rest, "#")  # host, if a port follows
    port = _before(_after(rest, F.concat(named, F.lit("#"))), ":")
    with_port = F.concat(named, F.lit("#"), port, F.lit(":"))
    last = F.substring_index(named, ":", -1)
    bare = F.when(last != named, F.substring(named, F.lit(1), F.length(named) - F.length(last))).otherwise(nothing)
    place = F.when(F.startswith(rest, with_port), with_port).otherwise(bare)
    host = F.when(F.startswith(rest, with_port), named).otherwise(F.rtrim(bare, F.lit(":")))
    number = F.when(F.startswith(rest, with_port), F.nullif(F.regexp_extract(port, r"^\s*([0-9]+)", 1), nothing).cast("int"))
    local = host.isin("127.0.0.1", "localhost") | (protocol == "")
    user = _before(login, ":")
    return F.struct(
        F.when(local, F.lit("file://")).otherwise(protocol).alias("protocol"),
        user.alias("user"),
        F.when(user != login, _after(login, F.concat(user, F.lit(":")))).otherwise(nothing).alias("password"),
        host.alias("host"),
        F.coalesce(F.nullif(number, F.lit(0)), F.lit(DEFAULT_PORT)).alias("port"),
        _after(rest, place).alias("path"),
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of all files of a path or glob, without their ends. An unfinished last line is a line."""
    return spark.read.text(path)


def read_text_with_places(spark: SparkSession, path: str, strict_lines: bool = False, longest: int = 16 * 1024) -> DataFrame:
    """key (file name and ten-digit byte offset of the line) and value.

    strict_lines: a line that has no end, or is `longest` bytes or more with its end, has an
    empty value once for every full buffer and once for its rest, and text after a NUL is cut.
    Files are read whole, one task each; use read_text where no places are needed.
    """

    def split(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            keys, values = [], []
            for name, data in zip(frame["path"], frame["content"]):
                for at, line in lines(bytes(data), strict_lines, longest):
                    keys.append(f"{name}-{at:010d}")
                    values.append(line.decode("utf-8", "replace"))
            yield pd.DataFrame({"key": keys, "value": values})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "key string, value string")


def lines(data: bytes, strict: bool = False, longest: int = 16 * 1024) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each line."""
    at, skipping = 0, False
    while at < len(data):
        end = data.find(b"\n", at) + 1
        if not strict:
            end = end or len(data)
            yield at, re.sub(rb"\r?\n\Z", b"", data[at:end])
            at = end
            continue
        stop = min(end or len(data), at + longest - 1)
        piece = data[at:stop]
        if not piece.endswith(b"\n"):
            skipping = True
            yield at, b""
        elif skipping:
            skipping = False
            yield at, b""
        else:
            yield at, re.sub(rb"\r?\n\Z", b"", piece).split(b"\0")[0]
        at = stop


def write_text(rows: DataFrame, path: str, column: str = "value") -> None:
    """The value of each row as a line; keys are not written."""
    rows.select(F.col(column).cast("string").alias("value")).write.text(path)
