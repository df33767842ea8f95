"""Weighted, sparse training instances from text and from binary messages.

An instance has num_positive and num_appearance (floats) and features, an array of
(name, id, value).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.strings import split_using
from quarry.sources.recordio import fields, varint

FEATURES = "array<struct<name:string,id:int,value:double>>"
SCHEMA = f"num_positive float, num_appearance float, features {FEATURES}"


def parse_text(lines: DataFrame, column: str = "value", numbered: bool = True, binary: bool = False) -> DataFrame:
    """Instances of lines "positive appearance (feature value)*", between spaces or tabs.

    numbered: features are ids, else names. binary: every value is 1. Blank lines give none.
    """
    part = split_using(F.col(column), " \t\r")
    names = F.sequence(F.lit(2), F.size("part") - 2, F.lit(2))

    def feature(i: Column) -> Column:
        name = F.get("part", i)
        return F.struct(
            (F.lit(None).cast("string") if numbered else name).alias("name"),
            (name.cast("int") if numbered else F.lit(None).cast("int")).alias("id"),
            (F.lit(1.0) if binary else F.get("part", i + 1).cast("double")).alias("value"),
        )

    features = F.when(F.size("part") < 4, F.array().cast(FEATURES)).otherwise(F.transform(names, feature))
    rows = lines.select(part.alias("part")).where(F.size("part") >= 2)
    return rows.select(F.get("part", F.lit(0)).cast("float").alias("num_positive"), F.get("part", F.lit(1)).cast("float").alias("num_appearance"), features.alias("features"))


def decode_message(data: bytes) -> tuple[float, float, list[tuple]]:
    positive = appearance = 0.0
    features = []
    for number, _, value in fields(data):
        if number == 1:
            (positive,) = struct.unpack("<f", value)
        elif number == 2:
            (appearance,) = struct.unpack("<f", value)
        elif number == 3:
            one: dict[int, object] = {}
            for k, _, x in fields(value):
                one[k] = bytes(x).decode() if k == 1 else x if k == 2 else struct.unpack("<d", x)[0]
            features.append((one.get(1), one.get(2), one.get(3)))
    return positive, appearance, features


def encode_message(positive: float, appearance: float, features: list[tuple]) -> bytes:
    out = b"\x0d" + struct.pack("<f", positive) + b"\x15" + struct.pack("<f", appearance)
    for name, number, value in features:
        one = b""
        if name is not None:
            one += b"\x0a" + varint(len(name.encode())) + name.encode()
        if number is not None:
            one += b"\x10" + varint(number)
        one += b"\x19" + struct.pack("<d", value)
        out += b"\x1a" + varint(len(one)) + one
    return out


def decode(records: DataFrame) -> DataFrame:
    """Instances of records whose values are instance messages."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("name", pa.string()), ("id", pa.int32()), ("value", pa.float64())]))
        for batch in batches:
            rows = [decode_message(bytes(v)) for v in batch.column("value").to_pylist()]
            given = [[{"name": n, "id": i, "value": v} for n, i, v in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float32()), pa.array([r[1] for r in rows], pa.float32()), pa.array(given, kind)], ["num_positive", "num_appearance", "features"])

    return records.select("value").mapInArrow(parse, SCHEMA)


def encode(instances: DataFrame, key: Column) -> DataFrame:
    """Records (key, value) of instances."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, positive, appearance, given = (batch.column(c).to_pylist() for c in ("key", "num_positive", "num_appearance", "features"))
            values = [encode_message(p, a, [(x["name"], x["id"], x["value"]) for x in f]) for p, a, f in zip(positive, appearance, given)]
            yield pa.RecordBatch.from_arrays([pa.array([(k or "").encode() for k in keys], pa.binary()), pa.array(values, pa.binary())], ["key", "value"])

    return instances.select(key.cast("string").alias("key"), "num_positive", "num_appearance", "features").mapInArrow(write, "key binary, value binary")


def labelled(instances: DataFrame) -> DataFrame:
    """Without instances of unknown outcome (a negative number of positives)."""
    return instances.where(F.col("num_positive") >= 0)


def valid(instances: DataFrame) -> DataFrame:
    """Without instances of more positives than appearances."""
    return instances.where(F.col("num_positive") <= F.col("num_appearance"))


def dimension(instances: DataFrame) -> int:
    """One more than the largest feature id (0 without features)."""
    return instances.select(F.explode("features").alias("f")).agg(F.coalesce(F.max("f.id") + 1, F.lit(0)).alias("n")).first()["n"]
