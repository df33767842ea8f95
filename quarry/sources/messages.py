"""Printing records whose values are protocol messages of a type that is given as text.

The definitions (a subset of proto2 and proto3: messages, nested ones, groups, scalar
fields and enums) are parsed at run time into descriptors; messages are then built from
these and printed by the protobuf library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"[^"]*"|[A-Za-z_][\w.]*|-?\d+|[{}=;\[\],]', re.DOTALL)
_SCALARS = (
    "double", "float", "int64", "uint64", "int32", "fixed64", "fixed32", "bool", "string", "group", "message", "bytes",
    "uint32", "enum", "sfixed32", "sfixed64", "sint32", "sint64",
)
_LABELS = {"optional": 1, "required": 2, "repeated": 3}


def parse_definitions(text: str, name: str = "given.proto"):
    """A file descriptor of the definitions."""
    from google.protobuf import descriptor_pb2

    tokens = [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]
    out = descriptor_pb2.FileDescriptorProto(name=name, syntax="proto2")
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        token = tokens[at]
        at += 1
        if want and token != want:
            raise ValueError(f"{want} expected, {token} found")
        return token

    def options() -> None:
        if tokens[at] == "[":
            while take() != "]":
                pass

    def enum(target) -> None:
        target.name = take()
        take("{")
        while tokens[at] != "}":
            value = target.value.add(name=take())
            take("=")
            value.number = int(take())
            options()
            take(";")
        take("}")

    def message(target, named: str | None = None) -> None:
        target.name = named or take()
        take("{")
        while tokens[at] != "}":
            word = take()
            if word == "message":
                message(target.nested_type.add())
            elif word == "enum":
                enum(target.enum_type.add())
            elif word in ("option", "extensions", "reserved"):
                while take() != ";":
                    pass
            elif word != ";":
                label = _LABELS.get(word, 1)
                kind = take() if word in _LABELS else word
                field = target.field.add(label=label, name=take())
                take("=")
                field.number = int(take())
                options()
                if kind == "group":
                    field.type, field.type_name = 10, field.name
                    message(target.nested_type.add(), field.name)
                    field.name = field.name.lower()
                    continue
                if kind in _SCALARS:
                    field.type = _SCALARS.index(kind) + 1
                else:
                    field.type_name = kind
                take(";")
        take("}")

    while at < len(tokens):
        word = take()
        if word == "package":
            out.package = take()
            take(";")
        elif word == "message":
            message(out.message_type.add())
        elif word == "enum":
            enum(out.enum_type.add())
        elif word == "syntax":
            take("=")
            out.syntax = take().strip('"')
            take(";")
        else:
            while take() != ";":
                pass
    return out


def message_class(definitions: str, name: str):
    from google.protobuf import descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    file = parse_definitions(definitions)
    pool.Add(file)
    full = name if not file.package or name.startswith(file.package + ".") else f"{file.package}.{name}"
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(full))


def dump(records: DataFrame, definitions: str, message: str) -> DataFrame:
    """line: for each (key, value) its key and the printed message of its value."""

    def show(batches: Iterator) -> Iterator:
        import pandas as pd
        from google.protobuf import text_format

        kind = message_class(definitions, message)
        for frame in batches:
            out = []
            for key, value in zip(frame["key"], frame["value"]):
                one = kind()
                one.ParseFromString(bytes(value))
                name = bytes(key).decode("utf-8", "replace") if isinstance(key, (bytes, bytearray)) else key
                out.append(f"Key: {name}\nValue:{text_format.MessageToString(one)}")
            yield pd.DataFrame({"line": out})

    return records.select("key", "value").mapInPandas(show, "line string")
