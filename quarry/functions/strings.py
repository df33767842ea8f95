"""Splitting, joining and key codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: decimal keys are padded to so many digits, so that they sort as numbers.
KEY_DIGITS = 10


def _class(delimiters: str) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in delimiters) + "]+"


def split_using(text: Column, delimiters: str) -> Column:
    """Pieces between any of the (ASCII) delimiters; empty pieces are left out."""
    return F.filter(F.split(text, _class(delimiters)), lambda x: x != "")


def split_to_set(text: Column, delimiters: str) -> Column:
    """The distinct pieces, sorted."""
    return F.array_sort(F.array_distinct(split_using(text, delimiters)))


def join_strings(parts: Column, delimiter: str = " ") -> Column:
    return F.array_join(parts, delimiter)


def number_to_key(number: Column) -> Column:
    """At least ten digits, padded with zeros. A negative number is an error; longer ones keep all digits."""
    whole = number.cast("bigint")
    return F.when(whole < 0, F.raise_error(F.lit("a key is made of a number from 0 on"))).otherwise(F.format_string(f"%0{KEY_DIGITS}d", whole))


def key_to_number(key: Column) -> Column:
    return key.cast("bigint")


def encode_number(number: Column, size: int = 8) -> Column:
    """The number's bytes, least significant first, in 4 or 8 bytes."""
    digits = F.substring(F.lpad(F.hex(number.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size)
    pairs = F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(digits, i * 2 + 1, F.lit(2)))
    return F.unhex(F.array_join(pairs, ""))


def decode_number(data: Column, size: int = 8, signed: bool = True) -> Column:
    """The number of 4 or 8 bytes, least significant first; any other length is an error.

    Unsigned numbers of 8 bytes come as decimal(20,0).
    """
    digits = F.hex(data)
    pairs = F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(digits, i * 2 + 1, F.lit(2)))
    value = F.conv(F.array_join(pairs, ""), 16, 10).cast("decimal(20,0)")
    if signed:
        half, whole = 1 << (8 * size - 1), 1 << (8 * size)
        value = F.when(value >= F.lit(str(half)).cast("decimal(20,0)"), value - F.lit(str(whole)).cast("decimal(20,0)")).otherwise(value).cast("bigint")
    elif size == 4:
        value = value.cast("bigint")
    return F.when(F.length(data) != size, F.raise_error(F.lit(f"a number of {size} bytes has {size} bytes"))).otherwise(value)


def printf(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)
