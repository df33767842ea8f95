"""String hashes of 32 bits as column expressions, in whole numbers from 0 to 2^32 - 1.

Each folds the string's bytes, read as signed numbers. Sums stay within 64 bits, so
nothing overflows under ANSI arithmetic; products of two 32-bit numbers are taken in
halves. A null string has a null hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_ALL = 0xFFFFFFFF


def signed_bytes(text: Column) -> Column:
    """The bytes of a string as numbers from -128 to 127."""
    digits = F.hex(text.cast("binary"))
    size = F.octet_length(text)
    number = lambda i: (F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint") + 128) % 256 - 128
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), size - 1), number))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_ALL))


def _times(x: Column, y: Column) -> Column:
    """Product of two 32-bit numbers modulo 2^32."""
    high = F.shiftleft(_low(x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _low(_low(x * y.bitwiseAND(F.lit(0xFFFF))) + high)


def _fold(text: Column, seed: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(signed_bytes(text), seed.cast("bigint"), lambda h, c: _low(step(h, c)))


def _whole(n: int) -> Column:
    return F.lit(n).cast("bigint")


def js_hash(text: Column) -> Column:
    return _fold(text, _whole(1315423911), lambda h, c: h.bitwiseXOR(_low(F.shiftleft(h, 5) + c + F.shiftright(h, 2))))


def rs_hash(text: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        return F.struct(_low(_times(acc["h"], acc["a"]) + c).alias("h"), _times(acc["a"], _whole(378551)).alias("a"))

    start = F.struct(_whole(0).alias("h"), _whole(63689).alias("a"))
    return F.aggregate(signed_bytes(text), start, step, lambda acc: acc["h"])


def _top_nibble(text: Column, clear: Callable[[Column, Column], Column]) -> Column:
    def step(h: Column, c: Column) -> Column:
        moved = _low(F.shiftleft(h, 4) + c)
        top = moved.bitwiseAND(F.lit(0xF0000000))
        return clear(moved.bitwiseXOR(F.shiftright(top, 24)), top)

    return _fold(text, _whole(0), step)


def pjw_hash(text: Column) -> Column:
    return _top_nibble(text, lambda h, top: h.bitwiseAND(F.lit(0x0FFFFFFF)))


def elf_hash(text: Column) -> Column:
    return _top_nibble(text, lambda h, top: h.bitwiseAND(F.bitwise_not(top)))


def bkdr_hash(text: Column) -> Column:
    return _fold(text, _whole(0), lambda h, c: h * 131 + c)


def sdbm_hash(text: Column) -> Column:
    return _fold(text, _whole(0), lambda h, c: c + F.shiftleft(h, 6) + F.shiftleft(h, 16) - h)


def djb_hash(text: Column) -> Column:
    return _fold(text, _whole(5381), lambda h, c: h * 33 + c)


def dek_hash(text: Column) -> Column:
    return _fold(text, F.octet_length(text), lambda h, c: _low(F.shiftleft(h, 5)).bitwiseXOR(F.shiftright(h, 27)).bitwiseXOR(_low(c)))


def bp_hash(text: Column) -> Column:
    return _fold(text, _whole(0), lambda h, c: _low(F.shiftleft(h, 7)).bitwiseXOR(_low(c)))


def fnv_hash(text: Column) -> Column:
    return _fold(text, _whole(0), lambda h, c: _times(h, _whole(0x811C9DC5)).bitwiseXOR(_low(c)))


def ap_hash(text: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        h = acc["h"]
        even = _low(F.shiftleft(h, 7)).bitwiseXOR(_times(_low(c), F.shiftright(h, 3)))
        odd = _low(F.bitwise_not(F.shiftleft(h, 11) + _low(c).bitwiseXOR(F.shiftright(h, 5))))
        new = h.bitwiseXOR(F.when(acc["i"] % 2 == 0, even).otherwise(odd))
        return F.struct(_low(new).alias("h"), (acc["i"] + 1).alias("i"))

    start = F.struct(_whole(0xAAAAAAAA).alias("h"), _whole(0).alias("i"))
    return F.aggregate(signed_bytes(text), start, step, lambda acc: acc["h"])


def md5_64(text: Column) -> Column:
    """The first eight bytes of the MD5 digest as a little-endian number, decimal(20,0)."""
    digest = F.md5(text.cast("binary"))
    pairs = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substr(digest, i * 2 + 1, F.lit(2)))
    return F.conv(F.array_join(pairs, ""), 16, 10).cast("decimal(20,0)")


HASHES: dict[str, Callable[[Column], Column]] = {
    "rs": rs_hash, "js": js_hash, "pjw": pjw_hash, "elf": elf_hash, "bkdr": bkdr_hash, "sdbm": sdbm_hash,
    "djb": djb_hash, "dek": dek_hash, "bp": bp_hash, "fnv": fnv_hash, "ap": ap_hash,
}
