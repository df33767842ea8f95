from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions import hashes, misc, strings

ALL = 0xFFFFFFFF
APPLE = {
    "rs": 1201423202, "js": 1671125689, "pjw": 6846245, "elf": 6846245, "bkdr": 3050411034, "sdbm": 1327380058,
    "djb": 253337143, "dek": 204066277, "bp": 505165413, "fnv": 1939623600, "ap": 1607415766,
}


def signed(text: str) -> list[int]:
    return [b - 256 if b > 127 else b for b in text.encode()]


def plain(name: str, text: str) -> int:
    """Each hash by whole numbers and one final mask a step."""
    h, a = {"js": 1315423911, "djb": 5381, "dek": len(text.encode()), "ap": 0xAAAAAAAA}.get(name, 0), 63689
    for i, c in enumerate(signed(text)):
        u = c & ALL
        if name == "rs":
            h, a = h * a + c, a * 378551 & ALL
        elif name == "js":
            h ^= ((h << 5) + c + (h >> 2)) & ALL
        elif name in ("pjw", "elf"):
            h = ((h << 4) + c) & ALL
            top = h & 0xF0000000
            h = (h ^ top >> 24) & ~top & ALL
        elif name in ("bkdr", "djb"):
            h = h * (131 if name == "bkdr" else 33) + c
        elif name == "sdbm":
            h = c + h * 65599
        elif name == "dek":
            h = (h << 5) & ALL ^ h >> 27 ^ u
        elif name == "bp":
            h = (h << 7) & ALL ^ u
        elif name == "fnv":
            h = (h * 0x811C9DC5) & ALL ^ u
        elif i % 2 == 0:
            h ^= (h << 7) & ALL ^ (c * (h >> 3)) & ALL
        else:
            h ^= ~((h << 11) + (u ^ h >> 5)) & ALL
        h &= ALL
    return h


def test_hashes_of_apple(spark):
    row = spark.range(1).select(*[f(F.lit("apple")).alias(n) for n, f in hashes.HASHES.items()]).first()
    assert row.asDict() == APPLE


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=8))
def test_hashes_equal_plain_arithmetic(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[f(F.col("t")).alias(n) for n, f in hashes.HASHES.items()]).collect()
    for r in rows:
        assert {n: r[n] for n in hashes.HASHES} == {n: plain(n, r["t"]) for n in hashes.HASHES}


def test_null_has_null_hash(spark):
    row = spark.createDataFrame([(None,)], "t string").select(*[f(F.col("t")) for f in hashes.HASHES.values()], hashes.md5_64(F.col("t"))).first()
    assert set(row) == {None}


def test_md5_number(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    row = spark.range(1).select(*[hashes.md5_64(F.lit(t)) for t in (fox, fox + ".", "")]).first()
    assert [int(x) for x in row] == [0x82B62B379D7D109E, 0x1CFBD090C209D9E4, 0x04B2008FD98C1DD4]


def test_split_and_join(spark):
    row = spark.range(1).select(
        strings.split_using(F.lit(" apple \torange "), " \t").alias("a"),
        strings.split_using(F.lit("apple"), " \t").alias("b"),
        strings.split_using(F.lit(""), " \t").alias("c"),
        strings.split_to_set(F.lit("b,a b,"), ", ").alias("d"),
        strings.split_using(F.lit("a]b^c-d"), "]^-").alias("e"),
        strings.join_strings(F.array(*map(F.lit, ("apple", "banana", "orange"))), ",").alias("f"),
        strings.printf("%d-%s", F.lit(1), F.lit("x")).alias("g"),
    ).first()
    assert list(row) == [["apple", "orange"], ["apple"], [], ["a", "b"], ["a", "b", "c", "d"], "apple,banana,orange", "1-x"]


def test_keys(spark):
    row = spark.range(1).select(strings.number_to_key(F.lit(1)), strings.number_to_key(F.lit(123456789012)), strings.key_to_number(F.lit("0000000042"))).first()
    assert list(row) == ["0000000001", "123456789012", 42]
    with pytest.raises(Exception, match="from 0 on"):
        spark.range(1).select(strings.number_to_key(F.lit(-1))).collect()


def test_byte_codecs(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, -1, 2**40 + 3, -(2**63), 2**63 - 1)], "n long")
    for r in rows.select("n", strings.encode_number(F.col("n")).alias("b"), strings.decode_number(strings.encode_number(F.col("n"))).alias("m"), strings.decode_number(strings.encode_number(F.col("n")), signed=False).alias("u")).collect():
        assert bytes(r["b"]) == r["n"].to_bytes(8, "little", signed=True) and r["m"] == r["n"] and int(r["u"]) == r["n"] % 2**64
    small = rows.where("n between -1 and 1").select("n", strings.decode_number(strings.encode_number(F.col("n"), 4), 4).alias("m"))
    assert all(r["n"] == r["m"] for r in small.collect())
    with pytest.raises(Exception, match="has 8 bytes"):
        spark.range(1).select(strings.decode_number(F.lit(b"abc"))).collect()


def test_random_and_clock(spark):
    rows = spark.range(200).select(misc.rand_int(5, 1).alias("i"), misc.rand_double(1).alias("d"), misc.tick_count().alias("t")).collect()
    assert {r["i"] for r in rows} == set(range(5)) and all(0 <= r["d"] < 1 and 0 <= r["t"] < 86_400_000 for r in rows)
