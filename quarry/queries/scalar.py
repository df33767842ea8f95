"""Hashes, splitting, joining and codecs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import hashes, strings
from quarry.queries.common import read
from quarry.sources.shards import parse_address


def _hash_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "customer").select("c_custkey", hashes.HASHES[name](F.col("c_name")).alias("h"))

    return query


def hash_md5_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", hashes.md5_64(F.col("c_name")).cast("string").alias("h"))


def split_multi_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(strings.split_using(F.col("p_name"), " #aeiou")).alias("piece"))


def split_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(strings.split_to_set(F.col("text"), " \t\n"), "|").alias("words"))


def join_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", strings.join_strings(F.array("o_orderstatus", "o_orderpriority"), ",").alias("joined"))


def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = strings.number_to_key(F.col("l_orderkey") * 1000003)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("key"), strings.key_to_number(key).alias("number"))


def byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = strings.encode_number(F.col("l_orderkey") - 1000)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", strings.decode_number(data).alias("number"), F.length(data).cast("bigint").alias("size"))


def printf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", strings.printf("%05d-of-%05d", F.col("s_suppkey"), F.lit(100)).alias("text"))


def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of supplier keys, taken apart."""
    k = F.col("s_suppkey").cast("string")
    address = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/data/"), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("sftp://user"), k, F.lit(":pw@host#36000:/d/"), k)).otherwise(F.concat(F.lit("sftp://me@localhost:/d/"), k))
    return read(spark, sf_dir, "supplier").select("s_suppkey", parse_address(address).alias("a")).select("s_suppkey", "a.*")


def _step(body: str, start: str = "0::BIGINT", item: str = "ord(c)::BIGINT") -> str:
    return f"list_reduce(list_prepend({start}, list_transform(string_split(c_name, ''), lambda c, i: {item})), lambda h, c: {body})"


_M = "4294967295"
_NIBBLE = f"((h * 16 + c) & {_M})"
_TOP = f"({_NIBBLE} & 4026531840)"
_SQL = {
    "js": _step(f"xor(h, ((h * 32 + c + (h >> 2)) & {_M}))", "1315423911::BIGINT"),
    "pjw": _step(f"(xor({_NIBBLE}, {_TOP} >> 24) & 268435455)"),
    "elf": _step(f"(xor({_NIBBLE}, {_TOP} >> 24) & ~{_TOP})"),
    "bkdr": _step(f"((h * 131 + c) & {_M})"),
    "sdbm": _step(f"((c + h * 64 + h * 65536 - h) & {_M})"),
    "djb": _step(f"((h * 33 + c) & {_M})", "5381::BIGINT"),
    "dek": _step(f"xor(xor((h * 32) & {_M}, h >> 27), c)", "length(c_name)::BIGINT"),
    "bp": _step(f"xor((h * 128) & {_M}, c)"),
    "fnv": _step("xor(((h * 2166136261) % 4294967296), c)", "0::HUGEINT", "ord(c)::HUGEINT"),
    # the multiplier rides in the upper half of the fold's number
    "rs": f"({_step('((h % 4294967296) * (h // 4294967296) + c) % 4294967296 + (((h // 4294967296) * 378551) % 4294967296) * 4294967296', '(63689::HUGEINT * 4294967296)', 'ord(c)::HUGEINT')} % 4294967296)",
    # an odd place is marked by 256
    "ap": _step(f"xor(h, CASE WHEN c < 256 THEN xor((h * 128) & {_M}, (c * (h >> 3)) & {_M}) ELSE {_M} - ((h * 2048 + xor(c - 256, h >> 5)) & {_M}) END)", "2863311530::BIGINT", "ord(c)::BIGINT + 256 * ((i - 1) % 2)"),
}

QUERIES = {f"hash_{name}": _hash_query(name) for name in hashes.HASHES}
QUERIES |= {f.__name__: f for f in (hash_md5_64, split_multi_delim, split_set, join_strings, key_codec, byte_codec, printf, address_parts)}
ORACLES = {f"hash_{name}": f"SELECT c_custkey, ({sql})::BIGINT AS h FROM customer" for name, sql in _SQL.items()}
ORACLES |= {
    "hash_md5_64": "SELECT c_custkey, md5_number_upper(c_name)::VARCHAR AS h FROM customer",
    "split_multi_delim": "SELECT * FROM (SELECT p_partkey, unnest(string_split_regex(p_name, '[ #aeiou]+')) AS piece FROM part) WHERE piece <> ''",
    "split_set": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> ''))), '|') AS words FROM documents",
    "join_strings": "SELECT o_orderkey, o_orderstatus || ',' || o_orderpriority AS joined FROM orders",
    "key_codec": "SELECT l_orderkey, l_linenumber, printf('%010d', l_orderkey * 1000003) AS key, l_orderkey * 1000003 AS number FROM lineitem",
    "byte_codec": "SELECT l_orderkey, l_linenumber, l_orderkey - 1000 AS number, 8::BIGINT AS size FROM lineitem",
    "printf": "SELECT s_suppkey, printf('%05d-of-%05d', s_suppkey, 100) AS text FROM supplier",
    "address_parts": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'sftp://' ELSE 'file://' END AS protocol,
        CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'user' || s_suppkey ELSE 'me' END AS user, CASE WHEN s_suppkey % 3 = 1 THEN 'pw' ELSE '' END AS password,
        CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'host' ELSE 'localhost' END AS host, CASE WHEN s_suppkey % 3 = 1 THEN 36000 ELSE 22 END AS port,
        CASE WHEN s_suppkey % 3 = 0 THEN '/data/' ELSE '/d/' END || s_suppkey AS path FROM supplier""",
}
