from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from quarry.sources import formats, instances, messages, recordio, shards


def test_shard_names():
    assert shards.shard_name("/d/out", 3, 12) == "/d/out-00003-of-00012"


def test_addresses(spark):
    given = ["data/in.txt", "s3://bucket-less/key", "sftp://ann:pw:x@store.example:/srv/in", "sftp://ann:pw@store.example#2022:/srv/in:2", "sftp://bob@127.0.0.1:/srv/x", "sftp://localhost#9:/srv/x", "sftp://h#0:p", "sftp://h#x", "a:b:/c", "@h:/d", "", "sftp://:pw@h:/p"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, a string").select("i", shards.parse_address(F.col("a")).alias("p")).orderBy("i").collect()
    assert [tuple(r["p"]) for r in rows] == [
        ("file://", "", "", "", 22, "data/in.txt"), ("s3://", "", "", "", 22, "bucket-less/key"), ("sftp://", "ann", "pw:x", "store.example", 22, "/srv/in"),
        ("sftp://", "ann", "pw", "store.example", 2022, "/srv/in:2"), ("file://", "bob", "", "127.0.0.1", 22, "/srv/x"), ("file://", "", "", "localhost", 9, "/srv/x"),
        ("sftp://", "", "", "h", 22, "p"), ("sftp://", "", "", "", 22, "h#x"), ("file://", "", "", "a:b", 22, "/c"), ("file://", "", "", "@h", 22, "/d"),
        ("file://", "", "", "", 22, ""), ("sftp://", "", "", ":pw@h", 22, "/p"),
    ]


def test_globs(spark, tmp_path):
    for k in range(5):
        (tmp_path / shards.shard_name("in", k, 5)).write_text(f"{k}\n")
    count = lambda pattern: shards.read_text(spark, f"{tmp_path}/{pattern}").count()
    assert [count(p) for p in ("in-*", "in-0000?-of-00005", "in-0000[0-2]-of-00005", "in-000{00,01,02}-of-00005")] == [5, 5, 3, 3]
    assert shards.read_text(spark, shards.shard_pattern(f"{tmp_path}/in")).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        count("none-*")


def test_lines_with_places(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"apple banana orange\n\nbanana orange apple\r\nlast")
    rows = shards.read_text_with_places(spark, str(tmp_path / "x")).collect()
    assert [(r["key"][-11:], r["value"]) for r in rows] == [("-0000000000", "apple banana orange"), ("-0000000020", ""), ("-0000000021", "banana orange apple"), ("-0000000042", "last")]


def test_strict_lines():
    assert list(shards.lines(b"abc\nabcdefgh\nx\0y\nend", True, 6)) == [(0, b"abc"), (4, b""), (9, b""), (13, b"x"), (17, b"")]


def test_record_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a key", "a value"), ("", ""), ("é", "x" * 100_000)], "key string, value string").repartition(2)
    recordio.write(rows, str(tmp_path / "out"), base="rec")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [shards.shard_name("rec", k, 2) for k in range(2)]
    want = sorted((r["key"].encode(), r["value"].encode()) for r in rows.collect())
    for back in (recordio.read(spark, str(tmp_path / "out")), recordio.read(spark, f"{tmp_path}/out/rec-*"), recordio.read_any_store(spark, str(tmp_path / "out"))):
        assert sorted((bytes(r["key"]), bytes(r["value"])) for r in back.collect()) == want


def test_record_limits():
    out = io.BytesIO()
    recordio.write_record(out, b"k", b"v")
    data = out.getvalue()
    assert list(recordio.read_records(io.BytesIO(data + data[:3]))) == [(b"k", b"v")]
    assert list(recordio.read_records(io.BytesIO(data + data[:-1]))) == [(b"k", b"v")]
    with pytest.raises(ValueError, match="limit"):
        list(recordio.read_records(io.BytesIO(b"\xff\xff\xff\x7f")))


@pytest.mark.parametrize("n", [0, 1, 0xFF, 0xFFFF, 0xFFFFFFFF])
def test_varint(n):
    assert recordio.read_varint(recordio.varint(n), 0) == (n, len(recordio.varint(n)))


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([("k", "v")], "key string, value string")
    formats.write_pairs(rows, str(tmp_path / "t"), "something else")
    assert [r["value"] for r in shards.read_text(spark, str(tmp_path / "t")).collect()] == ["v"]
    formats.write_pairs(rows, str(tmp_path / "r"), "recordio")
    assert bytes(formats.read_pairs(spark, str(tmp_path / "r"), "recordio").first()["value"]) == b"v"


def test_instances_of_text(spark):
    lines = spark.createDataFrame([("10 10   2 1 5 0",), ("0  10   2 0 5 1",), ("",), ("1\t2",)], "value string")
    rows = sorted(tuple(r) for r in instances.parse_text(lines).collect())
    assert [(p, a, [(x["id"], x["value"]) for x in f]) for p, a, f in rows] == [(0.0, 10.0, [(2, 0.0), (5, 1.0)]), (1.0, 2.0, []), (10.0, 10.0, [(2, 1.0), (5, 0.0)])]
    assert instances.dimension(instances.parse_text(lines)) == 6
    assert {x["value"] for r in instances.parse_text(lines, binary=True).collect() for x in r["features"]} == {1.0}
    named = instances.parse_text(spark.createDataFrame([("1 2 a:b 0.5",)], "value string"), numbered=False).first()
    assert (named["features"][0]["name"], named["features"][0]["value"]) == ("a:b", 0.5)


def test_instances_as_messages(spark):
    rows = spark.createDataFrame([(1.5, 2.0, [("g:x", None, 0.25), (None, 300, -1.0)]), (0.0, 1.0, [])], instances.SCHEMA)
    back = instances.decode(instances.encode(rows, F.lit("k")))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_filters(spark):
    rows = spark.createDataFrame([(-1.0, 2.0, []), (3.0, 2.0, []), (1.0, 2.0, [])], instances.SCHEMA)
    assert instances.labelled(rows).count() == 2 and instances.valid(rows).count() == 2


def test_dump_of_messages(spark):
    text = """package p; // note
    message Pair { required float a = 1; optional string name = 2; repeated group Item = 3 { required uint64 index = 4; } enum E { X = 0; Y = 1; } optional E e = 5; repeated In in = 6; message In { optional int32 n = 1; } }"""
    kind = messages.message_class(text, "Pair")
    one = kind(a=1.5, name="n", e=1)
    one.item.add(index=7)
    getattr(one, "in").add(n=3)
    rows = spark.createDataFrame([(b"k", one.SerializeToString())], "key binary, value binary")
    line = messages.dump(rows, text, "Pair").first()["line"]
    assert line.startswith("Key: k\nValue:") and "index: 7" in line and "e: Y" in line and "n: 3" in line


def test_addresses_without_a_file_system():
    with pytest.raises(ValueError, match="sftp"):
        recordio._system("sftp://me@host:/d/a.rec")
