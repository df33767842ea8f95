from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions.strings import split_using
from quarry.operators.workers import REGISTRY, BatchReducer, Context, IdentityMapper, IdentityReducer, IncrementalReducer, Mapper, SumDouble, SumFloat, SumInteger, create, register
from quarry.plans.job import Job, hash_shard, to_all_shards, to_shard

WORDS = ["apple banana orange", "", "banana orange apple", "apple orange", "orange banana", "banana apple"]


def pairs(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key string, value string")


def split_words(df):
    return df.select(F.explode(split_using(F.col("value"), " ")).alias("key"), F.lit("1").alias("value"))


def result(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def test_word_count_by_columns_and_by_classes(spark):
    by_columns = Job(pairs(spark, WORDS), split_words, {"value": F.sum(F.col("value").cast("bigint")).cast("string")}, shards=3)
    by_class = Job(pairs(spark, WORDS), split_words, SumInteger, shards=3)
    want = [("apple", "4"), ("banana", "4"), ("orange", "4")]
    assert result(by_columns.run()) == want == result(by_class.run())


class Lengths(Mapper):
    def start(self):
        self.seen = 0

    def map(self, key, value):
        self.seen += 1
        self.context.output(f"{self.context.config['prefix']}{self.context.current_pass}", str(len(value)))

    def flush(self):
        self.context.output("rows", str(self.seen))


def test_passes_and_config(spark):
    job = Job(pairs(spark, WORDS).coalesce(1), Lengths, SumInteger, shards=2, passes=2, config={"prefix": "p"})
    total = str(sum(map(len, WORDS)))
    assert result(job.run()) == [("p0", total), ("p1", total), ("rows", str(2 * len(WORDS)))]


class Concat(IncrementalReducer):
    def begin(self, key, value):
        return [value]

    def partial(self, key, value, state):
        return [*state, value]

    def end(self, key, state):
        self.context.output(key, ",".join(sorted(state)))


class ConcatBatch(BatchReducer):
    def reduce(self, key, values):
        self.context.output(key, ",".join(sorted(values)))


class First(BatchReducer):
    def reduce(self, key, values):
        next(values)
        self.context.output(key, "one")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdé"), st.text("xyz", max_size=3)), max_size=30), st.integers(1, 5))
def test_incremental_equals_batch(spark, rows, shards):
    df = spark.createDataFrame(rows, "key string, value string")
    want: dict = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    want = sorted((k, ",".join(sorted(v))) for k, v in want.items())
    assert result(Job(df, reducer=Concat, shards=shards).run()) == want == result(Job(df, reducer=ConcatBatch, shards=shards).run())


def test_rest_of_a_group_may_be_left(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("c", "5")], "key string, value string")
    assert result(Job(df, reducer=First, shards=1).run()) == [("a", "one"), ("b", "one"), ("c", "one")]


def test_identities(spark):
    df = pairs(spark, WORDS)
    want = sorted((str(i), v) for i, v in enumerate(WORDS))
    assert result(Job(df, IdentityMapper, map_only=True).run()) == want == result(Job(df, reducer=IdentityReducer, shards=4).run())


def test_sums_of_fractions(spark):
    df = spark.createDataFrame([("a", "0.5"), ("a", "0.25"), ("b", "-1")], "key string, value string")
    assert result(Job(df, reducer=SumDouble, shards=2).run()) == [("a", "0.75"), ("b", "-1.0")]


def test_shards(spark):
    df = pairs(spark, WORDS)
    every = Job(df, lambda d: to_all_shards(d, 3), {"n": F.count(F.lit(1))}, shards=3).run().collect()
    assert sorted((r["shard"], r["key"], r["n"]) for r in every) == sorted((s, str(i), 1) for s in range(3) for i in range(len(WORDS)))
    sent = Job(df, lambda d: to_shard(d, F.col("key").cast("int") % 2, 2), shards=2).run().collect()
    assert all(r["shard"] == int(r["key"]) % 2 for r in sent)
    with pytest.raises(Exception, match="from 0 to 1"):
        Job(df, lambda d: to_shard(d, F.lit(2), 2), shards=2).run().collect()
    by_hash = df.select("key", hash_shard(F.col("key"), 5).alias("s")).collect()
    assert all(0 <= r["s"] < 5 for r in by_hash)


def test_order_within_shards(spark):
    df = spark.createDataFrame([(k, "1") for k in ("b", "a", "é", "B", "", "aa")], "key string, value string")
    for part in Job(df, reducer={"n": F.count(F.lit(1))}, shards=2).sorted().rdd.glom().collect():
        keys = [(r["shard"], r["key"].encode()) for r in part]
        assert keys == sorted(keys)


class Sender(Mapper):
    def map(self, key, value):
        self.context.output_to_all_shards(key, "all")
        self.context.output_to_shard(1, key, "one")

    def shard(self, key, shards):
        return 0


def test_directed_output_of_classes(spark):
    rows = Job(pairs(spark, ["x"]), Sender, IdentityReducer, shards=3).run().collect()
    assert sorted((r["shard"], r["value"]) for r in rows) == [(0, "all"), (1, "all"), (1, "one"), (2, "all")]
    context = Context(shards=2)
    with pytest.raises(ValueError):
        context.output_to_shard(2, "k", "v")
    with pytest.raises(ValueError):
        Context(map_only=True).output_to_all_shards("k", "v")


def test_counters(spark):
    job = Job(pairs(spark, WORDS), split_words, {"n": F.count(F.lit(1))}, shards=2)
    job.run().collect()
    assert job.counts() == {"map_input": 6, "map_output": 12, "reduce_output": 3}


def test_registry():
    assert isinstance(create("IdentityMapper", Context()), IdentityMapper)
    assert create("nothing", Context()) is None and isinstance(create("nothing", Context(), Lengths), Lengths)
    with pytest.raises(ValueError):
        register("SumInteger", SumDouble)
    assert REGISTRY["SumInteger"] is SumInteger


def test_empty_input(spark):
    df = spark.createDataFrame([], "key string, value string")
    assert Job(df, reducer=Concat, shards=2).run().collect() == [] and Job(df, Lengths, map_only=True).run().count() >= 0


def test_output_is_handed_over_within_a_key():
    """An identity over a large key never holds it: what was emitted leaves at the reducer's yields."""
    context, held = Context(), []
    for _ in IdentityReducer(context).reduce("k", iter(range(50_000))):
        if len(context.emitted) >= 10_000:
            held.append(len(context.emitted))
            context.emitted = []
    assert held == [10_000] * 5 and not context.emitted


def test_one_large_key(spark):
    df = spark.range(30_000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    rows = Job(df, reducer=IdentityReducer, shards=2).run()
    assert rows.count() == 30_000 == rows.select("value").distinct().count()


def test_passes_over_many_partitions(spark):
    """Every partition is seen whole in each pass, also one without rows."""
    df = pairs(spark, WORDS).repartition(3, "key").where("key <> '0'")
    job = Job(df, Lengths, SumInteger, shards=2, passes=3, config={"prefix": "p"})
    total = str(sum(map(len, WORDS[1:])))
    assert result(job.run()) == [("p0", total), ("p1", total), ("p2", total), ("rows", str(3 * (len(WORDS) - 1)))]


def test_sums_in_single_precision(spark):
    df = spark.createDataFrame([("a", "16777216"), ("a", "1"), ("b", "0.5"), ("b", "0.25")], "key string, value string")
    got = result(Job(df.coalesce(1), reducer=SumFloat, shards=1).run())
    assert [(k, float(v)) for k, v in got] == [("a", 16777216.0), ("b", 0.75)]
