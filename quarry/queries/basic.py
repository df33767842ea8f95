"""Counts, sums, identities, passes, shards and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.hashes import js_hash
from quarry.functions.strings import split_using
from quarry.operators.workers import REGISTRY, BatchReducer, IdentityMapper, IdentityReducer, Mapper, SumInteger
from quarry.plans.job import Job, to_all_shards, to_shard
from quarry.queries.common import read
from quarry.sources.instances import labelled, valid


def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents; partial counts before the exchange."""
    words = read(spark, sf_dir, "documents").select(F.explode(split_using(F.col("text"), " \t\n")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class _WordCombiner(Mapper):
    def start(self) -> None:
        self.counts = {}

    def map(self, key, value) -> None:
        for word in (value or "").replace("\t", " ").replace("\n", " ").split(" "):
            if word:
                self.counts[word] = self.counts.get(word, 0) + 1
        if len(self.counts) > 100_000:
            self.flush()
            self.start()

    def flush(self) -> None:
        for word, n in self.counts.items():
            self.context.output(word, str(n))


def wordcount_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a Python mapper that adds up before it emits."""
    pairs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    job = Job(pairs, _WordCombiner, {"n": F.sum(F.col("value").cast("bigint"))}, shards=4)
    return job.run().select(F.col("key").alias("word"), "n")


def map_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return Job(pairs, IdentityMapper, map_only=True).run()


def map_only_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 25).select(F.col("l_orderkey").cast("string").alias("key"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("value"))
    return Job(lines, lambda df: df, map_only=True).run()


def sum_int_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(F.col("l_linenumber").cast("bigint")).alias("total"))


def sum_float_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("l_quantity").cast("float").cast("double"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.round(total, 3).alias("total"))


def sum_double_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


def sum_by_python_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental reducer class over sorted, streamed groups."""
    pairs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.lit("1").alias("value"))
    return Job(pairs, reducer=SumInteger, shards=4).run().select("key", F.col("value").cast("bigint").alias("total"))


def reduce_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"))
    return Job(pairs, reducer=IdentityReducer, shards=4).run().select("key", "value")


class _Spread(BatchReducer):
    """Least, largest and number of a key's values, by walking over them."""

    def reduce(self, key, values) -> None:
        low, high, n = float("inf"), float("-inf"), 0
        for value in map(float, values):
            low, high, n = min(low, value), max(high, value), n + 1
        self.context.output(key, f"{low!r},{high!r},{n}")


def batch_reduce_first_last_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and number of values a key, by a reducer over streamed groups."""
    pairs = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("value"))
    part = F.split("value", ",")
    return Job(pairs, reducer=_Spread, shards=4).run().select(F.col("key").cast("bigint").alias("key"), part[0].cast("double").alias("first"), part[1].cast("double").alias("last"), part[2].cast("bigint").alias("n"))


class _AnyOne(BatchReducer):
    """Emits a key once and leaves its values unread."""

    def reduce(self, key, values) -> None:
        self.context.output(key, "seen")


def skip_rest_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("key"), F.col("l_returnflag").alias("value"))
    return Job(pairs, reducer=_AnyOne, shards=4).run().select("key", "value")


def multipass(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    job = Job(pairs, lambda df: df.select(F.concat_ws("/", "key", F.col("pass").cast("string")).alias("key"), "value"), {"n": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("bigint"))}, shards=4, passes=3)
    return job.run().select("key", "n", "total")


class _EachPass(Mapper):
    """Emits a key with the pass's number, and how many rows a pass has shown."""

    def start(self) -> None:
        self.seen = 0

    def map(self, key, value) -> None:
        self.seen += 1
        self.context.output(f"{key}/{self.context.current_pass}", value)

    def flush(self) -> None:
        self.context.output(f"rows/{self.context.current_pass}", str(self.seen))


def multipass_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a mapper class, which lives through the passes."""
    pairs = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    return Job(pairs, _EachPass, SumInteger, shards=4, passes=3).run().select("key", F.col("value").cast("bigint").alias("total"))


def sum_float_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of halves by the registered class of single-precision sums."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), (F.col("l_linenumber") * F.lit(0.5)).cast("string").alias("value"))
    return Job(pairs, reducer=REGISTRY["SumFloat"], shards=3).run().select("key", F.col("value").cast("double").alias("total"))


def sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's place in its shard, as the rows come out of a sorted job."""
    pairs = read(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.lit("1").alias("value"))
    job = Job(pairs, reducer={"n": F.count(F.lit(1))}, shards=5, partitioner=lambda key, n: F.pmod(F.length(key) + F.substring(key, -3, 3).cast("int"), F.lit(n)).cast("int"))
    rows = job.sorted().withColumn("at", F.monotonically_increasing_id())
    first = rows.groupBy("shard").agg(F.min("at").alias("first"))
    return rows.join(first, "shard").select("shard", "key", (F.col("at") - F.col("first") + 1).alias("place"))


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's counters say after it has run."""
    pairs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.lit("1").alias("value"))
    job = Job(pairs, lambda df: to_all_shards(df, 2), {"n": F.count(F.lit(1))}, shards=2)
    job.run().write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(job.counts().items()), "counter string, n bigint")


def emit_all_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("1").alias("value"))
    return Job(pairs, lambda df: to_all_shards(df, 4), {"n": F.count(F.lit(1))}, shards=4).run()


def emit_to_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.lit("1").alias("value"), (F.col("o_custkey") % 3).alias("to"))
    return Job(pairs, lambda df: to_shard(df, F.col("to"), 3), {"n": F.count(F.lit(1))}, shards=3).run()


def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a shard under the default partitioner."""
    shard = F.pmod(js_hash(F.col("c_name")), F.lit(7))
    return read(spark, sf_dir, "customer").groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def custom_partitioner(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit("1").alias("value"))
    job = Job(pairs, reducer={"n": F.count(F.lit(1))}, shards=5, partitioner=lambda key, n: F.pmod(key.cast("bigint"), F.lit(n)).cast("int"))
    return job.run().groupBy("shard").agg(F.sum("n").alias("n"))


def single_key_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values under one key: partial sums meet, not rows."""
    pairs = read(spark, sf_dir, "lineitem").select(F.lit("").alias("key"), F.col("l_linenumber").cast("string").alias("value"))
    return Job(pairs, reducer={"total": F.sum(F.col("value").cast("bigint")), "n": F.count(F.lit(1))}).run().select("key", "total", "n")


def _line_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows unlabelled, some with more positives than appearances."""
    k = F.col("l_orderkey")
    positive = F.when(k % 3 == 0, -1.0).otherwise(F.col("l_linenumber").cast("double"))
    return read(spark, sf_dir, "lineitem").select(k.alias("row"), F.col("l_linenumber").alias("line"), positive.cast("float").alias("num_positive"), (F.col("l_quantity") / 8).cast("float").alias("num_appearance"))


def labelled_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(_line_instances(spark, sf_dir)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def invalid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(_line_instances(spark, sf_dir)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_LINES = "SELECT l_linenumber AS line, (CASE WHEN l_orderkey % 3 = 0 THEN -1.0 ELSE l_linenumber END)::FLOAT AS p, (l_quantity / 8)::FLOAT AS a FROM lineitem"
_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word"
_JS = "list_reduce(list_prepend(1315423911::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor(h, ((h * 32 + c + (h >> 2)) & 4294967295)))"

QUERIES = {
    f.__name__: f
    for f in (
        wordcount, wordcount_combiner, map_identity, map_only_project, sum_int_by_key, sum_float_by_key, sum_double_by_key,
        sum_by_python_reducer, reduce_identity, batch_reduce_first_last_count, skip_rest_of_group, multipass, emit_all_shards,
        emit_to_shard, shard_histogram, custom_partitioner, single_key_funnel, labelled_filter, invalid_filter,
        multipass_mapper, sum_float_reducer, sorted_shards, job_counters,
    )
}
ORACLES = {
    "wordcount": _WORDS,
    "wordcount_combiner": _WORDS,
    "map_identity": "SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer",
    "map_only_project": "SELECT l_orderkey::VARCHAR AS key, l_returnflag || '|' || l_linestatus AS value FROM lineitem WHERE l_quantity >= 25",
    "sum_int_by_key": "SELECT l_suppkey AS key, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_suppkey",
    "sum_float_by_key": "SELECT l_suppkey AS key, round(sum(l_quantity::FLOAT::DOUBLE), 3) AS total FROM lineitem GROUP BY l_suppkey",
    "sum_double_by_key": "SELECT l_suppkey AS key, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey",
    "sum_by_python_reducer": "SELECT o_orderpriority AS key, count(*) AS total FROM orders GROUP BY o_orderpriority",
    "reduce_identity": "SELECT c_mktsegment AS key, c_name AS value FROM customer",
    "batch_reduce_first_last_count": "SELECT o_custkey AS key, min(o_totalprice) AS first, max(o_totalprice) AS last, count(*) AS n FROM orders GROUP BY o_custkey",
    "skip_rest_of_group": "SELECT DISTINCT l_shipdate::DATE::VARCHAR AS key, 'seen' AS value FROM lineitem",
    "multipass": "SELECT c_mktsegment || '/' || p AS key, count(*) AS n, sum(c_nationkey)::BIGINT AS total FROM customer, range(3) t(p) GROUP BY 1",
    "multipass_mapper": "SELECT c_mktsegment || '/' || p AS key, sum(c_nationkey)::BIGINT AS total FROM customer, range(3) t(p) GROUP BY 1 UNION ALL SELECT 'rows/' || p, count(*) FROM customer, range(3) t(p) GROUP BY 1",
    "sum_float_reducer": "SELECT l_returnflag AS key, sum(l_linenumber * 0.5)::DOUBLE AS total FROM lineitem GROUP BY l_returnflag",
    "sorted_shards": "SELECT shard, c_name AS key, row_number() OVER (PARTITION BY shard ORDER BY c_name) AS place FROM (SELECT DISTINCT c_name, ((length(c_name) + right(c_name, 3)::INTEGER) % 5)::INTEGER AS shard FROM customer)",
    "job_counters": "SELECT 'map_input' AS counter, count(*) AS n FROM orders UNION ALL SELECT 'map_output', 2 * count(*) FROM orders UNION ALL SELECT 'reduce_output', 2 * count(DISTINCT o_orderpriority) FROM orders",
    "emit_all_shards": "SELECT s::INTEGER AS shard, n_name AS key, count(*) AS n FROM nation, range(4) t(s) GROUP BY 1, 2",
    "emit_to_shard": "SELECT (o_custkey % 3)::INTEGER AS shard, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1, 2",
    "shard_histogram": f"SELECT {_JS} % 7 AS shard, count(*) AS n FROM customer GROUP BY 1",
    "custom_partitioner": "SELECT (c_custkey % 5)::INTEGER AS shard, count(*) AS n FROM customer GROUP BY 1",
    "single_key_funnel": "SELECT '' AS key, sum(l_linenumber)::BIGINT AS total, count(*) AS n FROM lineitem",
    "labelled_filter": f"SELECT line, count(*) AS n FROM ({_LINES}) WHERE p >= 0 GROUP BY line",
    "invalid_filter": f"SELECT line, count(*) AS n FROM ({_LINES}) WHERE p <= a GROUP BY line",
}
