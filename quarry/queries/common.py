"""What the query modules share: tables, and training instances made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row (the order), num_positive (its returned lines), num_appearance (its lines) and named features."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("float").alias("num_positive"), F.count(F.lit(1)).cast("float").alias("num_appearance"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    feature = lambda group, column: F.struct(F.concat(F.lit(f"{group}:"), F.col(column)).alias("name"), F.lit(None).cast("int").alias("id"), F.lit(1.0).alias("value"))
    features = F.array(feature("prio", "o_orderpriority"), feature("stat", "o_orderstatus"), feature("seg", "c_mktsegment"))
    return orders.select(F.col("o_orderkey").alias("row"), "num_positive", "num_appearance", features.alias("features"))


#: The same instances in SQL: one row per instance, and one per feature.
ORDER_SQL = """
inst AS (SELECT o_orderkey AS row_id, p AS num_positive, a AS num_appearance, o_orderpriority, o_orderstatus, c_mktsegment
  FROM orders JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::FLOAT AS p, count(*)::FLOAT AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey),
feat AS (SELECT row_id, num_positive, num_appearance, unnest(['prio:' || o_orderpriority, 'stat:' || o_orderstatus, 'seg:' || c_mktsegment]) AS name FROM inst)"""
