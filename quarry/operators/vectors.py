"""Sparse vectors as rows (id, value), as arrays of (id, value), and as model text.

Zeros are never kept but by scale, which keeps the entries it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scale(u: DataFrame, factor: float) -> DataFrame:
    """u times a factor, entry by entry."""
    return u.select("id", (F.col("value") * F.lit(float(factor))).alias("value"))


def add_scaled(u: DataFrame, v: DataFrame, factor: float = 1.0) -> DataFrame:
    """u + v * factor: entries are added up by id, which needs no join."""
    both = u.select("id", "value").unionByName(scale(v, factor))
    return both.groupBy("id").agg(F.sum("value").alias("value")).where("value <> 0")


def dot(u: DataFrame, v: DataFrame) -> DataFrame:
    """One row: the sum of products over common ids (0 without any)."""
    pair = u.alias("u").join(v.alias("v"), F.col("u.id") == F.col("v.id"))
    return pair.agg(F.coalesce(F.sum(F.col("u.value") * F.col("v.value")), F.lit(0.0)).alias("dot"))


def array_dot(u: Column, v: Column) -> Column:
    """Of two dense arrays of one length."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def array_add_scaled(u: Column, v: Column, factor: float = 1.0) -> Column:
    """Of dense arrays; the shorter one counts as ending in zeros."""
    return F.zip_with(u, v, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)) * factor)


def hybrid_dot(sparse: Column, dense: Column) -> Column:
    """Array of (id, value) with a dense array; ids past its end count nothing."""
    return F.aggregate(sparse, F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.get(dense, x["id"]), F.lit(0.0)))


def at(vector: Column, number: Column) -> Column:
    """The value of an id in an array of (id, value), 0 where it has none."""
    return F.coalesce(F.get(F.filter(vector, lambda x: x["id"] == number), F.lit(0))["value"], F.lit(0.0))


def has(vector: Column, number: Column) -> Column:
    return F.exists(vector, lambda x: x["id"] == number)


def put(vector: Column, number: Column, value: Column) -> Column:
    """The vector with one value changed; 0 takes the entry away. Entries come in order of ids."""
    rest = F.filter(vector, lambda x: x["id"] != number)
    one = F.when(value == 0, F.filter(vector, lambda x: F.lit(False))).otherwise(F.array(F.struct(number.cast("int").alias("id"), value.cast("double").alias("value"))))
    return F.array_sort(F.concat(rest, one))


def collect(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (id, value) as one array a key, in order of ids."""
    return rows.where("value <> 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("vector"))


def to_text(vector: Column) -> Column:
    """"[ id:value id:value ]", without zeros."""
    kept = F.filter(vector, lambda x: x["value"] != 0)
    return F.concat(F.lit("[ "), F.array_join(F.transform(kept, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["value"].cast("string"))), " "), F.when(F.size(kept) > 0, " ]").otherwise("]"))


def from_text(line: Column) -> Column:
    """The array of (id, value) that a model line stands for."""
    parts = F.filter(F.split(line, "[\\[\\] \\t]+"), lambda x: x.contains(":"))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("id"), F.substring_index(x, ":", -1).cast("double").alias("value")))
