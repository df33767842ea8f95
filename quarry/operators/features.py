"""Feature dictionaries, and instances put in terms of their ids."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

#: Serialised bytes up to which a dictionary is looked up within each task.
BROADCAST_BYTES = 64 << 20


def dictionary(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, id): distinct names numbered from 1 in the order of names.

    Names are range-partitioned and sorted; a name's id is its place in its partition
    after the names of the partitions before, so no task sees all names.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    placed = distinct.repartitionByRange("name").sortWithinPartitions("name").withColumn("part", F.spark_partition_id())
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return placed.join(F.broadcast(before), "part").select("name", (F.col("before") + place).cast("int").alias("id"))


def feature_names(instances: DataFrame) -> DataFrame:
    return instances.select(F.explode("features").alias("f")).select(F.col("f.name").alias("name"))


def _looked_up(instances: DataFrame, names: DataFrame) -> DataFrame:
    """Each batch's names are looked up at once in a hash table of the dictionary, which every task holds."""
    rows = names.where(F.col("name").isNotNull()).select("name", F.col("id").cast("int").alias("id")).collect()
    shared = instances.sparkSession.sparkContext.broadcast(([r["name"] for r in rows], [r["id"] for r in rows]))
    place = instances.columns.index("features")

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, ids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())
        for batch in batches:
            lists = batch.column("features")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            at = pc.index_in(flat.field("name"), value_set=known)
            missing = at.is_null().to_numpy(zero_copy_only=False)
            whole = np.ones(batch.num_rows, bool)
            whole[np.repeat(np.arange(batch.num_rows), sizes)[missing]] = False
            value = flat.field("value")
            swapped = pa.StructArray.from_arrays([pa.nulls(len(flat), pa.string()), ids.take(at), value], ["name", "id", "value"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch.column(c) for c in batch.schema.names]
            columns[place] = pa.ListArray.from_arrays(offsets, swapped)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(whole))

    return instances.mapInArrow(scan, instances.schema)


def convert(instances: DataFrame, names: DataFrame, names_bytes: int | None = None) -> DataFrame:
    """Instances with ids for names; an instance with any name that the dictionary lacks is dropped.

    names_bytes: the dictionary's size if known. A dictionary of proven small size is looked up
    in each task, whatever its size in time linear in the features; a larger one is joined by
    name. Null features count as none.
    """
    if names_bytes is None:
        names_bytes = names.agg(F.coalesce(F.sum(F.octet_length("name") + 24), F.lit(0)).alias("n")).first()["n"]
    if names_bytes <= BROADCAST_BYTES:
        return _looked_up(instances, names)
    keyed = instances.withColumn("_row", F.struct(*[F.col(c) for c in instances.columns if c != "features"], F.xxhash64("features").alias("_same")))
    each = keyed.withColumn("_copy", F.monotonically_increasing_id()).select("_row", "_copy", F.posexplode_outer("features").alias("_at", "f"))
    found = each.join(names.withColumnRenamed("name", "_name"), F.col("f.name") == F.col("_name"), "left")
    grouped = found.groupBy("_row", "_copy").agg(
        F.min((F.col("id").isNotNull() | F.col("_at").isNull()).cast("int")).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "id", F.col("f.value").alias("value"))))).alias("_got"),
    )
    features = F.transform("_got", lambda x: F.struct(F.lit(None).cast("string").alias("name"), x["id"].alias("id"), x["value"].alias("value")))
    return grouped.where("_all = 1").select(*[F.col(f"_row.{c}").alias(c) if c != "features" else features.alias("features") for c in instances.columns])
