"""Sums by key over a stream of pairs, as files arrive.

The state is Spark's own (a running aggregate in update mode); a batch query over the
same files gives the same totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.strings import split_using


def text_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """value: the lines of the files that are in the folder or come to it."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def running(pairs: DataFrame, **totals: Column) -> DataFrame:
    """One row a key with the given aggregates, kept up to date."""
    return pairs.groupBy("key").agg(*[c.alias(name) for name, c in totals.items()])


def word_counts(lines: DataFrame) -> DataFrame:
    words = lines.select(F.explode(split_using(F.col("value"), " \t\r")).alias("key"))
    return running(words, n=F.count(F.lit(1)))


def windowed(rows: DataFrame, time: str, key: str, width: str, late: str, **totals: Column) -> DataFrame:
    """Aggregates by key and window of event time; rows later than `late` are left out once a window is closed."""
    groups = rows.withWatermark(time, late).groupBy(F.window(time, width), F.col(key).alias("key"))
    return groups.agg(*[c.alias(name) for name, c in totals.items()]).select(F.col("window.start").alias("start"), "key", *totals)


def start(updates: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hands every batch of updates to `write`; the checkpoint lets a restarted query go on where it was."""
    return updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
