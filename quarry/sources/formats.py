"""Reading and writing pairs by the name of a format."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import recordio, shards

_LOG = logging.getLogger(__name__)


def known(name: str) -> str:
    """text or recordio; any other name means text, and is logged."""
    if name not in ("text", "recordio"):
        _LOG.error("unknown format %s; text is taken", name)
        return "text"
    return name


def read_pairs(spark: SparkSession, path: str, format: str = "text", **options) -> DataFrame:
    return recordio.read(spark, path) if known(format) == "recordio" else shards.read_text_with_places(spark, path, **options)


def write_pairs(rows: DataFrame, path: str, format: str = "text", base: str = "part") -> None:
    if known(format) == "recordio":
        recordio.write(rows, path, base)
    else:
        shards.write_text(rows, path)
