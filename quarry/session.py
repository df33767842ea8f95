"""Session defaults: adaptive execution, ANSI arithmetic, UTC."""

from __future__ import annotations

import functools
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "quarry", **conf: str) -> SparkSession:
    """The active session, or a new one with the defaults and the given settings."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where that is unset and every task runs in this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master or ""):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quarry-shared-")


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a context, unless PYTHONPATH has it for them."""
    import os
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quarry_shipped", False):
        return
    # made on the driver only; Spark serves it to the executors
    path = f"{tempfile.mkdtemp(prefix='quarry-')}/quarry.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._quarry_shipped = True
