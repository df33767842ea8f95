"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.session import shared_folder

#: ASCII bytes that str.split() separates on, and nothing else, are the word
#: separators of the "[^\x20\x09-\x0D]+" contracts; bytes.lower() lower-cases A-Z only.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_WORD).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of anything but ASCII white space."""
    return text.lower().split()


def word_hash(words: list[bytes]):
    """XXH64 of each word."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_key(text_column: str = "text") -> Column:
    """128 bits of the text. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary")))


def binary_column(batch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Writer options for tables of large rows: their buffers are looked at after each row.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(32 << 20)}
#: Tables that this process has written and not given up yet, by path.
_WRITTEN: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; discard() or sweep() deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.options(**options).parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = getattr(df, "_quarry_path", None)
    if path and _WRITTEN.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete whatever written() has left, once the results that read it are saved; gives the number of tables."""
    left = [p for p, s in _WRITTEN.items() if s.sparkContext is spark.sparkContext]
    for path in left:
        del _WRITTEN[path]
        _delete(spark, path)
    return len(left)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a number's text, modulo n: the fold of a document (null: of the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def clashless(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else a table carries."""
    return docs.select(*[F.col(n) for n in names])
