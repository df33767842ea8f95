from __future__ import annotations

from pyspark.sql import functions as F

from quarry.streaming import incremental


def test_word_counts_as_files_arrive(spark, tmp_path):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()

    def write(batch, _):
        seen.update({r["key"]: r["n"] for r in batch.collect()})

    for k, lines in enumerate(["apple banana orange\n\nbanana orange apple\n", "apple orange\norange banana\nbanana apple\n"]):
        (folder / f"{k}.txt").write_text(lines)
        query = incremental.start(incremental.word_counts(incremental.text_stream(spark, str(folder))), write, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert set(seen.values()) == {2 * (k + 1)}
    assert set(seen) == {"apple", "banana", "orange"}


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(40)], "k long, kind string").select((F.timestamp_seconds("k")).alias("ts"), "kind")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = incremental.start(incremental.windowed(stream, "ts", "kind", "10 seconds", "1 minute", n=F.count(F.lit(1))), lambda b, _: seen.extend(b.collect()), str(tmp_path / "c"))
    query.awaitTermination()
    assert len(seen) == 8 and {r["n"] for r in seen} == {5}
