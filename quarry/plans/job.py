"""Map, shuffle and reduce jobs as DataFrame plans.

A job's mapper is a function from DataFrame to DataFrame (column expressions, the fast
way) or a Mapper class; its reducer is a function of grouped aggregate columns or a
Reducer class. Pairs are dealt to shards by an explicit column, the same on any cluster,
and come out sorted by key within each shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quarry.functions.hashes import js_hash
from quarry.operators.workers import BatchReducer, Context, Mapper, Reducer


def hash_shard(key: Column, shards: int) -> Column:
    """The default shard of a key."""
    return F.pmod(js_hash(key.cast("string")), F.lit(shards)).cast("int")


def to_all_shards(rows: DataFrame, shards: int) -> DataFrame:
    """A copy of every row for each shard."""
    return rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def to_shard(rows: DataFrame, shard: Column, shards: int) -> DataFrame:
    """Rows with the shard given; one out of range is an error."""
    whole = shard.cast("int")
    return rows.withColumn("shard", F.when(whole.between(0, shards - 1), whole).otherwise(F.raise_error(F.lit(f"a shard is from 0 to {shards - 1}")).cast("int")))


def passes(rows: DataFrame, n: int) -> DataFrame:
    """Every row once for each pass, with the pass's number."""
    return rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _context(shards: int, passes: int, map_only: bool, input_format: str, output_format: str, config: dict, shard: int) -> Context:
    return Context(shards, shard, passes, 0, map_only, input_format, output_format, dict(config))


@dataclass
class Job:
    source: DataFrame
    mapper: Callable[[DataFrame], DataFrame] | type[Mapper] | None = None
    reducer: dict[str, Column] | type[Reducer] | None = None
    shards: int = 1
    passes: int = 1
    map_only: bool = False
    partitioner: Callable[[Column, int], Column] = hash_shard
    config: dict = field(default_factory=dict)
    key_type: str = "string"
    value_type: str = "string"
    input_format: str = "text"
    output_format: str = "text"

    def __post_init__(self):
        self.counters = {name: Observation(name) for name in ("map_input", "map_output", "reduce_output")}

    def _context(self) -> Callable[[int], Context]:
        """Makes a shard's context; holds plain values only, as it goes to the workers."""
        return partial(_context, self.shards, self.passes, self.map_only, self.input_format, self.output_format, dict(self.config))

    def _counted(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.observe(self.counters[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Rows that went in and out, after an action on run()'s result."""
        return {name: seen.get["n"] for name, seen in self.counters.items() if not (self.map_only and name == "reduce_output")}

    def mapped(self) -> DataFrame:
        """key, value and shard (null: by the partitioner) of what the mapper emits."""
        rows = self._counted(self.source, "map_input")
        if self.mapper is None or not isinstance(self.mapper, type):
            rows = passes(rows, self.passes) if self.passes > 1 else rows
            rows = self.mapper(rows) if self.mapper else rows
        else:
            rows = self._python_map(rows)
        shard = F.col("shard").cast("int") if "shard" in rows.columns else F.lit(None).cast("int")
        return self._counted(rows.select(F.col("key").cast(self.key_type).alias("key"), F.col("value").cast(self.value_type).alias("value"), shard.alias("shard")), "map_output")

    def _python_map(self, rows: DataFrame) -> DataFrame:
        mapper, context_of, n = self.mapper, self._context(), self.passes
        shards, map_only = self.shards, self.map_only

        def run(batches: Iterator) -> Iterator:
            import pandas as pd
            from pyspark import TaskContext

            context = context_of(TaskContext.get().partitionId())
            worker = mapper(context)

            def emitted():
                out, context.emitted = context.emitted, []
                if not map_only:
                    out = [(k, v, worker.shard(k, shards) if s is None else s) for k, v, s in out]
                return pd.DataFrame(out, columns=["key", "value", "shard"]).astype({"shard": "Int32"})

            def turn(number: int):
                """Ends passes and begins the next ones, until the given one has begun."""
                while context.current_pass < number:
                    worker.flush()
                    yield emitted()
                    context.current_pass += 1
                    if context.current_pass < n:
                        worker.start()

            context.current_pass = 0
            worker.start()
            for frame in batches:
                for number, part in frame.groupby("pass") if n > 1 else [(0, frame)]:
                    yield from turn(number)
                    for key, value in zip(part["key"], part["value"]):
                        worker.map(key, value)
                    yield emitted()
            yield from turn(n)

        rows = rows.select("key", "value")
        if n > 1:  # each partition's rows once for each pass, in order of passes; Spark's sort spills
            rows = passes(rows, n).sortWithinPartitions("pass")
        return rows.mapInPandas(run, f"key {self.key_type}, value {self.value_type}, shard int")

    def run(self) -> DataFrame:
        """key and value, and shard unless map-only."""
        rows = self.mapped()
        if self.map_only:
            return rows.drop("shard")
        rows = rows.withColumn("shard", F.coalesce("shard", self.partitioner(F.col("key"), self.shards)))
        if self.reducer is None:
            out = rows.repartition(self.shards, "shard")
        elif isinstance(self.reducer, dict):
            # partial sums before the exchange; nothing of a key's size is ever held
            out = rows.groupBy("shard", "key").agg(*[c.alias(name) for name, c in self.reducer.items()])
        else:
            out = self._python_reduce(rows)
        return self._counted(out, "reduce_output")

    def sorted(self) -> DataFrame:
        """run(), each shard whole in one partition, its keys in byte order."""
        return self.run().repartition(self.shards, "shard").sortWithinPartitions("shard", "key")

    def _python_reduce(self, rows: DataFrame) -> DataFrame:
        reducer, context_of = self.reducer, self._context()
        batch = issubclass(reducer, BatchReducer)

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            def pairs():
                for frame in batches:
                    yield from zip(frame["shard"], frame["key"], frame["value"])

            def emitted(worker):
                out, worker.context.emitted = worker.context.emitted, []
                return pd.DataFrame([(worker.context.shard, k, v) for k, v, _ in out], columns=["shard", "key", "value"])

            worker, rest = None, pairs()
            ahead = next(rest, None)
            while ahead is not None:
                shard, key = ahead[0], ahead[1]
                if worker is None or worker.context.shard != shard:
                    if worker is not None:
                        worker.flush()
                        yield emitted(worker)
                    worker = reducer(context_of(int(shard)))
                    worker.start()

                def values():
                    nonlocal ahead
                    while ahead is not None and ahead[0] == shard and ahead[1] == key:
                        value = ahead[2]
                        ahead = next(rest, None)
                        yield value

                group = values()
                if batch:
                    for _ in worker.reduce(key, group) or ():
                        if len(worker.context.emitted) >= 10_000:
                            yield emitted(worker)
                    for _ in group:  # what the reducer left
                        pass
                else:
                    state = worker.begin(key, next(group))
                    for value in group:
                        state = worker.partial(key, value, state)
                    worker.end(key, state)
                if len(worker.context.emitted) >= 10_000:
                    yield emitted(worker)
            if worker is not None:
                worker.flush()
                yield emitted(worker)

        # a shard's keys stay together and sorted; groups are streamed, never held
        dealt = rows.repartition(self.shards, "shard").sortWithinPartitions("shard", "key")
        return dealt.select("shard", "key", "value").mapInPandas(run, f"shard int, key {self.key_type}, value {self.value_type}")
